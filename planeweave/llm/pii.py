"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Seeds are the identifiers that the fixed patterns find, and long mixed values given to a name (secrets).
The words around seeds are lexical patterns: the two words before, or the word before and the one
behind. A second pass over the texts finds what stands in patterns of enough seeds, whatever its shape
and length; a bitmap of fixed size tells which words may begin one. Patterns and instances form a graph
that Spark scores in rounds: a pattern is as good as its instances are by their other patterns, an
instance as the noisy-or of its patterns. Instances of high score become spans of the kind of their
best pattern; plain words need a higher score than what has a digit or an @.

Defined results: null or empty text has no span (empty strings, zero counts, the hash of nothing);
rows that repeat a doc_id and text give equal rows; an empty table gives an empty result; other
columns of the input are ignored. A null doc_id is an id like any other.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Kinds of the fixed patterns, and those that spans may have.
KINDS = ("email", "ip", "card", "phone")
SPAN_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the start of a run of digits: a later digit of it would go on alike.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A value of at least 20 letters and digits, four of each or more, behind a sign that gives it to a name.
_GIVEN = re.compile(r"[=:][\x20\t]*[\"']?([0-9A-Za-z][0-9A-Za-z_+-]{19,})")
#: Words of contexts and candidates, and the signs between them.
_WORD = re.compile(r"[^\s=:|\"'<>]+|[=:|]")
_PUNCTUATION = ".,;!?()[]{}"
_MORE = frozenset("0123456789(+")
#: Bits of each bitmap, of patterns and of the words before them.
BITS = 1 << 23
#: Tasks that the rows of one pattern or identifier are dealt over.
SALTS = 8
#: Scores are summed in these parts of one.
UNIT = 1 << 30


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one pass: the part before an @ is the run of its characters that ends there."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in that order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of long mixed values that are given to a name."""
    found = []
    for m in _GIVEN.finditer(text):
        digits = sum(map(str.isdigit, m[1]))
        letters = sum(map(str.isalpha, m[1]))
        if digits >= 4 and letters >= 4:
            found.append((m.start(1), SECRET, m.end(1)))
    return found


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that needs no context."""
    secrets = secret_spans(text)
    return sorted([*base_spans(text), *secrets]) if secrets else base_spans(text)


def plain_word(token: str) -> str:
    return token.lower().strip(_PUNCTUATION)


def _use(word: str) -> int:
    """What a word is to a pattern: 2 lexical (a letter and fewer than four digits), 1 a sign, 0 nothing."""
    if any(map(str.isalpha, word)):
        return 2 if sum(map(str.isdigit, word)) < 4 else 0
    return 1 if word and not any(map(str.isalnum, word)) else 0


def patterns_around(left2: str, left1: str, right: str) -> list[str]:
    """Patterns of a place: the two words before it, one of which may be a sign; the word before and the one behind it."""
    found = []
    if _use(left1) and _use(left2) and _use(left1) + _use(left2) > 2:
        found.append(f"2\x1f{left2}\x1f{left1}")
    if _use(left1) == _use(right) == 2:
        found.append(f"1\x1f{left1}\x1f{right}")
    return found


def value_of(token: str) -> str:
    """What tells instances apart: letters and digits without case, hashed."""
    return hashlib.blake2b(re.sub(r"\W", "", token).lower().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def seed_slots(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Patterns around every seed. A part of a word beside a seed is a word, up to the next seed."""
    places = [m.span() for m in _WORD.finditer(text)]
    starts, out = [a for a, _ in places], []
    word = lambda k: plain_word(text[slice(*places[k])]) if 0 <= k < len(places) else ""
    for n, (a, kind, b) in enumerate(spans):
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        prefix = plain_word(text[max(places[i][0], spans[n - 1][2] if n else 0) : a])
        suffix = plain_word(text[b : min(places[j][1], spans[n + 1][0] if n + 1 < len(spans) else len(text))])
        left = [prefix, word(i - 1)] if prefix else [word(i - 1), word(i - 2)]
        for pattern in patterns_around(left[1], left[0], suffix or word(j + 1)):
            out.append({"pattern": pattern, "kind": kind, "value": value_of(text[a:b])})
    return out


class Marks:
    """Bitmaps of patterns and of the words right before a candidate; they may say yes wrongly, never no."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits
        self.words = _Remembered(self)

    def has(self, crc: int, base: int) -> int:
        """Whether the bit of a word (``base`` BITS) or pattern (0) with this crc32 is set."""
        at = base + crc % BITS
        return self.bits[at >> 3] >> (at & 7) & 1


class _Remembered(dict):
    """Token -> (word, its bytes, use, whether a candidate may follow, crc32 of a pattern's part up to this
    word as the first of two before, and as the one before); forgets all beyond a bound."""

    def __init__(self, marks: Marks, most: int = 200_000) -> None:
        super().__init__()
        self.marks, self.most = marks, most

    def __missing__(self, token: str) -> tuple[str, bytes, int, bool, int, int]:
        if len(self) > self.most:
            self.clear()
        word = plain_word(token)
        raw, use = word.encode("utf-8", "surrogatepass"), _use(word)
        before = use > 0 and bool(self.marks.has(zlib.crc32(raw), BITS))
        found = self[token] = (word, raw, use, before, zlib.crc32(b"2\x1f" + raw + b"\x1f"), zlib.crc32(b"1\x1f" + raw + b"\x1f"))
        return found


#: What stands in for a word beyond the text's ends.
_NOTHING = ("", b"", 0, False, 0, 0)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] == "+"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def candidates(text: str, marks: Marks) -> Iterator[tuple[int, int, str]]:
    """(start, end, pattern) of what stands in a marked pattern and is no seed; of any shape and length.

    A word with a digit goes on over single blanks before more numbers.
    """
    tokens = _WORD.findall(text)
    words = [*map(marks.words.__getitem__, tokens), _NOTHING]
    hits = [i for i, w in enumerate(words) if w[3]]
    if not hits:
        return
    crc, has = zlib.crc32, marks.has
    places: list[tuple[int, int]] = []
    taken: list[tuple[int, int, int]] = []

    def free(a: int, b: int) -> bool:
        k = bisect_right(begins, b - 1) - 1
        return k < 0 or ends[k] <= a

    for i in hits:
        at = i + 1
        if at >= len(tokens):
            return
        left2, left1, right = words[i - 1] if i else _NOTHING, words[i], words[at + 1]
        two = left2[2] and left1[2] + left2[2] > 2 and has(crc(left1[1], left2[4]), 0)
        digits = _DIGIT.search(tokens[at])
        one = left1[2] == 2 and (digits or right[2] == 2 and has(crc(right[1], left1[5]), 0))
        if not two and not one:
            continue
        if not places:
            places = [m.span() for m in _WORD.finditer(text)]
            taken = seed_spans(text)
            begins = [a for a, _, _ in taken]
            ends = np.maximum.accumulate([b for _, _, b in taken]).tolist() if taken else []
        if not free(*places[at]):
            continue
        last = at
        if digits:
            while last + 1 < len(tokens) and places[last + 1][0] == places[last][1] + 1 and text[places[last][1]] == " " and tokens[last + 1][0] in _MORE and free(*places[last + 1]):
                last += 1
            right = words[last + 1]
            one = left1[2] == right[2] == 2 and has(crc(right[1], left1[5]), 0)
        a, b = _trimmed(text, places[at][0], places[last][1])
        if a < b:
            if two:
                yield a, b, f"2\x1f{left2[0]}\x1f{left1[0]}"
            if one:
                yield a, b, f"1\x1f{left1[0]}\x1f{right[0]}"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, secrets and the patterns around both of every text, without the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                spans = base_spans(text)
                counts = [0] * len(KINDS)
                for _, kind, _ in spans:
                    counts[kind] += 1
                listed = ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
                secrets = secret_spans(text)
                slots = seed_slots(text, sorted([*spans, *secrets])) if spans or secrets else []
                rows.append((*counts, hashlib.sha256(listed.encode()).hexdigest(), listed, [{"start": a, "kind": k, "end": b} for a, k, b in secrets], slots))
            out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "base", "secrets", "slots"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "text_hash", batch["text_hash"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text_hash long, " + ", ".join(f"n_{k} long" for k in KINDS)
    shape += ", base_sha256 string, base string, secrets array<struct<start: long, kind: int, end: long>>, slots array<struct<pattern: string, kind: int, value: string>>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, shape)


def marks_of(patterns: DataFrame) -> bytes:
    """The bitmaps of a table of patterns; their size is fixed whatever the table's."""
    part = F.split("pattern", "\x1f")
    before = F.when(F.element_at(part, 1) == "2", F.element_at(part, 3)).otherwise(F.element_at(part, 2))
    bit = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(BITS))
    bits = patterns.select(F.explode(F.array(bit(F.col("pattern")), bit(before) + BITS)).alias("bit"))
    cells = bits.groupBy(F.floor(F.col("bit") / 64).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(2 * BITS // 64, dtype=np.int64)
    out[cells["cell"].to_numpy(int)] = cells["bits"].to_numpy(np.int64)
    return out.tobytes()


def uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and how often something that is no seed stands in it; tasks sum up first."""
    shared = docs.sparkSession.sparkContext.broadcast(marks_of(patterns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> pd.DataFrame:
            return pd.DataFrame({"pattern": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

        marks, found = Marks(shared.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    found.update(p for _, _, p in candidates(text, marks))
            if len(found) > 200_000:
                yield rows()
                found.clear()
        yield rows()

    return docs.select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("others"))


def placed(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, pattern, value and plain (no digit, no @) of all candidates."""
    shared = docs.sparkSession.sparkContext.broadcast(marks_of(patterns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = Marks(shared.value)
        for batch in batches:
            at, rows = [], []
            for n, text in enumerate(batch["text"]):
                for a, b, pattern in candidates(text, marks) if text else ():
                    at.append(n)
                    rows.append((a, b, pattern, value_of(text[a:b]), not any(c == "@" or c.isdigit() for c in text[a:b])))
            out = pd.DataFrame(rows, columns=["start", "end", "pattern", "value", "plain"]).astype({"pattern": object, "value": object})
            out.insert(0, "doc_id", batch["doc_id"].iloc[at].array)
            out.insert(1, "text_hash", batch["text_hash"].iloc[at].array)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text_hash long, start long, end long, pattern string, value string, plain boolean"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, shape)


def _spread(rows: DataFrame, one: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one`` row per key, the rows of a key dealt over ``SALTS`` tasks by ``by``."""
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def discovered(docs: DataFrame, found: DataFrame, support: int, share: float, rounds: int, pattern_score: float, instance_score: float, word_score: float) -> DataFrame:
    """New spans (doc_id, text_hash, start, end, kind) by rounds over the pattern-instance graph.

    ``support``: distinct seeds that a pattern needs; ``share``: part of a pattern's uses that must be
    seeds, below which it could not become good and its instances are not listed.
    """
    slots = found.select(F.inline("slots"))
    seeds = written(slots.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")))
    kinds = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("values"), F.sum("n").alias("uses"))
    # A pattern's kind is that of most of its distinct seeds.
    patterns = kinds.groupBy("pattern").agg(F.max(F.struct("values", F.negative("kind").alias("kind"))).alias("most"), F.sum("values").alias("values"), F.sum("uses").alias("uses"))
    patterns = cut(patterns.where(F.col("values") >= support).select("pattern", F.negative("most.kind").alias("p_kind"), "uses"))
    patterns = patterns.join(uses(docs, patterns), "pattern", "left").where(F.col("uses") >= share * (F.col("uses") + F.coalesce("others", F.lit(0))))
    patterns = cut(patterns.select("pattern", "p_kind"))
    if patterns.isEmpty():  # no context has enough seeds: no text is read again
        return docs.select("doc_id", F.lit(0).cast("long").alias("text_hash"), *[F.lit(0).cast("long").alias(c) for c in ("start", "end")], F.lit(0).alias("kind")).limit(0)
    new = written(_spread(placed(docs, patterns), patterns, "pattern", ["doc_id", "start"]))
    known = _spread(seeds, patterns, "pattern", ["value"]).select("pattern", "value", F.lit(True).alias("seed"))
    edges = written(known.union(new.select("pattern", "value", F.lit(False).alias("seed"))).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    # One unseen bad instance is assumed of every pattern.
    # Sums are of whole numbers, so that no order of rows changes a verdict.
    summed = lambda x: F.sum(F.round(x * UNIT).cast("long")) / UNIT
    score = lambda good: summed(good) / (F.count("*") + 1)
    ranked = cut(edges.groupBy("pattern").agg(score(F.col("seed").cast("double")).alias("conf")))
    doubt = F.ln(1 - F.least("conf", F.lit(0.999)))
    for _ in range(rounds - 1):
        told = _spread(edges, ranked, "pattern", ["value"]).select("pattern", "value", "seed", doubt.alias("doubt"))
        whole = told.groupBy("value").agg(summed(F.col("doubt")).alias("doubts"), F.max("seed").alias("known"))
        # What an instance's other patterns say of it.
        rest = F.when(F.col("known"), 1.0).otherwise(1 - F.exp(F.col("doubts") - F.col("doubt")))
        ranked = cut(told.join(whole, "value").groupBy("pattern").agg(score(rest).alias("conf")))
    told = _spread(edges, ranked, "pattern", ["value"]).select("value", "seed", doubt.alias("doubt"))
    instances = told.groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(summed(F.col("doubt")))).alias("score"))
    good = ranked.where(F.col("conf") >= pattern_score)
    best = _spread(_spread(new, good, "pattern", ["doc_id", "start"]), instances, "value", ["doc_id", "start"])
    best = best.where(F.col("score") >= F.when(F.col("plain"), word_score).otherwise(instance_score))
    top = best.groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("conf", F.negative("p_kind").alias("kind"))).alias("top"))
    return top.select("doc_id", "text_hash", "start", "end", F.negative("top.kind").alias("kind"))


def extract(
    docs: DataFrame, support: int = 3, share: float = 0.1, rounds: int = 3, pattern_score: float = 0.6, instance_score: float = 0.6, word_score: float = 0.9
) -> tuple[DataFrame, DataFrame]:
    """(findings per document that need no context, new spans)."""
    found = written(scan(docs))
    return found, discovered(docs, found, support, share, rounds, pattern_score, instance_score, word_score)


def pii(docs: DataFrame, **options) -> DataFrame:
    """Counts, hash and list of spans of every document."""
    found, new = extract(docs.select("doc_id", "text"), **options)
    extra = new.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    extra = extra.withColumnsRenamed({"doc_id": "m_doc_id", "text_hash": "m_text_hash"})
    kept = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("text_hash") == F.col("m_text_hash"))
    part = lambda s, i: F.element_at(F.split(s, ":"), i)
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    base: Column = F.when(F.col("base") == "", none).otherwise(
        F.transform(F.split("base", ","), lambda s: F.struct(part(s, 2).cast("long").alias("start"), number[part(s, 1)].alias("kind"), part(s, 3).cast("long").alias("end")))
    )
    names = F.array(*map(F.lit, SPAN_KINDS))
    every = F.sort_array(F.concat(base, "secrets", F.coalesce("more", none)))
    told = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    added = F.col("more").isNotNull() | (F.size("secrets") > 0)
    return found.join(extra, kept, "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(added, told).otherwise(F.col("base")).alias("spans"))


#: Rows of new spans up to which redaction sends them to every task; more are joined by a shuffle.
FEW = 100_000


def redact(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``column`` replaced by its kind in brackets; same columns.

    ``docs`` needs doc_id and text; other columns pass through whatever their names.
    """
    narrow = docs.select("doc_id", "text")
    _, new = extract(narrow, **options)
    extra = written(new.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
    few = extra.count() <= FEW
    extra = extra.withColumnsRenamed({"doc_id": "m_doc_id", "text_hash": "m_text_hash"})
    held = docs.select(F.struct("*").alias("held"))
    on = F.col("held.doc_id").eqNullSafe(F.col("m_doc_id")) & (F.xxhash64("held.text") == F.col("m_text_hash"))
    joined = held.join(F.broadcast(extra) if few else extra, on, "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, added in zip(texts, more, strict=True):
            if not text:
                out.append(text)
                continue
            spans = seed_spans(text)
            if added is not None:
                spans = sorted([*spans, *((int(x["start"]), int(x["kind"]), int(x["end"])) for x in added)])
            parts, at = [], 0
            for a, kind, b in spans:
                if a >= at:
                    parts += [text[at:a], f"[{SPAN_KINDS[kind].upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if spans else text)
        return pd.Series(out, dtype=object)

    cleaned = joined.select("held", clean(F.col("held.text"), F.col("more")).alias("clean"))
    return cleaned.select(*[(F.col("clean") if c == column else F.col(f"held.`{c}`")).alias(c) for c in docs.columns])
