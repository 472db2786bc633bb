"""Fill-in-the-middle training texts, cut at token boundaries by bit-parallel integers.

A text's UTF-8 bytes become masks of classes: ``bytes.translate`` maps each byte to 0 or 1, and the
digits are one big integer with a bit per byte. A token starts at the first byte and wherever white
space follows a byte that is none, so one shift and two boolean operations mark all starts, bit_count
tells how many there are, and a start of given rank is found by halving the integer, counting the
bits of one half and going on in the half that holds it. White space is ASCII, so every cut also lies
between characters.

Which texts are transformed, how and where comes from the SHA-256 of seed and doc_id: results don't
depend on partitions, order or reruns.

Defined results: a null text is an empty one, which stays plain; a null doc_id counts as an empty
string; texts that hold a sentinel stay plain; rows that repeat give equal rows; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SPACES = b"\t\n\x0b\x0c\r "


def _digits(members) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


_IS_SPACE, _IS_LEAD = _digits(_SPACES), _digits({b for b in range(256) if b & 0xC0 != 0x80})


def mask(text: bytes, table: bytes) -> int:
    """A bit for each byte, the last byte's the lowest, set where the table says so."""
    return int(text.translate(table), 2) if text else 0


def token_starts(text: bytes) -> int:
    """The first byte, and white space behind a byte that is none; bits as in ``mask``."""
    if not text:
        return 0
    space = mask(text, _IS_SPACE)
    first = 1 << (len(text) - 1)
    return first | (space & ~(space >> 1) & (first - 1))


def ranked_bit(bits: int, width: int, rank: int) -> int:
    """How many of the ``width`` bits stand above the set bit of ``rank`` (from 0, highest first)."""
    above = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        n = high.bit_count()
        if rank < n:
            bits, width = high, width - low
        else:
            bits, rank, above, width = bits & ((1 << low) - 1), rank - n, above + width - low, low
    return above


def cut_at(text: bytes, starts: int, n: int, units: int) -> int:
    """Bytes of the first ``units`` of ``n`` tokens."""
    return len(text) if units >= n else ranked_bit(starts, len(text), units)


def transform(text: bytes, named: bytes, seed: int, rate: int, spm: int) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, number of tokens and, unless plain, the characters of prefix and middle."""
    starts = token_starts(text)
    n = starts.bit_count()
    told = hashlib.sha256(b"%d:%s" % (seed, named)).hexdigest()
    h1, h2, h3, h4 = (int(told[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", n, None, None
    a, b = (cut_at(text, starts, n, units) for units in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    lead = mask(text, _IS_LEAD)
    upto_a, upto_b = ((lead >> (len(text) - x)).bit_count() for x in (a, b))
    if h4 % 100 < spm:
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, "spm", n, upto_a, upto_b - upto_a
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, "psm", n, upto_a, upto_b - upto_a


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, one row per row of ``docs``.

    ``rate`` percent of texts are transformed, ``spm`` percent of these with the suffix first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [transform(t or b"", i.encode(), seed, rate, spm) for t, i in zip(batch["text"], batch["named"], strict=True)]
            out = pd.DataFrame(rows, columns=["output", "form", "n", "prefix_chars", "middle_chars"], dtype=object)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("named"), F.col("text").cast("binary").alias("text"))
    made = read.mapInPandas(run, f"doc_id {kind}, output binary, form string, n long, prefix_chars long, middle_chars long")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def between(given: Column, first: bytes, second: bytes) -> tuple[Column, Column]:
        """What stands before ``second``, behind the sentinel ``first`` at the start, and what behind it."""
        rest = F.substring(given, len(first) + 1, 2**31 - 1)
        head = F.substring_index(rest, second.decode(), 1)
        return head, F.substring(rest, F.length(head) + 1, F.lit(2**31 - 1))

    prefix, rest = between(output, PREFIX, SUFFIX)
    suffix, rest = between(rest, SUFFIX, MIDDLE)
    psm = F.concat(prefix, F.substring(rest, len(MIDDLE) + 1, 2**31 - 1), suffix)
    suffix, rest = between(output, SUFFIX, PREFIX)
    prefix, rest = between(rest, PREFIX, MIDDLE)
    spm = F.concat(prefix, F.substring(rest, len(MIDDLE) + 1, 2**31 - 1), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """The transformation with its output, and the text restored from it, as SHA-256."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
