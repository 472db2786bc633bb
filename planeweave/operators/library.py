"""The photo catalogue: filters, search, sorting, stacks, collections, duplicates and names."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.plans.lineage import cut

FILTERS = {
    "all": lambda: F.lit(True), "picked": lambda: F.col("flag") == 1, "not rejected": lambda: F.col("flag") >= 0, "rejected": lambda: F.col("flag") == -1, "edited": lambda: F.col("edited"),
    **{f"rating {n}": (lambda n=n: F.col("rating") >= n) for n in range(1, 6)}, **{f"label {n}": (lambda n=n: F.col("label") == n) for n in range(1, 6)}, "duplicates": lambda: F.col("group_id").isNotNull(),
}


def passes(photos: DataFrame, name: str) -> DataFrame:
    return photos.where(FILTERS[name]())


def search(photos: DataFrame, words: str, columns=("name", "title", "caption")) -> DataFrame:
    """Rows whose name, title, caption and keywords hold every word, whatever the case."""
    told = F.lower(F.concat_ws(" ", *columns, *(["keywords"] if "keywords" in photos.columns else [])))
    for w in words.lower().split():
        photos = photos.where(told.contains(w))
    return photos


def split_keywords(text: Column) -> Column:
    """Parts between commas and semicolons, trimmed, none of them empty."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda w: F.trim(w)), lambda w: w != "")


def has_keyword(keywords: Column, word: str) -> Column:
    return F.exists(keywords, lambda k: F.lower(k) == word.lower())


def add_keyword(keywords: Column, word: str) -> Column:
    return F.when(has_keyword(keywords, word), keywords).otherwise(F.array_append(keywords, F.lit(word)))


def remove_keyword(keywords: Column, word: str) -> Column:
    return F.filter(keywords, lambda k: F.lower(k) != word.lower())


def _text(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))


#: Keys that are made of other columns. Without a value they count as an empty text or 0, so only capture times that are missing come last.
SORT_KEYS = {
    "file_type": lambda: F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)), "camera": lambda: _text("make", "model"), "lens": lambda: _text("lens"),
    "iso": lambda: F.coalesce("iso", F.lit(0)), "focal_length": lambda: F.coalesce("focal_length", F.lit(0.0)), "edit_time": lambda: F.coalesce("edit_time", F.lit(0)),
}


def photo_order(key: str, descending: bool = False) -> list[Column]:
    """By a key; missing values last either way, ties by lower-cased name, then copy."""
    name, copy = F.lower("name"), F.col("copy")
    if key == "name":
        return [name.desc() if descending else name.asc(), copy.asc()]
    if key in SORT_KEYS:
        made = SORT_KEYS[key]()
        return [made.desc() if descending else made.asc(), name.asc(), copy.asc()]
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return [missing.asc(), F.col(key).desc() if descending else F.col(key).asc(), name.asc(), copy.asc()]


def sorted_photos(photos: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return photos.orderBy(*photo_order(key, descending))


def numbered(photos: DataFrame, order: list[Column]) -> DataFrame:
    """``photos`` with their 1-based place in an order; ranges are numbered apart and moved by the rows before them."""
    parts = int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(photos.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    # One row a range.
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("range").alias("b_range"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("nth", inside).join(F.broadcast(before), F.col("range") == F.col("b_range")).withColumn("place", F.col("before") + F.col("nth")).drop("range", "b_range", "before", "nth")


def collapsed(photos: DataFrame, order: str = "position", opened: tuple[str, ...] = ()) -> DataFrame:
    """Only the top photo of each stack, but all of opened ones and those without a stack, which don't move."""
    alone = F.col("stack").isNull() | F.col("stack").isin("", *opened)
    row = F.struct(*[F.col(c) for c in photos.columns])
    tops = photos.where(~alone).groupBy("stack").agg(F.min_by(row, F.struct(F.col(order), F.xxhash64(row))).alias("top"))
    return photos.where(alone).unionByName(tops.select("top.*"))


def entries(photos: DataFrame, copies: DataFrame) -> DataFrame:
    """Photos times their virtual copies, the original as copy 0."""
    own = photos.select("photo", "name", F.lit(0).alias("copy"))
    more = photos.select("photo", "name").join(copies.select("photo", "copy"), "photo").select("photo", "name", "copy")
    return own.union(more).distinct().orderBy(F.lower("name"), "copy")


def add_to_collection(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the new ones, those that were added); repeats are left out."""
    keys = ["collection", "photo", "copy"]
    added = new.dropDuplicates(keys).join(members, keys, "left_anti")
    return members.unionByName(added), added


#: What a row that is sent counts, in pairs that are looked at.
SENT = 20


def _near_keys(varying: int, bits: int, rows: int) -> list[tuple[int, list[int]]]:
    """(mask, patterns) of bands of a hash, such that hashes of at most ``bits`` differing bits differ in one band by a pattern.

    Only bits that vary count, dealt to the bands in turn. Fewer bands are longer, but may differ in more bits: as many
    are taken as leave least rows to send and pairs to look at.
    """
    places = [k for k in range(64) if varying >> k & 1]

    def cost(bands: int) -> float:
        dealt = [len(places[n::bands]) for n in range(bands)]
        found = [sum(math.comb(size, k) for k in range(bits // bands + 1)) for size in dealt]
        return rows * sum(found) * SENT + 2.0 * rows * rows * sum(f / 2.0**size for f, size in zip(found, dealt, strict=True))

    bands = min(range(1, bits + 2), key=cost)
    dealt = [[1 << k for k in places[n::bands]] for n in range(bands)]
    return [(sum(one), [sum(c) for k in range(bits // bands + 1) for c in itertools.combinations(one, k)]) for one in dealt]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def duplicate_pairs(hashes: DataFrame, bits: int = 4, aspect: float = 0.02) -> DataFrame:
    """(a, b), a < b: equal files, or alike pictures (also turned) of alike aspects.

    ``hashes``: idx, file_hash, picture_hash, aspect, rotated (hashes of the quarter turns; the odd
    ones invert the aspect). Rows of one file, and rows of one picture, are linked to the first of
    them, not to each other; the banded join takes distinct pictures only. Its bands are made from the
    bits that vary: a fixed band of equal bits would join all with all. What grows with the pictures is
    merged, not broadcast: Spark's estimate leaves out that a picture is sent once for each pattern.
    """
    files = hashes.where("file_hash != 0").groupBy("file_hash").agg(F.min("idx").alias("first"))
    same = hashes.join(files.hint("merge"), "file_hash").where(F.col("idx") != F.col("first")).select(F.col("first").alias("a"), F.col("idx").alias("b"))
    # Of rows with one picture hash, aspect and turned hashes the first stands for all.
    lone = hashes.where("picture_hash != 0").groupBy("picture_hash", "aspect", "rotated").agg(F.min("idx").alias("idx"))
    told = F.struct("picture_hash", "aspect", "rotated")
    alike = hashes.join(lone.select(told.alias("key"), F.col("idx").alias("first")).hint("merge"), told.eqNullSafe(F.col("key"))).where(F.col("idx") != F.col("first"))
    same = same.union(alike.select(F.col("first").alias("a"), F.col("idx").alias("b")))
    turned = F.concat(F.array(F.struct(F.lit(0).alias("turn"), F.col("picture_hash").alias("q"))), F.transform(F.coalesce("rotated", F.array().cast("array<bigint>")), lambda h, n: F.struct((n + 1).alias("turn"), h.alias("q"))))
    right = lone.select(F.col("idx").alias("j"), F.col("aspect").alias("t"), F.inline(turned)).where("q != 0")
    told = right.agg(F.bit_or("q"), F.bit_and("q"), F.count(F.when(F.col("turn") == 0, 1))).first()
    if not told[2]:
        return same.distinct()
    keys = _near_keys((told[0] & ~told[1]) & (2**64 - 1), bits, told[2])
    left = lone.select(F.col("idx").alias("i"), F.col("picture_hash").alias("p"), F.col("aspect").alias("s"))
    right = right.select("j", "turn", F.when(F.col("turn") % 2 == 1, 1.0 / F.col("t")).otherwise(F.col("t")).alias("t"), "q")
    near, earlier = [], F.lit(True)
    for mask, patterns in keys:
        held = F.lit(_signed(mask))
        differing = F.split(F.lit(",".join(str(_signed(x)) for x in patterns)), ",").cast("array<bigint>")
        probes = left.withColumn("differs", F.explode(differing)).withColumn("key", F.col("p").bitwiseAND(held).bitwiseXOR(F.col("differs"))).drop("differs")
        other = F.col("p").bitwiseXOR(F.col("q"))
        # A pair comes from its first band, and pairs that are not turned once.
        close = (F.bit_count(other) <= bits) & ((F.col("turn") > 0) & (F.col("i") != F.col("j")) | (F.col("i") < F.col("j"))) & (F.abs(F.col("s") - F.col("t")) <= aspect * F.greatest("s", "t"))
        near.append(probes.hint("merge").join(right.withColumn("key", F.col("q").bitwiseAND(held)), "key").where(close & earlier).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
        earlier = earlier & (F.bit_count(other.bitwiseAND(held)) > bits // len(keys))
    return functools.reduce(DataFrame.union, near, same).distinct()


def grouped(pairs: DataFrame) -> DataFrame:
    """(idx, group_id): group_id is the smallest index that can be reached; labels hop over labels until none moves."""
    edges = cut(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("idx")).agg(F.least("idx", F.min("b")).alias("group_id")))
    while True:
        near = edges.join(labels, edges["b"] == labels["idx"]).groupBy(F.col("a").alias("n")).agg(F.min("group_id").alias("m"))
        moved = labels.join(near, F.col("idx") == F.col("n")).select("idx", F.least("group_id", "m").alias("g"))
        hop = moved.select(F.col("idx").alias("h"), F.col("g").alias("hg"))
        new = cut(moved.join(hop, F.col("g") == F.col("h")).select("idx", F.least("g", "hg").alias("group_id")))
        changed = new.withColumnRenamed("group_id", "now").join(labels, "idx").where(F.col("now") != F.col("group_id"))
        labels = new
        if changed.isEmpty():
            return labels


def file_name(template: str) -> Column:
    """A name by tokens {name} {folder} {copy} {date} {time} {year} {month} {day} {camera} {seq:n}; unsafe characters become _.

    Needs name, folder, copy, capture_time (YYYY:MM:DD HH:MM:SS), camera and seq; what is missing is empty.
    """
    when = F.try_to_timestamp("capture_time", F.lit("yyyy:MM:dd HH:mm:ss"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    tokens = {
        "name": stem, "folder": F.col("folder"), "copy": F.when(F.col("copy") > 0, F.col("copy").cast("string")), "camera": F.col("camera"), "date": F.date_format(when, "yyyy-MM-dd"),
        "time": F.date_format(when, "HHmmss"), "year": F.date_format(when, "yyyy"), "month": F.date_format(when, "MM"), "day": F.date_format(when, "dd"),
    }
    parts, rest = [], template
    while rest:
        before, brace, rest = rest.partition("{")
        parts.append(F.lit(before))
        if not brace:
            break
        token, closed, after = rest.partition("}")
        kind, _, digits = token.partition(":")
        if closed and kind == "seq":
            parts.append(F.lpad(F.col("seq").cast("string"), max(int(digits or 1), 1), "0") if digits else F.col("seq").cast("string"))
        else:
            parts.append(tokens.get(token, F.lit("{" + token + closed)))
        rest = after
    return F.regexp_replace(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), r'[\\/:*?"<>|\x00-\x1F]', "_")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Later rows of a name get " (2)", " (3)" and so on, whatever the case."""
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    return df.withColumn("nth", nth).withColumn(name, F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("nth").cast("string"), F.lit(")")))).drop("nth")


LABELS = ("", "Red", "Yellow", "Green", "Blue", "Purple")


def _escaped(text: Column) -> Column:
    for raw, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(told))
    return text


def xmp_packet() -> Column:
    """Rating (-1: rejected), label, title, caption and keywords as an XMP description."""
    rating = F.when(F.col("flag") == -1, -1).otherwise(F.col("rating")).cast("string")
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("label") + 1)
    words = F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("<rdf:li>"), _escaped(k), F.lit("</rdf:li>"))), "")
    alt = lambda tag, c: F.when(F.col(c) != "", F.concat(F.lit(f'<dc:{tag}><rdf:Alt><rdf:li xml:lang="x-default">'), _escaped(F.col(c)), F.lit(f"</rdf:li></rdf:Alt></dc:{tag}>"))).otherwise("")
    return F.concat(
        F.lit('<rdf:Description xmp:Rating="'), rating, F.lit('"'), F.when(label != "", F.concat(F.lit(' xmp:Label="'), label, F.lit('"'))).otherwise(""), F.lit(">"), alt("title", "title"), alt("description", "caption"),
        F.when(F.size("keywords") > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), words, F.lit("</rdf:Bag></dc:subject>"))).otherwise(""), F.lit("</rdf:Description>"),
    )
