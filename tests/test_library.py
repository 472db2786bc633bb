from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from planeweave.operators import library


def test_keywords(spark):
    df = spark.createDataFrame([("a, b ;c,, ",)], "k string").select(library.split_keywords(F.col("k")).alias("k"))
    assert df.first().k == ["a", "b", "c"]
    got = df.select(library.add_keyword(F.col("k"), "B").alias("same"), library.add_keyword(F.col("k"), "d").alias("more"), library.remove_keyword(F.col("k"), "A").alias("less")).first()
    assert (got.same, got.more, got.less) == (["a", "b", "c"], ["a", "b", "c", "d"], ["b", "c"])


def test_search_needs_every_word(spark):
    df = spark.createDataFrame([("IMG_0042.jpg", "Harbour", "boats", ["evening"])], "name string, title string, caption string, keywords array<string>")
    assert library.search(df, "boats img_0042").count() == 1
    assert library.search(df, "Boats EVENING").count() == 1
    assert library.search(df, "boats sunset").count() == 0


def test_missing_times_sort_last_either_way(spark):
    df = spark.createDataFrame([("b", 0, "2024:01:02 00:00:00"), ("a", 0, None), ("C", 0, "2024:01:01 00:00:00"), ("c", 1, "2024:01:01 00:00:00")], "name string, copy int, capture_time string")
    assert [r.name for r in library.sorted_photos(df, "capture_time").collect()] == ["C", "c", "b", "a"]
    assert [r.name for r in library.sorted_photos(df, "capture_time", True).collect()] == ["b", "C", "c", "a"]
    assert [r.name for r in library.sorted_photos(df, "name", True).collect()] == ["C", "c", "b", "a"]


def test_collections_take_no_repeats(spark):
    shape = "collection string, photo string, copy int"
    none = spark.createDataFrame([], shape)
    one, added = library.add_to_collection(none, spark.createDataFrame([("c", "a", 0), ("c", "b", 0)], shape))
    assert added.count() == 2
    two, added = library.add_to_collection(one, spark.createDataFrame([("c", "b", 0), ("c", "b", 1)], shape))
    assert (added.count(), two.count()) == (1, 3)


def test_duplicate_groups_equal_all_pairs(spark):
    g = np.random.default_rng(5)
    rows = []
    for i in range(120):
        if rows and g.random() < 0.5:
            base = rows[int(g.integers(len(rows)))]
            h = base[2]
            for b in g.integers(0, 64, int(g.integers(0, 7))):
                h ^= 1 << int(b)
            rows.append((i, base[1] if g.random() < 0.3 else i + 1, h, base[3] * (1.0 if g.random() < 0.8 else 1.3)))
        else:
            rows.append((i, i + 1, int(g.integers(1, 2**63)), 1.5))
    signed = [(i, f, int(np.uint64(h).view(np.int64)), a, []) for i, f, h, a in rows]
    df = spark.createDataFrame(signed, "idx long, file_hash long, picture_hash long, aspect double, rotated array<bigint>")
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, f, h, a), (j, k, p, b) in combinations(rows, 2):
        if f == k or (bin(h ^ p).count("1") <= 4 and abs(a - b) <= 0.02 * max(a, b)):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    want = {i: min(m) for m in groups.values() if len(m) > 1 for i in m}
    assert {r.idx: r.group_id for r in library.grouped(library.duplicate_pairs(df)).collect()} == want


def test_names(spark):
    df = spark.createDataFrame([("a.b.jpg", "x/y", 1, "2024:03:09 10:20:30", "Cam:1", 7)], "name string, folder string, copy int, capture_time string, camera string, seq int")
    assert df.select(library.file_name("{name}_{date}_{time}_{camera}_{seq:4}_{copy}_{what}").alias("n")).first().n == "a.b_2024-03-09_102030_Cam_1_0007_1_{what}"
    many = spark.createDataFrame([("p", 1), ("P", 2), ("q", 3), ("p", 4)], "n string, i int")
    assert {r.i: r.n for r in library.unique_names(many, "n", "i").collect()} == {1: "p", 2: "P (2)", 3: "q", 4: "p (3)"}


def test_packet_is_escaped(spark):
    df = spark.createDataFrame([(3, -1, 2, 'A & "B"', "", ["<k>"])], "rating int, flag int, label int, title string, caption string, keywords array<string>")
    told = df.select(library.xmp_packet().alias("x")).first().x
    assert 'xmp:Rating="-1"' in told and "A &amp; &quot;B&quot;" in told and "&lt;k&gt;" in told and 'xmp:Label="Yellow"' in told


def test_the_catalogue_holds_whole_captions(spark, sf_dir):
    from planeweave import catalogue

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = ("en", "src1", "the")
    want = set()
    for r in docs.collect():
        name = f"IMG_{r.doc_id:06d}.jpg"
        told = " ".join(x for x in (name, r.lang, r.text, r.source) if x is not None).lower()
        if all(w in told for w in words):
            want.add(r.doc_id)
    assert {r.photo for r in catalogue.QUERIES["photos_search"](spark, sf_dir).collect()} == want
