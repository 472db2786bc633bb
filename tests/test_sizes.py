"""Queries against their SQL on events that the sampled tables lack: bright values and other sizes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from planeweave import catalogue
from planeweave.operators import geometry, library
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.sources.tables import pixel_table

from .test_queries import ordered


@pytest.fixture(scope="module")
def events_of(spark, tmp_path_factory):
    """A folder with an events table of n rows; every seventh value is above 500, a red over 1."""

    def make(n):
        folder = tmp_path_factory.mktemp("events")
        k = F.col("id")
        value = F.when(k % 7 == 0, 500.0 + k % 90).otherwise((k * 37 % 480).cast("double"))
        props = F.concat(F.lit('{"k": '), (k * 13 % 100).cast("string"), F.lit("}"))
        rows = spark.range(n).select(k.alias("event_id"), F.timestamp_seconds(1704067200 + k * 977).cast("timestamp_ntz").alias("ts"), value.alias("value"), props.alias("props"))
        rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
        return str(folder)

    return make


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    told = con.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in told.description].index(c) for c in cols]
    return ordered([tuple(r[c] for c in cols) for r in df.collect()]) == ordered([tuple(r[i] for i in at) for r in told.fetchall()])


@pytest.mark.parametrize("name", ["alpha_over", "blend_add", "blend_color_burn", "blend_difference", "blend_divide", "blend_exclusion", "blend_lighten", "blend_linear_light", "blend_mix", "blend_multiply", "blend_overlay", "switch"])
def test_turned_picture_keeps_its_highlights(spark, events_of, name):
    assert same(spark, events_of(300), name)


@pytest.mark.parametrize("name", ["border", "border_aspect"])
def test_border_of_an_unfinished_line_is_made_by_many_tasks(spark, events_of, monkeypatch, name):
    monkeypatch.setattr(geometry, "CELLS", 500, raising=False)
    folder = events_of(1234)
    assert same(spark, folder, name)
    assert catalogue.QUERIES[name](spark, folder).select(F.spark_partition_id()).distinct().count() > 4


def test_canvas_of_a_tall_picture_is_whole():
    assert geometry.canvas_of(100, 60000, 3.0, 2.0, 1.5) == (97200, 64800, 48550, 1800)


@pytest.mark.parametrize("name", ["border", "border_aspect"])
def test_places_of_a_canvas_are_counted_without_an_array_of_a_line(spark, events_of, name):
    """Each place costs little: none is taken from an array or dealt out, and a large canvas has no task for every few lines."""
    folder = events_of(1234)
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Repartition" not in plan and plan.count("Join") == 1
    assert same(spark, folder, name)
    rows = catalogue.QUERIES[name](spark, folder).collect()
    assert len({(r.y, r.x) for r in rows}) == len(rows)


def test_a_large_canvas_has_a_bounded_number_of_tasks(spark):
    one = spark.createDataFrame([("a",)], "img string")
    (part,) = geometry.places(one, (0, 0, 583_200, 388_800))
    told = part._jdf.queryExecution().optimizedPlan().toString()
    assert f"splits=Some({geometry.MOST_TASKS})" in told
    last = geometry.places(one, (7, 3, 9, 6))[0].orderBy("y", "x").collect()
    assert [tuple(r) for r in last] == [("a", y, x) for y in (3, 4, 5) for x in (7, 8)]


def test_border_of_several_images_of_their_own_colours(spark):
    cells = [(img, y, x, v, v, v, 1.0) for img, v in (("a", 0.2), ("b", 0.6)) for y in range(3) for x in range(4)]
    image = pixel_table(spark.createDataFrame(cells, "img string, y int, x int, r double, g double, b double, a double"), 4, 3)
    g = Graph()
    node, source = g.add("xform.border", params={"Size": 25.0, "Aspect": "1:1"}), g.add("io.image_input", params={"Color Space": 2})
    g.connect(source, 0, node, "Image")
    rows = Evaluator(g, Session(spark, {"events": image})).result(node.id).collect()
    w, h, left, top = geometry.canvas_of(4, 3, 25.0, 0.0, 1.0)
    want = {(img, y, x): v if left <= x < left + 4 and top <= y < top + 3 else 1.0 for img, v in (("a", 0.2), ("b", 0.6)) for y in range(h) for x in range(w)}
    assert {(r.img, r.y, r.x): r.r for r in rows} == want and len(rows) == len(want)


def test_no_window_is_summed_anew_for_every_row(spark, events_of):
    folder = events_of(1234)
    df = catalogue.QUERIES["double_edge_mask"](spark, folder)
    assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert same(spark, folder, "double_edge_mask")


def test_bands_of_a_hash_are_made_of_the_bits_that_vary(spark):
    """24 bits at odd places, as the vectors' hashes have: no band may be of bits that are always 0."""
    g = random.Random(3)
    spread = lambda v: sum((v >> k & 1) << (2 * k + 3) for k in range(24))
    told = [(i, 0, spread(g.getrandbits(24) | 1), 1.0, [0, spread(g.getrandbits(24) | 1)]) for i in range(300)]
    for rows in (300, 50_000, 10**7):
        keys = library._near_keys(spread(2**24 - 1), 4, rows)
        assert all(mask for mask, _ in keys) and sum(mask for mask, _ in keys) == spread(2**24 - 1)
    df = spark.createDataFrame(told, "idx long, file_hash long, picture_hash long, aspect double, rotated array<bigint>")
    near = lambda a, b: (a ^ b).bit_count() <= 4
    want = {(min(i, j), max(i, j)) for i, _, p, _, _ in told for j, _, q, _, (_, turn) in told if i != j and (near(p, q) or near(p, turn))}
    found = [tuple(r) for r in library.duplicate_pairs(df).collect()]
    assert set(found) == want and len(found) == len(want)


def test_pictures_sent_for_each_pattern_are_not_broadcast(spark):
    """Spark's estimate of what a picture is sent for leaves the patterns out, so a broadcast of it fills the driver."""
    told = [(i, i + 1, 8 * i + 8, 1.0, [0, 8 * i + 16]) for i in range(300)]
    df = spark.createDataFrame(told, "idx long, file_hash long, picture_hash long, aspect double, rotated array<bigint>")
    pairs = library.duplicate_pairs(df)
    rows = pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert len(rows) == len(set(rows)) > 0


def test_sun_beams_of_tiles_equal_sql_and_send_no_taps(spark, events_of, monkeypatch):
    folder = events_of(1234)
    assert same(spark, folder, "sun_beams")
    monkeypatch.setattr(geometry, "SMEARED", 300, raising=False)
    assert same(spark, folder, "sun_beams")
    plan = catalogue.QUERIES["sun_beams"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sequence" not in plan


@pytest.mark.parametrize("name", ["hdr_merge", "hdr_deghost"])
def test_exposures_that_lie_alike_are_read_once_and_joined_to_one_row_an_image(spark, events_of, name):
    folder = events_of(1234)
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and plan.count("Join") == 2
    if name in catalogue.ORACLE_SQL:
        assert same(spark, folder, name)


@pytest.mark.parametrize("name", ["blend_screen", "blend_soft_light", "layer_stack", "mix", "split_compare"])
def test_queries_that_share_the_turned_picture_keep_its_highlights(spark, events_of, name):
    assert same(spark, events_of(300), name)


@pytest.mark.parametrize("name", ["basic_clarity", "basic_dehaze", "basic_haze", "tone_equalizer_guided"])
def test_blurs_of_a_tall_picture_are_those_of_the_sql(spark, events_of, name):
    assert same(spark, events_of(12_345), name)


def test_without_a_given_edge_blurs_follow_the_pictures_own(spark, events_of):
    folder = events_of(20_000)
    rows = lambda **edge: ordered(map(tuple, catalogue.graph_query("color.basic", {"Clarity": 50.0}, **edge)(spark, folder).collect()))
    own = rows()
    assert own == rows(long_edge=200) != rows(long_edge=100)
