import pytest

import planeweave.operators  # noqa: F401
from planeweave.plans.graph import Graph, GraphError
from planeweave.streaming.frames import over_stream


def test_point_graphs_run_on_streams(spark, tmp_path):
    shape = "img string, y int, x int, r double, g double, b double, a double"
    spark.createDataFrame([("i", 0, x, x / 4, 0.5, 0.25, 1.0) for x in range(4)], shape).write.parquet(str(tmp_path / "in"))
    g = Graph()
    a, b, c = g.add("io.image_input"), g.add("color.invert"), g.add("io.output")
    g.connect(a, 0, b, 0)
    g.connect(b, 0, c, 0)
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    query = over_stream(g, stream, 4, 1).writeStream.format("memory").queryName("inverted").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.r for r in spark.table("inverted").collect()) == [0.25, 0.5, 0.75, 1.0]
    g.swap(b.id, "filter.blur")
    with pytest.raises(GraphError):
        over_stream(g, stream, 4, 1)
