"""A sample of registered queries against their SQL; the driver compares all of them."""

import duckdb
import pytest

from planeweave import catalogue

TABLES = "events documents embeddings labels benchmark".split()
SAMPLE = ["flagship", "blend_overlay", "math_modulo", "expression_shapes", "normalize_10_90", "filter_sobel", "kuwahara", "displace", "histogram", "chroma_key", "photos_names", "photos_duplicates", "plan_region"]


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def ordered(rows):
    held = [tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(held, key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, sf_dir, other, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    told = other.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in told.description].index(c) for c in cols]
    assert ordered([tuple(r[c] for c in cols) for r in df.collect()]) == ordered([tuple(r[i] for i in at) for r in told.fetchall()])


def test_entry_has_every_query_once():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and set(catalogue.QUERIES) <= set(found)
