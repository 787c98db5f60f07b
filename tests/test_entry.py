import ast
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["peaks_parabolic", "compare_events", "proximity_join", "window_bounds", "tz_fallback", "solar_events", "leader_groups", "name_parts"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert rows(got) == rows(want)


def test_nothing_else_imports_the_text_operators():
    top = os.path.join(os.path.dirname(__spark_entry__.__file__), "marigraph")
    for folder, _, files in os.walk(top):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    for node in ast.walk(ast.parse(source.read())):
                        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
                        assert not any("llm" in n for n in names)
