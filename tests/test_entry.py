import pathlib
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_core_stands_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessellar.llm.queries", None)
    assert "p1_found" in entry.queries() and "p5_found" not in entry.queries() and "p5_found" not in entry.oracle_sql()


def test_core_never_imports_the_subpackage():
    root = pathlib.Path(entry.__file__).parent / "tessellar"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tessellar.llm" not in f.read_text(), f


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "sections", "rrf_fuse", "coverage_report", "mor_weights", "pack_sentences", "orchestrate_union"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pool_candidates", "final_results", "keywords_excel", "store_files", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[x[0] for x in cur.description])
    got = entry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    key = lambda df: sorted(repr(tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "item") else x for x in r)) for r in df.itertuples(index=False))
    assert key(got) == key(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams_are_as_batches(spark, tmp_path):
    from tessellar.streaming import events as E

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    live = E.run_now(spark, E.windows(E.read_events(spark, DATA)))
    assert live.agg({"n": "sum"}).first()[0] == batch.count()
