"""The corpus pipeline against its stages by brute force, on the smallest tables and on odd documents."""

import re
from pathlib import Path

import duckdb
import pytest
from frames import ODD
from test_containment import slow as slow_items
from test_near_copies import slow_kept

import __spark_entry__ as app
import corpus_pipeline as pipeline
from minutewise.llm import pii
from minutewise.llm.common import saved
from minutewise.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def brute(rows, items):
    """doc_id -> text after the first four stages, of documents that all have a letter."""
    stay = slow_kept(rows)
    kept = [(i, t) for i, t in rows if i in stay]
    bad = {d for d, _, _ in slow_items(kept, items)}
    out = {}
    for i, text in kept:
        if i not in bad:
            plain, added = pii.find(text)
            for a, b, kind in sorted(((a, b, k) for k in pii.KINDS for a, b in plain[k] + added[k]), reverse=True):
                text = text[:a] + f"[{kind}]" + text[b:]
            out[i] = text
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stages_on_documents(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    docs = pipeline.read(spark, str(DATA), "documents")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(DATA)))
        assert docs.columns == columns, name
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    want = brute([r for r in rows if re.search(r"[^\W\d_]", r[1])], items)
    assert got == {i: (t, len(t)) for i, t in want.items()}
    last = pipeline.STAGES[-1][1](spark, docs, str(DATA))
    tokens = last.collect()
    assert {r.doc_id for r in tokens} == set(want)
    assert all(len(r.ids) == r.n_tokens for r in tokens)


def test_stages_on_odd_documents(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, label string, key string, _fp long"
    rows = [(i, t, None if i == 8 else "en", None, None, "l", "k", 1) for i, t in ODD]
    spark.createDataFrame([(1, "a benchmark of its own words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for _, stage in pipeline.STAGES[:-1]:
            docs = saved(stage(spark, docs, str(tmp_path)))
            assert docs.columns == pipeline.COLUMNS
        kept = [r.doc_id for r in docs.collect()]
        assert set(kept) == ({1, 7, 8, 9, 11, 12, 13, None} if given else set()) and len(kept) == len(set(kept))


def test_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(k) for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(app.queries()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(DATA))
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(row[k] for k in order)) for row in cursor.fetchall())
