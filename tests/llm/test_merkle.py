"""Merkle manifest against trees built by hand, on ragged trees of every small size."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from frames import ODD, docs
from pyspark.sql import functions as F

from minutewise.llm import merkle
from minutewise.llm.merkle import MerkleParams


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, k):
    """The root, and of each node its siblings on the way up with the place among them."""
    paths, now = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(now) > 1:
        above = []
        for a in range(0, len(now), k):
            run = now[a : a + k]
            for place, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(n for n, _ in run[:place]), "".join(n for n, _ in run[place + 1 :])))
            above.append((h(*(n for n, _ in run)), [i for _, below in run for i in below]))
        now = above
    return now[0][0], paths


def slow(rows, k=3):
    """Sorted rows (doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0], slow_leaf(row)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([leaf for *_, leaf in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))], k) for s in names}
    root, tops = tree([built[s][0] for s in names], k) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for (_, doc_id, leaf), path in zip(sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2])), built[s][1]):
            out.append((doc_id, leaf, built[s][0], root, path + top))
    return sorted(map(repr, out))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({"tree": F.lit("t"), "hash": F.lit("h"), "block": F.lit(1), "leaf": F.lit("l"), "row": F.lit(2)})


def got(df):
    return sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof])) for r in df.collect())


@pytest.mark.parametrize("params", [MerkleParams(), MerkleParams(3, 1), MerkleParams(2, 2), MerkleParams(3, 0)])
def test_trees_of_many_sizes(spark, params):
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 13, 19, 26, 28, 40]
    rows = [(i, f"s{n}", "en", i, f"text {i}") for n in sizes for i in range(n)]
    found = merkle.manifest(frame(spark, rows), params=params)
    assert got(found) == slow(rows, params.fanout)
    assert found.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_odd_rows(spark):
    rows = [(i, s, None, None, t) for (i, t), s in zip(ODD, [None, "", "é", "z", "a"] * 3)] + [(None, None, "x", 1, "x")] * 5
    for params in (MerkleParams(), MerkleParams(3, 1)):
        assert got(merkle.manifest(frame(spark, rows), params=params)) == slow(rows)
    assert merkle.manifest(frame(spark, [])).collect() == []
    one = merkle.manifest(frame(spark, rows[:1])).first()
    assert (one.leaf, one.subroot, one.proof) == (one.root, one.root, [])


def test_tampering_shows(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", 5, f"a\nb{i}" if i % 4 else "ab") for i in range(40)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(path))
    want = {i: not (zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in t) for i, *_, t in rows}
    found = merkle.op13_merkle(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.verified for r in found} == want and 0 < sum(want.values()) < 40
    assert all((r.folded_root == r.root) == r.verified for r in found)
    assert {r.proof_sha256 for r in found} == {h(*(a + b for a, b in eval(x)[4])) for x in slow(rows)}  # noqa: S307
