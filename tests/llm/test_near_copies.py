"""Near copies against all pairs by brute force."""

import itertools
import random
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from frames import ODD, docs
from pyspark.sql import functions as F
from test_simhash import joined

import corpus_pipeline as pipeline
from minutewise.llm import near_copies

DATA = Path("/root/testdata/sf0.001")


def slow_set(text, n=5):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1)))


def slow_kept(rows):
    sets = {i: slow_set(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    root = joined(near, set(sets))
    return {min(i for i in sets if root[i] == r) for r in {root[i] for i in sets}}


def edited(words, rng, n):
    words = words.copy()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return words


def corpus():
    rng = random.Random(5)
    out, ids = [], itertools.count()
    for k in range(40):  # copies with some words changed, around the bound on both sides
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 100, 200, 500]))]
        out += [words, edited(words, rng, 1), edited(words, rng, len(words) // 50), edited(words, rng, len(words) // 25)]
    form = [f"f{k}" for k in range(70)]
    for k in range(120):  # one form, filled in anew each time: not similar enough, but in the same bands; some have a copy
        out.append(form + [f"own{rng.random()}" for _ in range(15 + k % 25)])
        if k % 10 == 0:
            out.append(edited(out[-1], rng, 1))
    return [(next(ids), " ".join(words)) for words in out]


@pytest.mark.parametrize("crowded", [48, 3])
def test_groups_by_similarity(spark, crowded):
    rows = corpus()
    got = near_copies.one_of_each(docs(spark, rows), near_copies.NearCopyParams(crowded=crowded))
    assert sorted(r.doc_id for r in got.collect()) == sorted(slow_kept(rows))


def test_fingerprints_bring_candidates_and_sets_decide(spark):
    one_band = near_copies.NearCopyParams(bands=1, rows=3000)  # so strict that no band is shared
    rng = random.Random(11)
    words = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    prints = near_copies.SimhashParams(words=one_band.words)
    mark = near_copies.fingerprint_of(" ".join(words), prints)
    tries = (edited(words, rng, 1) for _ in range(100))
    close = next(w for w in tries if 1 <= (near_copies.fingerprint_of(" ".join(w), prints) ^ mark).bit_count() <= 2)
    ring = ["a", "b", "c", "d", "e"]  # the same shingles oftener: one fingerprint, but a Jaccard index of a half
    rows = [(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(ring * 21)), (4, " ".join(ring * 41))]
    assert len({near_copies.fingerprint_of(t, prints) for _, t in rows[2:]}) == 1
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs(spark, rows), one_band).collect()) == sorted(slow_kept(rows)) == [1, 3, 4]


def test_marks_never_differ_more_than_the_sets():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 3, 40, 400]))) for _ in range(30)]
    texts += [" ".join(edited(t.split(), rng, 2)) for t in texts if len(t) > 40]
    hashes, sizes = near_copies.shingles(pa.array(texts, pa.large_string()))
    marks, ends = near_copies.marked(hashes, sizes), sizes.cumsum()
    sets = [set(hashes[e - n : e].tolist()) for e, n in zip(ends, sizes)]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert sum(int(x).bit_count() for x in marks[a] ^ marks[b]) <= len(sets[a] ^ sets[b])


def test_families_not_alike_enough_make_no_pairs(spark):
    form = [f"f{k}" for k in range(70)]
    family = [form + [f"own{k}-{j}" for j in range(15)] for k in range(60)]
    texts = docs(spark, [(k, " ".join(words)) for k, words in enumerate([*family, [*family[0], "more"]])])
    params = near_copies.NearCopyParams()
    sketch = texts.select(near_copies.sketched(F.col("text")).alias("s"), near_copies.shingle_sets(F.col("text")).alias("shingles"))
    nodes = near_copies.saved(sketch.select("s.*", "shingles").withColumn("label", F.col("fp")))
    pairs = near_copies._rare_pairs(nodes, params)
    assert pairs.distinct().count() == 1
    assert pairs.count() <= 20


def test_odd_documents(spark):
    got = near_copies.one_of_each(docs(spark, ODD)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 4, 7, 8, 9, 11, 12, 13]
    assert near_copies.one_of_each(docs(spark, [])).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stage_on_documents(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = pipeline.without_near_duplicates(spark, pipeline.read(spark, str(DATA), "documents"), str(DATA))
    assert sorted(r.doc_id for r in got.collect()) == sorted(slow_kept(rows))
