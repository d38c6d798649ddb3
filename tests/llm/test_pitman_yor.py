"""Counts and base scores against brute force; the model is a distribution and beats the base on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from frames import ODD, docs, prose
from pyspark.sql import functions as F

from minutewise.llm import pitman_yor as py
from minutewise.llm.common import held_out

SMALL = py.PitmanYorParams(batch_tokens=700, least_parts=5)


def words(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b""]


def scored(spark, rows, params=SMALL):
    frame = docs(spark, rows, extra=False).withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    return py.score(frame.repartition(3), params).collect()


def corpus():
    return [*ODD, *((k, prose(k % 17, 25 + k % 30)) for k in range(100, 220))]


def test_counts_and_scores(spark):
    rows = corpus()
    got = scored(spark, rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        own = [count[w] for w in words(t)]
        want.append((i is None, i or 0, held(i), len(own), sum(c > 0 for c in own), n, round(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own), 6)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    apart = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert all(r.score <= 0 for r in got)
    # The same draws whatever the batches and tasks.
    again = scored(spark, rows, py.PitmanYorParams(batch_tokens=100_000, least_parts=5))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in again) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def test_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    (row,) = scored(spark, [(None, "a b")])
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score, row.base_score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    """Every word seen, and one never seen, asked in one context: the probabilities make one."""
    rows = [(k, t) for k, t in corpus() if k and zlib.crc32(str(k).encode()) % 5 != 1]
    vocabulary = sorted({w for _, t in rows for w in words(t)})
    hashed, context, _ = py.tokens_of(pa.array([t or "" for _, t in rows], pa.large_string()))
    every = np.array([py.xxhash.xxh64_intdigest(w) for w in vocabulary] + [12345], dtype=np.uint64)
    parts = 4
    columns = [(hashed, context, np.array([len(hashed)]))]
    asked = [(every, np.full(len(every), c, dtype=np.uint16), np.array([len(every)])) for c in (context[5], context[77], 3)]
    schema = "batch long, part int, pairs binary"
    packs = py._counted(0, [1], [False], columns, parts)
    for k, a in enumerate(asked):
        packs += py._counted(k + 1, [k], [True], [a], parts)
    counted = spark.createDataFrame([(r["batch"], r["part"], r.get("pairs")) for r in packs], schema)
    state = py.join_parts(counted)
    totals = py.totals_of(state)
    assert totals.n_words == len(vocabulary) and totals.n_tokens == len(hashed)
    told = py.answers(counted, totals, *py.tables_of(state, totals, SMALL), SMALL).where("batch > 0").collect()
    sums = Counter()
    for r in told:
        sums[r.batch] += (10.0 ** py.unpacked(r.answers)[0].astype(float)).sum()
    assert all(abs(s - 1) < 1e-5 for s in sums.values()) and len(sums) == 3


def test_tables_keep_their_customers():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 30, 200)
    tables = py.Tables(counts, 0.6, rng)
    dishes = np.flatnonzero(counts > 0)
    for _ in range(50):
        tables.remove(dishes)
        tables.add(dishes, np.full(len(dishes), 2.0))
    assert (tables.customers == counts).all() and tables.sizes.sum() == counts.sum() and (tables.sizes > 0).all()
    sums = np.add.reduceat(tables.sizes, (np.cumsum(tables.number) - tables.number)[dishes])
    assert (sums == counts[dishes]).all() and (tables.number <= counts).all()
    few, more = np.flatnonzero(counts > 3), np.flatnonzero(counts < 20)
    tables.remove_many(few, np.full(len(few), 3))
    tables.add_many(more, 5 + more % 70, 2.0)
    counts = counts.copy()
    counts[few] -= 3
    counts[more] += 5 + more % 70
    assert (tables.customers == counts).all() and (tables.sizes > 0).all() and tables.number.sum() == len(tables.sizes)
    sums = np.add.reduceat(tables.sizes, (np.cumsum(tables.number) - tables.number)[counts > 0])
    assert (sums == counts[counts > 0]).all()
    # Many customers and a heavy new table: more tables than one, fewer than customers.
    assert 1 < tables.number[counts > 10].mean() < counts[counts > 10].mean()


def one_at_a_time(customers, discount, fresh, rounds, rng):
    """Mean number of tables of a dish, each customer taken out and seated anew in turn."""
    seats, seen = [0] * customers, []
    for turn in range(rounds):
        for c in range(customers):
            sizes = Counter(seats[:c] + seats[c + 1 :])
            tables = [*sizes]
            weights = np.array([*(sizes[t] - discount for t in tables), fresh])
            pick = rng.choice(len(weights), p=weights / weights.sum())
            seats[c] = tables[pick] if pick < len(tables) else max(tables, default=0) + 1
        if turn >= rounds // 5:
            seen.append(len(set(seats)))
    return np.mean(seen)


def test_a_round_against_an_exact_sampler():
    """Many equal dishes, reseated in blocks, have as many tables as a sampler of single customers gives."""
    rng = np.random.default_rng(4)
    for customers, fresh in ((2, 0.3), (6, 0.5), (15, 2.0), (60, 0.2), (60, 3.0)):
        tables = py.Tables(np.full(800, customers), 0.6, rng)
        seen = []
        for turn in range(14):
            tables.reseat(lambda opened: np.full(800, fresh))
            seen += [tables.number.mean()] * (turn >= 6)
        assert (tables.customers == customers).all() and tables.sizes.sum() == 800 * customers
        want = one_at_a_time(customers, 0.6, fresh, 1500 if customers < 20 else 300, rng)
        assert abs(np.mean(seen) - want) < 0.12 * want, (customers, fresh, np.mean(seen), want)


def test_packed_arrays():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.uint64), np.array([2**63, 1], dtype=np.uint64), np.zeros(0, np.uint32)]
    back = py.unpacked(py.packed(*arrays))
    assert [(a.dtype, a.tolist()) for a in back] == [(a.dtype, a.tolist()) for a in arrays]
