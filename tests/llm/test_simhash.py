"""Fingerprints and groups against brute force, with crowded blocks as well."""

import itertools
import random
import re

import xxhash
from frames import ODD, docs

from minutewise.llm import simhash
from minutewise.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_groups_of_odd_documents(spark):
    got = simhash.groups(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    prints = {(i, t): slow_fingerprint(t) for i, t in ODD}
    assert sorted((r.fp & (1 << 64) - 1) for r in got) == sorted(prints[d] for d in ODD)
    near = [(a, b) for a, b in itertools.combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 2]
    root = joined(near, set(prints.values()))
    for r in got:
        here = [i for i, t in ODD if i is not None and root[prints[i, t]] == root[r.fp & (1 << 64) - 1]]
        assert r.component_id == (min(here) if here else None)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_no_group(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for centre in rng.sample(sorted(prints), 6):  # chains and crowds about some of them
        for _ in range(40):
            centre_or_near = centre ^ (1 << rng.randrange(64))
            prints.add(centre_or_near ^ (1 << rng.randrange(64)))
        for step in range(5):
            centre ^= 3 << (step * 9 % 60)
            prints.add(centre)
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 2]
    want = joined(near, prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for crowded in (48, 3):
        links = simhash.links(frame, simhash.SimhashParams(crowded=crowded)).collect()
        mask = (1 << 64) - 1
        assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in links)
        assert joined([(a & mask, b & mask) for a, b in links], prints) == want
    assert len(simhash.block_masks()) == 10


def test_components_of_a_long_chain(spark):
    frame = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    assert got == {k: 0 for k in range(41)} | {101: 101, 102: 101}


def test_one_of_each_keeps_columns_and_null_ids(spark):
    kept = simhash.one_of_each(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    # 1-3 are alike (case aside), 4-6 and the null text are empty, 11 stands there twice.
    ids = sorted(i for i, _ in rows if i is not None)
    assert ids.count(11) == 1 and {1, 4, 7, 8, 9, 11, 12, 13} <= set(ids) and not {2, 3, 5, 6} & set(ids)
    assert [t for i, t in rows if i is None] == [ODD[9][1]]
    assert simhash.one_of_each(docs(spark, [])).collect() == []
