"""Exact duplicates against a dictionary of texts, with fingerprints that collide and texts of many chunks."""

import hashlib
import random
from collections import defaultdict

import pytest
from frames import LONG, ODD, docs

from minutewise.llm import exact_dedup
from minutewise.llm.exact_dedup import ExactParams
from pyspark.sql import functions as F


def low(text):
    return (text or "").encode().lower()


def slow(rows):
    """doc_id -> keep_id, size and digest, as sorted rows; how many rows stay of each text."""
    by = defaultdict(list)
    for i, t in rows:
        by[low(t)].append(i)
    best = {b: max((i for i in ids if i is not None), default=None) for b, ids in by.items()}
    return sorted(repr((i, best[low(t)], len(by[low(t)]), hashlib.sha256(low(t)).hexdigest())) for i, t in rows)


def check(spark, rows, params=ExactParams()):
    got = exact_dedup.groups(docs(spark, rows), {"sha": exact_dedup.text_sha256(F.col("text"))}, params).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.sha)) for r in got) == slow(rows)
    kept = [(r.sha, r.doc_id, r.keep_id) for r in got if r.kept]
    assert len(kept) == len({k[0] for k in kept}) == len({low(t) for _, t in rows})
    assert all(i == k for _, i, k in kept)


def texts(n):
    """Texts near a chunk's bounds, differing in one place, in case only, or not at all."""
    rng = random.Random(3)
    out = []
    for k in range(n):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 7, 8, 9, 31, 32, 33, 100])))
        at = rng.randrange(len(base) + 1)
        out += [base, base.upper().replace("É", "é"), base[:at] + "Q" + base[at + 1 :], base]
    return list(enumerate(out))


@pytest.mark.parametrize("params", [ExactParams(), ExactParams(chunk_bytes=8), ExactParams(chunk_bytes=8, modulus=521), ExactParams(modulus=521)])
def test_groups(spark, params):
    check(spark, texts(40), params)


def test_odd_rows(spark):
    check(spark, [*ODD, (20, LONG), (21, LONG + "x"), (22, LONG.upper()), (None, "one")])
    check(spark, ODD, ExactParams(chunk_bytes=64))
    assert exact_dedup.groups(docs(spark, [])).collect() == []


def test_a_hot_group_is_not_gathered(spark, monkeypatch):
    rows = [(i, "the same text again and again") for i in range(300)] + [(i, f"own {i}") for i in range(300, 400)]
    check(spark, rows)
    # The other way to join: keys counted as many, rows salted.
    met = exact_dedup._met
    monkeypatch.setattr(exact_dedup, "_met", lambda rows, keys, on, how, params: met(rows, Many(keys), on, how, params))
    check(spark, rows)


class Many:
    """A frame that says it is long."""

    def __init__(self, df):
        self.df = df

    def limit(self, n):
        return type("L", (), {"count": lambda self: n})()

    def withColumn(self, *args):  # noqa: N802
        return self.df.withColumn(*args)


def test_fingerprints_combine():
    params = ExactParams(chunk_bytes=1 << 12)
    h = exact_dedup._Hasher(0, params)
    data = exact_dedup._pieces(exact_dedup.pa.array([LONG[:4000]]))[0]
    r, p = exact_dedup.multiplier(0, params), params.modulus
    plain = 0
    for b in data:
        plain = (plain * r + int(b)) % p
    assert h(data) == plain
    for cut in (0, 1, 1999, 4000):
        left, right = data[:cut], data[cut:]
        assert exact_dedup.combine(h(left), h(right), len(right), params=params) == plain
        assert (h(left, len(right)) + h(right)) % p == plain
