"""Decoding of disguises, and held-out scores on texts with planted words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from frames import LONG, prose
from pyspark.sql import functions as F

from minutewise.llm import toxicity as tox

BAD = ["worthless", "pathetic", "idiot", "stupid"]


def corpus(n=300):
    rng = random.Random(2)
    syllables = "th er on ing the and re ti at en ha wh st ou".split()
    clean = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(500)] + prose(1, 30).split()
    rows = []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(20 + k % 40)]
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
            words.append(rng.choice(BAD) + rng.choice(["", "!!", ".", "***"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1, 2.0) for k, t, _ in rows] + [(None, "idiot", "y", 1, 2.0)], "doc_id long, text string, word string, toxic long, odds double")
    labels = spark.createDataFrame([(k, 0, x) for k, _, x in rows if k % 10] + [(1, 0, None), (None, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.fixture(scope="module")
def model(frames):
    return tox.fit(*frames)


def test_decoding(model):
    for disguised, plain in [
        ("w0rthl3ss", "worthless"), ("p4th3t1c", "pathetic"), ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"),
        ("i.d.i.o.t", "idiot"), ("st_up-id", "stupid"), ("ïdiót!!!", "idiot"), ("iiiidiot", "idiot"), ("раthetic", "pathetic"),
    ]:
        assert tox.restore(disguised, model.letters) == plain


def brute(token, letters):
    """The best reading over all of them."""
    states = [(0.0, "")]
    before = ""
    for c in token:
        drop = tox.COST_REPEAT if c == before else tox.COST_STRANGE if c.isalnum() else tox.COST_DROP
        readings = tox.readings(c)
        states = [(s + drop, t) for s, t in states] + [(s + (0.0 if readings == c else tox.COST_LEET), t + r) for s, t in states for r in readings]
        before = c

    def total(score, text):
        codes = [tox.EDGE] * 3 + [ord(x) - 97 for x in text] + [tox.EDGE]
        return score + sum(float(letters[tuple(codes[k - 3 : k + 1])]) for k in range(3, len(codes)))

    return max((total(s, t), t) for s, t in states)


@pytest.mark.parametrize("token", ["1d10t", "a1!b", "s$5s", "oo0o", "4@4", "x", "!!"])
def test_viterbi_is_the_best_of_all_readings(model, token):
    assert tox.restore(token, model.letters) == brute(token, model.letters)[1]


def test_scores(spark, frames, model):
    docs, labels = frames
    truth = {k: x for k, _, x in corpus()}
    odd = [(900, None), (901, ""), (902, LONG), (903, "you i d i o t of a b"), (904, "1d10t"), (905, "the the the"), (905, "the the the"), (906, LONG + " 1d10t p4thetic")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    got = docs.select("doc_id", "text").unionByName(more).select("doc_id", tox.toxicity(model)(F.col("text")).alias("score")).collect()
    assert len(got) == 301 + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert all((score[k] >= 0.5) == (x == 1) for k, x in truth.items())
    assert all(score[k] < 0.5 for k in (900, 901, 902, 905)) and all(score[k] >= 0.5 for k in (903, 904, 906))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    for labels, side in (([], 0), ([(1, 1)], 1)):
        model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert round(docs.select(tox.toxicity(model)(F.col("text")).alias("s")).first().s) == side
    none = docs.where("doc_id > 5")
    assert none.select(tox.toxicity(tox.fit(none, spark.createDataFrame([], "doc_id long, toxic int")))(F.col("text"))).collect() == []


def test_letter_counts_stop_at_word_ends():
    total = np.zeros(tox.SYMBOLS**4, dtype=np.int64)
    tox.count_letters(pa.array(["ab ab, c 9x", ""], pa.large_string()), total)
    counts = total.reshape((tox.SYMBOLS,) * 4)
    e = tox.EDGE
    assert counts[e, e, e, 0] == 2 and counts[e, e, 0, 1] == 2 and counts[e, 0, 1, e] == 2
    assert counts[e, e, e, 2] == 1 and counts[e, e, 2, e] == 1 and total.sum() == 8


def test_disguises_are_scored(spark):
    """Each disguise makes a text toxic by the score itself, and harmless texts like them don't."""
    bad = ["worthless", "pathetic", "idiot", "stupid", "ass", "incomprehensibly"]
    rows = [(k, f"{t} {bad[k // 4 % len(bad)]}" if x else t, x) for k, t, x in corpus(360)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int"))
    toxic = ["you stuupid", "an ïdiót!!!", "раthetic", "wwoorrtthhlleess", "455", "so $tup1d", " ".join("incomprehensibly"), "iddiioott", "wwoorrtthhlleessss"]
    clean = ["the heat", "thhe onn", "thé ré", "12 99", "!!! ---", "t h e", "жжж ß", ""]
    told = spark.createDataFrame([*enumerate(toxic + clean)], "doc_id long, text string").select("doc_id", "text", tox.toxicity(model)(F.col("text")).alias("s")).collect()
    assert {r.text for r in told if r.s >= 0.5} == set(toxic)


def test_long_runs_of_lone_characters_take_time_in_proportion(model):
    ids, of = tox.Restorer(model.letters).hashes(pa.array(["a b c d " * 200], pa.large_string()))
    assert 3 < len(ids) <= 64 * 800


def test_paths_that_cannot_win_are_not_followed(model, monkeypatch):
    followed, best_path = [], tox._best_path

    def counted(steps, told, bounds, least, narrow):
        seen = Rows(told)
        found = best_path(steps, seen, bounds, least, narrow)
        followed.append(seen.read)
        return found

    class Rows(list):
        read = 0

        def __getitem__(self, k):
            self.read += 1
            return super().__getitem__(k)

    monkeypatch.setattr(tox, "_best_path", counted)
    token = "st0p-h4ting-th3-" * 3
    assert tox.restore(token, model.letters)
    narrow, pruned = followed[:2]
    assert best_path_of_all(token, model.letters, best_path) == tox.restore(token, model.letters)
    assert narrow + pruned < 100 * 16 * len(token)


def best_path_of_all(token, model, best_path):
    """What is found when no path is left."""
    kept = tox._best_path
    tox._best_path = lambda steps, told, bounds, least, narrow: best_path(steps, told, bounds, -float("inf"), False)
    try:
        return tox.restore(token, model)
    finally:
        tox._best_path = kept
