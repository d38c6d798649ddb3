"""Spelling variants against edit distances by brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import ODD, docs

from minutewise.llm import spelling
from minutewise.llm.spelling import SpellingParams

UP = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows, params=SpellingParams()):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                run = run.translate(UP)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                word = run[:at] + run[at + 1 :] if h % 31 == 0 else run
                counts[word] += len(word) >= params.least_length
            run = ""
    n = {w: c for w, c in counts.items() if c >= params.least_count}
    out = {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = others[0] if others and n[others[0]] >= params.ratio * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    root = {}
    for w in n:
        root[w] = w
        while out[root[w]][0]:
            root[w] = out[root[w]][0]
    return sorted(repr((w, out[w][0], root[w], *out[w][1:])) for w in n)


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def crowd(seed, letters, n):
    """Words from few letters, so that many are near; some far more frequent than others."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(n)]
    text = [w for k, w in enumerate(words) for _ in range(100 if k % 17 == 0 else 12 if k % 5 == 0 else rng.randrange(1, 4))]
    rng.shuffle(text)
    return [(i, " ".join(text[i::7]) + "  Éclairé-ÉCLAIRÉ÷×a") for i in range(7)]


@pytest.mark.parametrize("params", [SpellingParams(), SpellingParams(shard_chars=300, block=5), SpellingParams(ratio=2)])
@pytest.mark.parametrize("letters", ["ab", "abcdeéß÷"])
def test_near_words(spark, params, letters):
    rows = crowd(4, letters, 400)
    assert got(spelling.variants(docs(spark, rows), params)) == slow(rows, params)


def test_chains_end_at_their_root(spark):
    words = {"abcdefgh": 2, "abcdefg": 30, "abcdefgi": 400, "abcdefgij": 5000, "zzzzzzz": 3}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    found = spelling.variants(docs(spark, rows))
    assert got(found) == slow(rows)
    assert found.where("root <> form").count() >= 1


def test_odd_rows(spark):
    rows = [*ODD, *ODD, (None, "unusual Unusual unusuall unusually")]
    assert got(spelling.variants(docs(spark, rows))) == slow(rows)
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None), (2, "short")])).collect() == []


def test_index_counts_like_the_text():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(200)})
    index, ring = spelling.BidirectionalIndex(words), "#" + "#".join(words)
    twice = ring + ring
    for _ in range(300):
        at = rng.randrange(len(ring))
        pattern = twice[at : at + rng.randrange(1, 6)]
        codes = ["#abc".index(c) for c in pattern]
        middle = rng.randrange(len(codes) + 1)
        state = index.everything(1)
        for side, part in ((spelling.LEFT, codes[:middle][::-1]), (spelling.RIGHT, codes[middle:])):
            state = index.matched(state, side, np.array([part], dtype=int).reshape(1, len(part)))
        assert state[3][0] == sum(twice.startswith(pattern, k) for k in range(len(ring)))
