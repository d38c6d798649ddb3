"""Plain identifiers against the published patterns, and disguised ones by example."""

import re

import pytest
from frames import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutewise.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    return sum(int(d) if k % 2 == 0 else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][int(d)] for k, d in enumerate(reversed(text))) % 10 == 0


RULES = {
    "email": lambda m: True,
    "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)),
    "phone": lambda m: 8 <= len(digits(m)) <= 15,
}


def slow(text):
    return {k: [m.span() for m in PATTERNS[k].finditer(text) if RULES[k](m[0])] for k in PATTERNS}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.%+- ()0123459_\n", max_size=60))
def test_plain_identifiers(text):
    assert pii.find(text, hinted=False)[0] == slow(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john at example dot com now", "email", "john at example dot com"),
        ("x john (at) example [dot] com", "email", "john (at) example [dot] com"),
        ("j.doe [at] mail.example.org!", "email", "j.doe [at] mail.example.org"),
        ("write john @ example . com", "email", "john @ example . com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("john＠example.com", "email", "john＠example.com"),
        ("a​b@b.com", "email", None),
        ("call plus one five five five one two three four five six seven.", "phone", "plus one five five five one two three four five six seven"),
        ("+１ (973) 555-3436", "phone", "+１ (973) 555-3436"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
        ("the un deux trois at the point of it", "email", None),
        ("four one one one one one one one one one one one one one one two", "card", None),
        ("null eins 4785380592391141 un deux", "card", None),
        ("is at reti. The of", "email", None),
    ],
)
def test_disguises(text, kind, found):
    plain, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == ([found] if found else [])
    assert plain == slow(text)
    assert pii.re.search(pii._HINT, text) or not found


def test_long_runs_take_time_in_proportion():
    for run in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "+1" * 150_000, "1." * 150_000, " at " * 60_000, "one " * 60_000):
        pii.find(run)


def test_odd_documents(spark):
    rows = [*ODD, (20, "to john at example dot com or a@b.co, 10.0.0.1"), (20, "to john at example dot com or a@b.co, 10.0.0.1")]
    got = pii.digested(docs(spark, rows).select("doc_id", pii.pii()(F.col("text")).alias("pii"))).collect()
    assert len(got) == len(rows)
    last = [r for r in got if r.doc_id == 20]
    assert len(last) == 2 and {(r.n_email, r.n_ip, r.spans) for r in last} == {(2, 1, "email:3:26,email:30:36,ip:38:46")}
    assert {r.spans for r in got if r.doc_id in (4, 5)} == {""}
    masked = {r.doc_id: r.m for r in docs(spark, rows).select("doc_id", pii.masked()(F.col("text")).alias("m")).collect()}
    assert masked[20] == "to [email] or [email], [ip]" and masked[4] is None and masked[5] == ""
    assert docs(spark, []).select(pii.pii()(F.col("text"))).collect() == []


FORMS = [
    ("email", "john@example .com"), ("email", "john at example . com"), ("email", "john( at )example.com"), ("email", "john (  at  ) example (  dot  ) com"),
    ("email", "max at firma dot de"), ("email", "max at firma [dot] fr"), ("email", "max at mail dot firma.es"), ("email", "max arroba firma punto".replace(" punto", " (punto) es")),
    ("email", "john\u00a0@\u00a0example.com"), ("email", "john at  example.com"), ("email", "john@example\u00a0dot\u00a0com"),
    ("phone", "plus49 30 1234567"), ("phone", "plus\u00a049 30 1234567"), ("phone", "+49 (three)  - four 1234 (five) 67"),
    ("phone", "plus one five five five one two three four five six seven"), ("ip", "10 dot 0 dot 0 dot 1"), ("card", "4111-one-one-one-one 1111 1111"),
]


def test_every_form_reaches_the_rules(spark):
    """Each disguise alone in its text: found at all, and found through the hint as without it."""
    texts = [f"x {t} y" for _, t in FORMS]
    rows = docs(spark, [*enumerate(texts)]).select("doc_id", pii.pii()(F.col("text")).alias("p")).collect()
    for r in rows:
        kind, form = FORMS[r.doc_id]
        plain, added = pii.find(texts[r.doc_id], True)
        assert [(s.kind, s.start, s.end) for s in r.p.spans] == [(k, *s) for k in pii.KINDS for s in sorted(plain[k] + added[k])], form
        assert [texts[r.doc_id][a:b] for a, b in added[kind]] == [form], form


def test_plain_stops_still_want_a_known_ending():
    for text in ("is at reti.de or", "look at this. de", "he was at firma.fr", "we met at noon dot"):
        assert not any(pii.find(text)[1].values()), text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("at At dot plus Plus one two drei 5 49 4111 @ . ( ) [ ] - , john example com de org \u00a0 \t".split(" ") + [" ", " ", " "]), max_size=14).map("".join))
def test_hint_is_no_narrower_than_the_rules(text):
    hinted = pii.pc.match_substring_regex(pii.pa.array([text], pii.pa.large_string()), pii._HINT)[0].as_py()
    assert pii.find(text, True) == pii.find(text, hinted)
