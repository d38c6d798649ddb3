"""Language identification: held-out accuracy, rejection and odd rows."""

import random

from frames import LONG
from pyspark.sql import functions as F

from minutewise.llm import language

SYLLABLES = {"aa": "th er on ing the and".split(), "bb": "eau oi ement que les".split(), "cc": "sch ung keit ü ein".split()}


def made(kind, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[kind]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    kinds = [*SYLLABLES]
    return [(k, made(kinds[k % 3], k, 5 + k % 60), kinds[k % 3]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], "doc_id long, text string, lang string, label string, score double, bound long")


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, LONG, None), (None, made("bb", 5, 20), "bb"), (904, "Ж", "aa"), (904, "Ж", "aa")]
    docs = frame(spark, corpus() + odd)
    model = language.fit(language.learnable(docs), language.LanguageParams(docs_per_language=60))
    assert model.languages == ("aa", "bb", "cc")
    got = language.with_language(docs, F.col("text"), model, "told").select("doc_id", "lang", "told.*", language.held_out(F.col("doc_id"), 4, 2).alias("held")).collect()
    judged = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert len(judged) > 30
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for k in (900, 901, 902):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[903].lang_pred == "aa" and by[904].lang_pred in model.languages
    assert sum(r.rejected for r in judged) == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(0, "some text", None)])
    model = language.fit(docs)
    assert language.with_language(docs, F.col("text"), model).first().language.lang_pred == "und"
    none = frame(spark, [])
    assert language.with_language(none, F.col("text"), language.fit(none)).collect() == []


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    """Random letters and a language that nobody taught go, with one language learned too; short clean texts stay."""
    rng = random.Random(4)
    noise = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40))
    strange = [noise("abcdefghijklmnopqrstuvwxyz") for _ in range(20)] + [noise("абвгдежзиклмнопрст") for _ in range(20)]
    strange += [" ".join(rng.choice("kaz mutuq yvorsk plim zug wojt".split()) for _ in range(40)) for _ in range(20)]
    rows = corpus(1500)
    for learned in (rows, [r for r in rows if r[2] == "aa"]):
        model = language.fit(frame(spark, learned))
        clean = [(k, made(kind, 9000 + k, 1 + k % 8), kind) for k in range(300) for kind in [model.languages[k % len(model.languages)]]]
        told = frame(spark, clean + [(1000 + k, t, None) for k, t in enumerate(strange)])
        got = language.with_language(told, F.col("text"), model, "told").select("doc_id", "told.rejected").collect()
        assert sum(r.rejected for r in got if r.doc_id < 1000) <= 3
        assert all(r.rejected for r in got if r.doc_id >= 1000)
