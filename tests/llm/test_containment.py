"""Benchmark items in documents against brute force."""

import re

from frames import LONG, ODD, docs, prose

from minutewise.llm import containment as con


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def slow(documents, items):
    best = {}
    for d, text in documents:
        own = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & own) >= 0.8 * len(want) - 1e-9:
                best[d, i] = max(best.get((d, i), 0), len(want & own) / len(want))
    return {(d, i, x) for (d, i), x in best.items()}


ITEM = " ".join(f"w{k}" for k in range(40))
ITEMS = [
    (1, ITEM), (2, " ".join(f"v{k}" for k in range(12))), (3, "one two"), (4, None), (5, ""), (6, prose(1, 40)), (7, ITEM), (None, " ".join(f"u{k}" for k in range(9))),
    (8, " ".join(f"z{k}" for k in range(300))),
]


def planted():
    words = ITEM.split()
    broken = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    return [
        *ODD,
        (30, LONG + " " + ITEM.upper().replace(" ", ", ")), (31, broken(20)), (32, broken(10, 30)), (33, broken(10, 20, 30)), (34, ITEM[: len(ITEM) // 2]),
        (35, "a " + ITEMS[1][1] + " b"), (36, ITEMS[-2][1] + " c"), (37, ITEMS[-1][1] + "\n" + ITEM), (38, " ".join(reversed(words))),
        (39, "pre " + " ".join(f"z{k}" for k in range(260))), (40, "pre " + " ".join(f"z{k}" for k in range(230))), (30, "other text with the same id"),
        (None, ITEM + " tail"),
    ]


def test_found_items(spark):
    documents = planted()
    items = spark.createDataFrame([(*r, 5, 6) for r in ITEMS], "item_id long, text string, item long, hash int")
    got = {tuple(r) for r in con.contained(docs(spark, documents), items).collect()}
    assert got == slow(documents, ITEMS)
    assert {d for d, i, _ in got if i == 1} == {30, 31, 37, None} | ({32} if (32, 1) in {g[:2] for g in got} else set())
    bare = con.ContainmentParams(broadcast_rows=0)
    assert {tuple(r) for r in con.contained(docs(spark, documents), items, bare).collect()} == got


def test_clean_documents_stay(spark):
    documents = planted()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = con.decontaminated(docs(spark, documents), items)
    bad = {(d, t) for d, t in documents if slow([(d, t)], ITEMS)}
    assert kept.columns == docs(spark, []).columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(x) for x in documents if x not in bad)
    assert con.contained(docs(spark, []), items).collect() == [] and con.contained(docs(spark, documents), items.where("false")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = con.contained(docs(spark, ODD), spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
