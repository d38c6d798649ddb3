"""Small tables with everything that may be odd about rows."""

WORDS = "the and of ring edth onre thing heat ble tion ent ist red thin an in at er on re"


def prose(seed, n):
    words = WORDS.split()
    return " ".join(words[(seed * 7 + k * k * 3 + k * seed) % len(words)] for k in range(n))


def docs(spark, rows, extra=True):
    """doc_id and text, with columns around them whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = "fp long, label string, key string, row string, part int, hash long, score double, lang string, task int"
    return spark.createDataFrame([(*r, 1, "x", "k", "r", 2, 3, 0.5, "en", 4) for r in rows], f"doc_id long, text string, {names}")


LONG = prose(3, 60_000)
ODD = [
    (1, prose(1, 40)), (2, prose(1, 40)), (3, prose(1, 40).upper()), (4, None), (5, ""), (6, " \t\n"), (7, LONG),
    (8, "one"), (9, "one two"), (None, prose(2, 30)), (None, None), (11, prose(9, 50)), (11, prose(9, 50)),
    (12, "näïve ǆ   ümlaut 日本語 \x1c\x1d x"), (13, "a  b\n\n c \n d  "),
]
