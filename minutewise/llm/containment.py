"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

An item is found in a document if at least 0.8 of its distinct five-word shingles are in the document. Jaccard
similarity says little when a document is a thousand times longer than an item, so items are partitioned by their
number of shingles, and each partition has its own sketch: the smallest hashes of an item's shingles, as many as the
partition's upper size bound u asks for. A document that holds a share t of at most u shingles lacks at most (1 - t) * u
of them, so of the floor((1 - t) * u) + 1 smallest hashes it must hold one. Candidates are the pairs that share such a
hash, which loses no pair; each is then verified by counting the item's very shingles in the document.

Words are runs of letters and digits, lower-cased, so punctuation, case and line breaks make no difference.
Everything is DataFrame functions; no Python runs on the data.

Edge cases: a null or empty text, and one without a letter or digit, contains nothing and is contained in nothing. An
item of fewer than five words is one shingle, all its words, and documents have such short shingles only where they
are as short themselves: it is found in documents with the very same words. Items of equal text are each
found. Rows without an id keep a null id and are matched like others; rows that share an id are told apart by
their text in verification and give one row per pair of ids, the largest containment. Empty tables give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import read, saved


@dataclass(frozen=True)
class ContainmentParams:
    """Shingle width, least containment, growth of the size partitions, and the largest sketch table to broadcast."""

    words: int = 5
    least: float = 0.8
    partition_growth: int = 2
    broadcast_rows: int = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, lower-cased; an empty list for a null text."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def shingles(frame: DataFrame, keep: list, width: int, of) -> DataFrame:
    """The columns keep of frame and `shingles`: of(the words) for each shingle of its text, repeats included."""
    # Through a generator, as the optimizer would otherwise put the split into the step taken for every shingle.
    cut = frame.select(*keep, F.explode(F.array(words(F.col("text")))).alias("tokens"))
    tokens, n = F.col("tokens"), F.size("tokens")
    sliding = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: of(*[F.get(tokens, i + (k - 1)) for k in range(width)]))
    short = F.transform(F.slice(tokens, 1, F.least(n, F.lit(1))), lambda _: of(F.concat_ws(" ", tokens)))
    names = [k if isinstance(k, str) else frame.select(k).columns[0] for k in keep]
    return cut.select(*names, F.when(n >= width, sliding).otherwise(short).alias("shingles"))


def sketches(items: DataFrame, params: ContainmentParams) -> DataFrame:
    """item, hash: the smallest shingle hashes of each item, as many as its size partition asks for."""
    sized = shingles(items, ["item"], params.words, _hash).select("item", F.array_sort(F.array_distinct("shingles")).alias("hashes"))
    sized = sized.where(F.size("hashes") > 0)
    # Partition k holds the sizes up to growth ** k.
    growth = float(params.partition_growth)
    upper = F.pow(F.lit(growth), F.ceil(F.log(growth, F.size("hashes").cast("double")) - 1e-9))
    depth = F.floor(upper * F.lit(1 - params.least) + F.lit(1e-9)).cast("int") + 1
    return sized.select("item", F.explode(F.slice("hashes", F.lit(1), F.least(depth, F.size("hashes")))).alias("hash"))


def small(frame: DataFrame, params: ContainmentParams) -> DataFrame:
    """A saved frame of three short columns at most, marked for broadcast if its counted rows allow it."""
    return F.broadcast(frame) if frame.count() <= params.broadcast_rows else frame


def matches(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams()) -> DataFrame:
    """doc_id, doc, item, containment of every item (item, text) in every document (doc_id, text) that holds enough of it.

    doc and item are hashes of the texts; items have each text once.
    """
    wanted = saved(sketches(items, params))
    doc = text_hash(F.col("text")).alias("doc")

    seen = shingles(docs, ["doc_id", doc], params.words, _hash).select("doc_id", "doc", F.explode("shingles").alias("hash"))
    candidates = saved(seen.join(small(wanted, params), "hash").select("doc_id", "doc", "item").distinct())

    # Only documents that met an item are read again, and their shingles compared as text.
    met = small(saved(candidates.select(F.col("doc_id").alias("id"), F.col("doc").alias("key")).distinct()), params)
    text = docs.select("doc_id", doc, "text")
    held = text.join(met, text["doc_id"].eqNullSafe(met["id"]) & (text["doc"] == met["key"]), "left_semi")
    unique = lambda frame, keep: shingles(frame, keep, params.words, _text).select(*keep, F.explode(F.array_distinct("shingles")).alias("shingle"))
    needed = saved(unique(items, ["item"]))
    sizes = needed.groupBy("item").agg(F.count("*").alias("size"))
    counted = unique(held, ["doc_id", "doc"]).join(small(needed, params), "shingle").groupBy("doc_id", "doc", "item").agg(F.countDistinct("shingle").alias("n"))
    enough = counted.join(sizes, "item").where(F.col("n") >= F.col("size") * F.lit(params.least) - F.lit(1e-9))
    pairs = enough.select("doc_id", "doc", "item", (F.col("n") / F.col("size")).alias("containment"))
    same = candidates.select(F.col("doc_id").alias("id"), F.col("doc").alias("key"), F.col("item").alias("candidate"))
    return pairs.join(same, pairs["doc_id"].eqNullSafe(same["id"]) & (pairs["doc"] == same["key"]) & (pairs["item"] == same["candidate"]), "left_semi")


def _items(items: DataFrame) -> DataFrame:
    return saved(items.select("item_id", "text", text_hash(F.col("text")).alias("item")))


def contained(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams()) -> DataFrame:
    """doc_id, item_id, containment of every item (item_id, text) in every document (doc_id, text) that holds enough of it."""
    named = _items(items)
    found = matches(docs, named.dropDuplicates(["item"]), params).join(named.select("item", "item_id"), "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams()) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = matches(docs, _items(items).dropDuplicates(["item"]), params)
    bad = small(saved(found.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).distinct()), params)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (text_hash(docs["text"]) == bad["_doc"]), "left_anti")


def op4_containment(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contained(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def _sql_shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
    FROM {table})"""


OP4_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}), b AS ({_sql_shingles("benchmark", "item_id")}),
size AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(size) AS containment FROM d JOIN b USING (shingle) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= any_value(size) * 0.8 - 1e-9
"""
