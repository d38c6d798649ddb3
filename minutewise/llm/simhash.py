"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check and connected groups.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints that differ
in at most two of five blocks agree in the other three, so every close pair meets in one of the ten choices of three
blocks; pairs that meet are checked by their Hamming distance. Documents with one fingerprint are one node from the
start, so copies never make pairs.

A block that many different fingerprints share is not paired out. Its members are linked by their neighbourhood: two
fingerprints differ in at most two bits exactly if one value is at most one bit away from both. At most 65
fingerprints can lie around one value, so this stays linear however crowded a block is, and it loses no link that
matters for the groups.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle. Rows without a doc_id get a group but never name one; rows that share
a doc_id are kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import if_small, read, saved, text_array
from minutewise.llm.components import components


@dataclass(frozen=True)
class SimhashParams:
    """Shingle width, hash seed and the size from which a block counts as crowded; the distance is two bits."""

    words: int = 3
    seed: int = 42
    crowded: int = 48


# Rows, of one number each, that are broadcast to pick others; more are joined as Spark decides.
BROADCAST = 2_000_000

WIDTHS = (13, 13, 13, 13, 12)

# How often each bit is set in each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def block_masks() -> list[int]:
    """The bits of every choice of three of the five blocks, as signed 64-bit integers."""
    starts = np.cumsum([0, *WIDTHS])
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(WIDTHS, starts)]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_of(text: str, params: SimhashParams = SimhashParams()) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six white space characters of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*itertools.accumulate(map(len, words), lambda at, n: at + 1 + n)]
    starts = [0, *(e + 1 for e in ends[: max(len(ends) - params.words, 0)])]
    shingles = map(joined.__getitem__, map(slice, starts, ends[min(params.words, len(ends)) - 1 :]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(params.seed)), dtype=np.uint64)
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) > 300:
        set_in = np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in columns.T])
    else:
        set_in = np.unpackbits(columns, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text, params: SimhashParams = SimhashParams()):
    """The fingerprint of a text column as a long."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, params) for t in text_array(column).to_pylist()], pa.int64())

    return simhash(text)


def links(prints: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp, each once) whose groups are those of all close pairs."""
    choices = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(block_masks())])
    blocks = prints.select("fp", F.explode(choices).alias("c")).select("fp", "c.choice", "c.key")
    sizes = blocks.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(blocks.join(sizes, ["choice", "key"]))

    few = shared.where(F.col("n") <= params.crowded).select("choice", "key", "fp")
    pairs = few.select("choice", "key", F.col("fp").alias("a")).join(few.select("choice", "key", F.col("fp").alias("b")), ["choice", "key"])
    close = pairs.where("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()

    many = shared.where(F.col("n") > params.crowded).select("fp").distinct()
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    around = many.select("fp", F.explode(one_off).alias("value")).groupBy("value").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    met = around.where(F.size("fps") > 1).select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return close.unionByName(met.distinct())


def labelled(prints: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """fp, label and component_id of every fingerprint of prints (doc_id, fp, saved): its group, and the smallest doc_id in it."""
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return named(nodes, components(links(nodes.select("fp"), params)))


def named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """fp, label and component_id of nodes (fp, first) by the labels (node, label) of those that are linked."""
    told = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = told.groupBy("label").agg(F.min("first").alias("component_id"))
    return told.join(smallest, "label").select("fp", "label", "component_id")


def groups(docs: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable, for every row of docs."""
    prints = saved(docs.select("doc_id", fingerprint(F.col("text"), params).alias("fp")))
    return prints.join(labelled(prints, params), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of each group the row with the smallest doc_id does.

    Of rows that share this doc_id and its fingerprint one stays; a group without a doc_id keeps one row as well.
    """
    # The row as one struct, so that no name of docs can clash.
    row = F.struct(*docs.columns).alias("row")
    printed = saved(docs.select(row, fingerprint(F.col("text"), params).alias("fp"), F.monotonically_increasing_id().alias("at")))
    nodes = saved(printed.groupBy("fp").agg(F.min("row.doc_id").alias("first")))
    return kept_rows(printed, components(links(nodes.select("fp"), params)))


def kept_rows(printed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of printed (row, fp, at; saved) that stay, by the labels (node, label) of the fingerprints that are linked.

    at: a number for each row. Whole rows are not shuffled where those that go are few enough to broadcast their numbers.
    """
    prints = printed.select("row.doc_id", "fp", "at")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    # Each doc_id and fingerprint once, so that copies are one row before the join.
    chosen = prints.select("doc_id", "fp").distinct().join(named(nodes, labels), "fp").groupBy("label").agg(first)
    key = lambda doc_id, fp: F.concat_ws(":", doc_id, fp).alias("key")
    keys = chosen.select(key("first.doc_id", "first.fp")).distinct()
    kept = prints.select("at", key("doc_id", "fp")).join(keys, "key", "left_semi").groupBy("key").agg(F.min("at").alias("at"))
    gone = if_small(saved(prints.select("at").join(kept.select("at"), "at", "left_anti")), BROADCAST)
    return printed.join(gone, "at", "left_anti").select("row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
