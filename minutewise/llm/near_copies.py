"""Near copies by similarity: texts whose word shingles have a Jaccard index of at least a bound.

A shingle that a text repeats counts as often as it stands there, each time as an element of its own; else a long text that
only repeats a short one would be a copy of it.

The first candidates are the SimHash operator's: fingerprints of the same shingles, linked by its blocks, its Hamming check and,
where a block is crowded, by neighbourhood. Its two bits reach the closest copies only, so bands of minimum hashes bring the
rest: two texts meet where all minima of one band are equal. Every link is checked against the whole sets, so that no text
is linked for its sketch alone. Texts with one set are one node from the start.

Groups, not pairs, are wanted, so bands are not paired out at first: the members of a band that fingerprints left apart are checked against one of them,
which is linear. That is the member with the most company over all its bands, as an original that many copies differ from
has more in common with each than they have with one another. Members that are still apart are checked against the next
one, as long as that links any. Only what is left is then checked in pairs; in crowded bands through the shingles that are
rarest among the members: two sets that are similar enough share one of the first n - ceil(bound * n) + 1 in any
common order, so this split loses nothing. Pairs whose sizes, places of the shared shingle, or marks rule the bound out are
dropped where they meet. The marks of a set are the parities of how many of its shingles fall to each of 1,024 bits; where the
marks of two sets differ, so do the sets, so too many differing marks rule a pair out for certain. Sets themselves are made
and shuffled for the pairs that are left only.

Edge cases: a null or empty text, or one of white space only, has a set of its own kind; a text of fewer words than a
shingle is one shingle. Repeated rows and rows without a doc_id are treated as in simhash. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutewise.llm.common import if_small, lists, saved, text_array, words_of
from minutewise.llm.components import components
from minutewise.llm.simhash import BROADCAST, SimhashParams, fingerprint_of, kept_rows
from minutewise.llm.simhash import links as close_prints


@dataclass(frozen=True)
class NearCopyParams:
    """Shingle width, least Jaccard index in percent, and the bands; a pair at 0.8 is missed once in 37,000 times."""

    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4
    # 64 marks each.
    marks: int = 16
    seed: int = 42
    crowded: int = 48


# Smaller batches than elsewhere, as the shingles of a text take many times its bytes while they are sorted.
_BATCH_BYTES = 1 << 20

_PAD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array, params: NearCopyParams = NearCopyParams()) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle and its how-manieth occurrence, text after text, in an order that only the set decides; the sizes, one at least."""
    words, counts = words_of(texts)
    distinct = np.fromiter((xxhash.xxh64_intdigest(w, params.seed) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    lengths = np.maximum(counts, params.words)
    ends = np.cumsum(lengths)
    place = np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)
    spelled = np.full(len(place) + params.words, _PAD)
    spelled[: len(place)][place < np.repeat(counts, lengths)] = distinct[words.indices.to_numpy()]
    h = np.zeros(len(place), dtype=np.uint64)
    for j, factor in enumerate(_odd(params.words, params.seed)):
        h += spelled[j : j + len(place)] * factor
    sizes = lengths - params.words + 1
    h = _mixed(h[place < np.repeat(sizes, lengths)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = h[np.lexsort((h, owner))]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(h))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mixed(h + occurrence.astype(np.uint64) * _PAD), sizes


def marked(hashes: np.ndarray, sizes: np.ndarray, params: NearCopyParams = NearCopyParams()) -> np.ndarray:
    """The marks of sets, a row each: a bit is set where an odd number of the shingles fall to it."""
    marks = np.zeros(len(sizes) * params.marks, dtype=np.uint64)
    bit = (hashes >> np.uint64(32)) % np.uint64(64 * params.marks)
    word = np.repeat(np.arange(len(sizes)) * params.marks, sizes) + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(marks, word, np.uint64(1) << (bit & np.uint64(63)))
    return marks.reshape(len(sizes), params.marks)


def sketched(text: Column, params: NearCopyParams = NearCopyParams()) -> Column:
    """struct<fp: long, simhash: long, bands: array<long>, marks: array<long>, n: int> of a text column: a digest of the whole set, its
    fingerprint, one of each band's minima, its marks and its size."""
    prints = SimhashParams(words=params.words)

    @F.arrow_udf("struct<fp: long, simhash: long, bands: array<long>, marks: array<long>, n: int>")
    def sketch(column: pa.Array) -> pa.Array:
        texts = text_array(column)
        hashes, sizes = shingles(texts, params)
        simhashes = pa.array([fingerprint_of(t, prints) for t in texts.to_pylist()], pa.int64())
        starts = np.cumsum(sizes) - sizes
        digests = np.array([xxhash.xxh64_intdigest(hashes[a : a + n].tobytes()) for a, n in zip(starts, sizes)], dtype=np.uint64)
        bands = np.zeros((len(sizes), params.bands), dtype=np.uint64)
        factors = _odd(params.bands * params.rows, params.seed + 1).reshape(params.bands, params.rows)
        for k in range(params.bands if len(sizes) else 0):
            for factor in factors[k]:
                spread = hashes * factor
                lowest = np.minimum.reduceat(spread ^ (spread >> np.uint64(31)), starts)
                bands[:, k] = _mixed(bands[:, k] + lowest)
        flat = lists(bands.ravel().view(np.int64), np.full(len(sizes), params.bands))
        marks = lists(marked(hashes, sizes, params).ravel().view(np.int64), np.full(len(sizes), params.marks))
        return pa.StructArray.from_arrays(
            [pa.array(digests.view(np.int64)), simhashes, flat, marks, pa.array(sizes.astype(np.int32))], names=["fp", "simhash", "bands", "marks", "n"]
        )

    return sketch(text)


def shingle_sets(text: Column, params: NearCopyParams = NearCopyParams()) -> Column:
    """The shingles of a text column as array<long>."""

    @F.arrow_udf("array<long>")
    def distinct(column: pa.Array) -> pa.Array:
        hashes, sizes = shingles(text_array(column), params)
        return lists(hashes.view(np.int64), sizes)

    return distinct(text)


def _possible(params: NearCopyParams) -> Column:
    """Whether sizes n_a, n_b and marks_a, marks_b allow the bound. Two sets differ in a shingle at least for each mark they differ in."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    differ = sum((F.bit_count(F.col("marks_a")[k].bitwiseXOR(F.col("marks_b")[k])) for k in range(params.marks)), F.lit(0))
    sized = 100 * F.least(n_a, n_b) >= params.percent * F.greatest(n_a, n_b)
    return sized & ((100 + params.percent) * differ <= (100 - params.percent) * (n_a + n_b))


def _ends(pairs: DataFrame) -> DataFrame:
    return if_small(saved(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), BROADCAST)


def _sets(nodes: DataFrame, printed: DataFrame, params: NearCopyParams) -> DataFrame:
    """fp and shingles of the nodes (fp); saved."""
    texts = printed.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    return saved(texts.select("fp", shingle_sets(F.col("text"), params).alias("shingles")))


def _similar(pairs: DataFrame, nodes: DataFrame, printed: DataFrame, params: NearCopyParams) -> DataFrame:
    """Those of the pairs a, b of nodes (fp, n, marks) whose sets are similar enough; saved.

    Pairs and their ends are saved, so that their number is known and few of them move no table of nodes or texts.
    """
    pairs = saved(pairs.distinct())
    told = nodes.select("fp", "n", "marks").join(_ends(pairs), "fp", "left_semi")
    side = lambda c: told.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}"))
    likely = saved(pairs.join(side("a"), "a").join(side("b"), "b").where(_possible(params)).select("a", "b"))
    sets = _sets(_ends(likely), printed, params)
    held = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    near = 100 * both >= params.percent * (F.size("a_set") + F.size("b_set") - both)
    return saved(likely.join(held("a"), "a").join(held("b"), "b").where(near).select("a", "b"))


def _rare_pairs(nodes: DataFrame, params: NearCopyParams) -> DataFrame:
    """Pairs of nodes (fp, label, n, marks, shingles) of different labels that share one of their first shingles, the rarest coming first."""
    each = nodes.select("fp", "n", F.explode("shingles").alias("s"))
    ordered = each.join(each.groupBy("s").agg(F.count("*").alias("times")), "s")
    place = F.row_number().over(Window.partitionBy("fp").orderBy("times", "s"))
    last = F.col("n") - F.expr(f"({params.percent} * n + 99) DIV 100") + 1
    first = ordered.withColumn("place", place).where((F.col("place") <= last) & (F.col("times") > 1)).select("fp", "place", "s")
    first = saved(first.join(nodes.select("fp", "label", "n", "marks"), "fp"))
    # Shared shingles lie before, at, or behind both places.
    most = F.least("place_a", "place_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return _met(first, ["s"], params, most * (100 + params.percent) >= params.percent * (F.col("n_a") + F.col("n_b")))


def _met(rows: DataFrame, key: list[str], params: NearCopyParams, also: Column | None = None) -> DataFrame:
    """Pairs a, b of rows (key, fp, label, n, marks, ...) with one key, different labels, and sizes and marks that allow the bound."""
    rest = [c for c in rows.columns if c not in (*key, "fp")]
    side = lambda x: rows.select(*key, F.col("fp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rest])
    allowed = F.expr("a < b AND label_a <> label_b") & _possible(params)
    left, right = side("a"), side("b")
    on = [left[k] == right[k] for k in key]
    return left.join(right, [*on, allowed if also is None else also & allowed]).select("a", "b")


def _mixed_bands(shared: DataFrame, near: DataFrame) -> DataFrame:
    """Members of shared with their label, those of bands with several labels; saved."""
    labels = saved(components(near))
    told = shared.drop("label").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = told.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return saved(told.join(mixed.select("band", "key"), ["band", "key"]))


def _close(printed: DataFrame, params: NearCopyParams) -> DataFrame:
    """Pairs a, b of sets to check, by their fingerprints: one set of each with the others of it, and with that of each close one; saved."""
    sets = saved(printed.select("fp", "simhash").distinct())
    first = sets.groupBy("simhash").agg(F.min("fp").alias("first"))
    same = sets.join(first, "simhash").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = close_prints(sets.select(F.col("simhash").alias("fp")).distinct(), SimhashParams(words=params.words, crowded=params.crowded))
    side = lambda c: first.select(F.col("simhash").alias(c), F.col("first").alias(f"{c}_first"))
    met = near.join(side("a"), "a").join(side("b"), "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    return saved(same.unionByName(met))


def links(printed: DataFrame, params: NearCopyParams = NearCopyParams()) -> DataFrame:
    """Links a, b between the sets of printed (text, fp, simhash, bands, marks, n; saved) whose groups are those of all similar pairs that meet."""
    close = _close(printed, params)
    nodes = saved(printed.select("fp", "bands", "marks", "n").dropDuplicates(["fp"]))
    met = nodes.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    sizes = met.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    inside = saved(met.join(sizes, ["band", "key"]))
    shared = inside.join(inside.groupBy("fp").agg(F.sum("members").alias("company")), "fp")

    near = _similar(close, nodes, printed, params)
    apart, used = _mixed_bands(shared, near), None
    # Stars: everyone of a band with the member that has the most company and hasn't been the centre yet.
    while True:
        free = apart if used is None else apart.join(used, ["band", "key", "fp"], "left_anti")
        centre = F.max(F.struct("company", "fp", "label", "n")).alias("c")
        centres = saved(free.groupBy("band", "key").agg(centre).select("band", "key", "c.fp", "c.label", F.col("c.n").alias("n_c")))
        star = apart.withColumnRenamed("label", "own").join(centres.withColumnRenamed("fp", "centre"), ["band", "key"]).where(
            (F.col("fp") != F.col("centre")) & (F.col("label") != F.col("own"))
            & (100 * F.least("n", "n_c") >= params.percent * F.greatest("n", "n_c"))
        )
        found = _similar(star.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")), nodes, printed, params)
        if found.isEmpty():
            break
        near = near.unionByName(found)
        # Labels only grow together, so no other band can be mixed again.
        apart = _mixed_bands(apart, near)
        # Another star costs more than it saves the pairs where this one linked few.
        if found.count() * 100 < apart.select("fp").distinct().count():
            break
        used = centres.select("band", "key", "fp") if used is None else used.unionByName(centres.select("band", "key", "fp"))
    marks = nodes.select("fp", "marks")
    crowded = saved(apart.where(F.col("members") > params.crowded).select("fp", "label", "n").distinct())
    crowded = crowded.join(marks, "fp").join(_sets(if_small(crowded.select("fp"), BROADCAST), printed, params), "fp")
    few = saved(apart.where(F.col("members") <= params.crowded).select("band", "key", "fp", "label", "n"))
    pairs = _met(few.join(marks, "fp"), ["band", "key"], params).unionByName(_rare_pairs(crowded, params))
    return near.unionByName(_similar(pairs, nodes, printed, params))


def one_of_each(docs: DataFrame, params: NearCopyParams = NearCopyParams()) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of each group of near copies the row with the smallest doc_id does."""
    # All that runs in Python is computed before the batches get their size back.
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(_BATCH_BYTES))
    sketch = docs.select(F.struct(*docs.columns).alias("row"), sketched(F.col("text"), params).alias("s"))
    printed = saved(sketch.select("row", "s.*", F.monotonically_increasing_id().alias("at")))
    found = components(links(printed.select("row.text", "fp", "simhash", "bands", "marks", "n"), params))
    conf.set(key, before)
    return kept_rows(printed.select("row", "fp", "at"), found)
