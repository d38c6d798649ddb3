"""Exact duplicates by composable polynomial fingerprints.

A text counts with A-Z lower-cased, as UTF-8 bytes. The fingerprint of bytes b1..bn is b1*r^(n-1) + ... + bn modulo a prime,
so fingerprints of consecutive pieces combine: h(xy) = h(x) * r^len(y) + h(y). A text of at most one chunk is hashed where it
is read. A longer one is cut into chunks, which are spread over the tasks and hashed apart; each is shifted by the length
behind it, and a text's fingerprint is the sum over its chunks, in any order.

Equal length and fingerprint only make a candidate. The candidates' chunks are then compared: of each candidate group and
chunk number, the smallest and the largest chunk must be the same. That streams through the texts, combines before the shuffle
and takes no join, so a group of copies may hold any share of the rows. Where they differ, the group's texts are hashed
again with another r and compared again, until all chunks agree: the classes are exact, whatever collides.

Edge cases: a null text counts as empty. Of equal rows, one with the largest doc_id stays; if several have it, one of them;
rows without a doc_id stay only where no copy has one. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import read, saved, text_array, utf8_bytes


@dataclass(frozen=True)
class ExactParams:
    """Bytes of a chunk, at most 2**24, as sums are kept in 64 bits; the prime modulus; the seed of the multipliers."""

    chunk_bytes: int = 65_536
    modulus: int = (1 << 61) - 1
    seed: int = 42
    salts: int = 16


CLASS = ["n_bytes", "try", "fp"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LIMB = 31


def multiplier(attempt: int, params: ExactParams = ExactParams()) -> int:
    """The r of an attempt."""
    return int(np.random.default_rng([params.seed, attempt]).integers(256, params.modulus - 1))


def combine(left: int, right: int, right_bytes: int, attempt: int = 0, params: ExactParams = ExactParams()) -> int:
    """The fingerprint of two pieces in a row, of which the second is right_bytes long."""
    return (left * pow(multiplier(attempt, params), right_bytes, params.modulus) + right) % params.modulus


class _Hasher:
    """Fingerprints of pieces of at most chunk_bytes bytes."""

    def __init__(self, attempt: int, params: ExactParams):
        self.p, self.r = params.modulus, multiplier(attempt, params)
        powers, x = [], 1
        for _ in range(params.chunk_bytes):
            powers.append(x)
            x = x * self.r % self.p
        falling = np.array(powers[::-1], dtype=np.int64)
        # Limbs of 31 bits: a byte times a limb, summed over a chunk, stays below 2**63.
        self.low, self.high = falling & ((1 << _LIMB) - 1), falling >> _LIMB

    def __call__(self, piece: np.ndarray, behind: int = 0) -> int:
        """The part that a piece of lower-cased bytes adds to a text that goes on for `behind` bytes."""
        if not len(piece):
            return 0
        values = piece.astype(np.int64)
        h = (int(values @ self.high[-len(piece) :]) << _LIMB) + int(values @ self.low[-len(piece) :])
        return h * pow(self.r, behind, self.p) % self.p if behind else h % self.p


@functools.lru_cache(4)
def _hasher(attempt: int, params: ExactParams) -> _Hasher:
    """A hasher per worker, as its table of powers takes a while to make."""
    return _Hasher(attempt, params)


def _pieces(column: pa.Array) -> list[np.ndarray]:
    """The lower-cased bytes of each row of a string or binary column, as views of one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).view(pa.large_string())
    raw, lengths = utf8_bytes(text_array(column))
    return np.split(_LOWER[raw], np.cumsum(lengths)[:-1]) if len(lengths) else []


def _fingerprint(body: Column, behind: Column, attempt: int, params: ExactParams) -> Column:
    @F.arrow_udf("long")
    def hashed(texts: pa.Array, after: pa.Array) -> pa.Array:
        h = _hasher(attempt, params)
        return pa.array([h(p, b) for p, b in zip(_pieces(texts), after.to_pylist())], pa.int64())

    return hashed(body, behind)


def text_sha256(text: Column) -> Column:
    """SHA-256 of the lower-cased text in hex."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(p).hexdigest() for p in _pieces(column)], pa.string())

    return digest(text)


def _lowered(chunk: Column) -> Column:
    @F.arrow_udf("binary")
    def low(column: pa.Array) -> pa.Array:
        return pa.array([p.tobytes() for p in _pieces(column)], pa.binary())

    return low(chunk)


def _chunks(rows: DataFrame, params: ExactParams) -> DataFrame:
    """The columns of rows (one of them `body`, binary), once per chunk: at (its number) and chunk in place of body; an empty body has one."""
    size = params.chunk_bytes
    last = F.expr(f"CAST(greatest(octet_length(body) - 1, 0) DIV {size} AS INT)")
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return numbered.select(*[c for c in rows.columns if c != "body"], "at", F.substring("body", F.col("at") * size + 1, F.lit(size)).alias("chunk"))


class _Texts:
    """The texts of docs, short ones read from docs and long ones from a numbered copy, with fingerprints of any attempt."""

    def __init__(self, docs: DataFrame, extra: dict[str, Column], params: ExactParams):
        self.params, self.extra = params, extra
        text = F.coalesce("text", F.lit(""))
        rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        self.short = rows.where(F.col("n_bytes") <= params.chunk_bytes)
        long_ = rows.where(F.col("n_bytes") > params.chunk_bytes)
        self.long = saved(long_.withColumn("row", F.monotonically_increasing_id()))
        self._combined: dict[int, DataFrame] = {}

    def combined(self, attempt: int) -> DataFrame:
        """row and fp of the long texts: chunks hashed wherever they are, and added up; saved."""
        if attempt not in self._combined:
            self._combined[attempt] = saved(self._added_up(attempt))
        return self._combined[attempt]

    def _added_up(self, attempt: int) -> DataFrame:
        bodies = self.long.select("row", "n_bytes", F.col("text").cast("binary").alias("body"))
        spread = _chunks(bodies, self.params).repartition("row", "at")
        end = F.least("n_bytes", (F.col("at") + 1).cast("long") * self.params.chunk_bytes)
        part = _fingerprint(F.col("chunk"), F.col("n_bytes") - end, attempt, self.params).cast("decimal(20,0)")
        total = F.sum("part") % F.lit(self.params.modulus).cast("decimal(20,0)")
        return spread.select("row", part.alias("part")).groupBy("row").agg(total.cast("long").alias("fp"))

    def printed(self, attempt: int, with_text: bool = False) -> DataFrame:
        """doc_id, n_bytes, fp and the extra columns of every row, or its text in their place."""
        more = [F.col("text")] if with_text else [c.alias(name) for name, c in self.extra.items()]
        fp = _fingerprint(F.col("text"), F.lit(0).cast("long"), attempt, self.params)
        short = self.short.select("doc_id", "n_bytes", fp.alias("fp"), *more)
        return short.unionByName(self.long.join(self.combined(attempt), "row").select("doc_id", "n_bytes", "fp", *more))


def _met(rows: DataFrame, keys: DataFrame, on: list[str], how: str, params: ExactParams) -> DataFrame:
    """rows joined with keys (unique in `on`): by broadcast if keys were counted small, else with hot keys of rows spread by salt."""
    if keys.limit(100_001).count() <= 100_000:
        return rows.join(F.broadcast(keys), on, how)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(params.salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def _differing(texts: DataFrame, params: ExactParams) -> DataFrame:
    """The n_bytes and fp under which texts (n_bytes, fp, text) hold more than one content; saved."""
    bodies = texts.select("n_bytes", "fp", F.col("text").cast("binary").alias("body"))
    compared = _chunks(bodies, params).select("n_bytes", "fp", "at", _lowered(F.col("chunk")).alias("chunk"))
    extremes = compared.groupBy("n_bytes", "fp", "at").agg((F.min("chunk") == F.max("chunk")).alias("same"))
    return saved(extremes.where("NOT same").select("n_bytes", "fp").distinct())


def classes(docs: DataFrame, extra: dict[str, Column] | None = None, params: ExactParams = ExactParams()) -> DataFrame:
    """doc_id, row (unique), n_bytes, try, fp and the extra columns (expressions of `text`) of every row of docs; saved.

    Rows have equal n_bytes, try and fp exactly if their texts are equal but for the case of A-Z.
    """
    texts = _Texts(docs.select("doc_id", "text"), extra or {}, params)
    found = saved(texts.printed(0).select("*", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("try")))
    key = ["n_bytes", "fp"]

    def several(rows: DataFrame) -> DataFrame:
        return saved(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))

    unsure, attempt = several(found), 0
    bodies = texts.printed(0, with_text=True)
    while True:
        candidates = _met(bodies, unsure, key, "left_semi", params)
        bad = _differing(candidates, params)
        if bad.isEmpty():
            return found
        # Different texts share a fingerprint: theirs are told apart by another multiplier, and looked at again.
        attempt += 1
        mixed = saved(_met(candidates, bad, key, "left_semi", params).select("doc_id", "n_bytes", F.col("fp").alias("fp_before"), "text"))
        again = _Texts(mixed.select("doc_id", "text"), texts.extra, params)
        fine = _met(found.where(F.col("try") == attempt - 1), bad, key, "left_anti", params)
        rest = again.printed(attempt).select("*", (F.monotonically_increasing_id() + F.lit(attempt << 52)).alias("row"), F.lit(attempt).alias("try"))
        found = saved(found.where(F.col("try") < attempt - 1).unionByName(fine.select(*found.columns)).unionByName(rest.select(*found.columns)))
        unsure, bodies = several(found.where(F.col("try") == attempt)), again.printed(attempt, with_text=True)


def groups(docs: DataFrame, extra: dict[str, Column] | None = None, params: ExactParams = ExactParams()) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the extra columns of every row of docs: exactly one row of each group is kept."""
    found = classes(docs, extra, params)
    # Combined before the shuffle, so copies of one text are one row per task.
    best = F.max(F.struct("doc_id", "row")).alias("best")
    repeated = saved(found.groupBy(*CLASS).agg(best, F.count("*").alias("group_size")).where("group_size > 1"))
    told = _met(found, repeated, CLASS, "left", params)
    return told.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        *(extra or {}),
    )


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and whether it is the one that stays."""
    return groups(read(spark, sf_dir, "documents"), {"text_sha256": text_sha256(F.col("text"))})


# The lower-casing is of A-Z alone.
OP11_SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)"""
