"""Nearest neighbours by randomly rotated one-bit codes with error bounds, and exact reranking.

Every vector is centred, rotated at random and kept as one sign bit per dimension with two scalars: its length, and the
inner product of the rotated unit vector with its own code. From the packed bits and these scalars follow an estimate
of the inner product with any query and a bound on its error. A vector is reranked on the original numbers only if its
bound lets it be among the nearest; the others are passed over on the bits alone.

Queries are a stated set that meets all rows in blocks: a block holds about as many bytes of rows as of queries, spread
by a hash of the row, so that equal vectors don't gather anywhere. With both sides equal the fewest copies are shuffled: a
table of n vectors and q queries of b bytes ships 2 * n * q * b * b / block_bytes. Every vector is a candidate for every query.

Edge cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, as query or as
candidate; nor do rows without an id. Vectors of another length than the query's are no candidates. Ties go to the
smaller id. With fewer candidates than k all are returned. Rows that share an id are each a candidate, and each a
query with ranks of its own, which only leaves itself out. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutewise.llm.common import read, saved


@dataclass(frozen=True)
class RabitqParams:
    """Neighbours wanted, width of the error bound (in standard errors), seed of the rotation, bytes of a block's side.

    Vectors are centred for the centred_lengths most frequent lengths. The bounds of other vectors are wider; their
    neighbours are the same.
    """

    k: int = 10
    bound: float = 4.0
    seed: int = 5
    block_bytes: int = 16 << 20
    centred_lengths: int = 16


INDEX_ROW = "row long, vec_id long, dim int, embedding array<double>, code binary, length double, fit double"
FOUND_ROW = "query long, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, inner product of the unit vector with its code) of each row."""
    turned = (vectors - centre) @ turn
    length = np.sqrt((turned**2).sum(axis=1))
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def estimate(code: np.ndarray, length: np.ndarray, fit: np.ndarray, query: np.ndarray, bound: float):
    """Lower and upper bound of the squared distance of a centred, rotated query to each coded vector."""
    dim = len(query)
    padded = np.zeros(code.shape[1] * 8)
    padded[:dim] = query
    # Sum of the query's components under the set bits, by one table of 256 entries per byte of the code.
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    under = sum((bits @ padded[8 * j : 8 * j + 8])[code[:, j]] for j in range(code.shape[1]))
    own = np.sqrt((query**2).sum())
    inner = (2 * under - query.sum()) / np.sqrt(dim) / fit
    error = bound * own * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dim - 1, 1))
    base = length**2 + own**2
    slack = 1e-9 * base  # rounding of the estimate itself
    return base - 2 * length * (inner + error) - slack, base - 2 * length * (inner - error) + slack


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += (vectors[:, j] - query[j]) ** 2
    return np.sqrt(total)


def centres(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The mean of the vectors of each of the most frequent lengths, summed up by task first."""
    length = F.size("embedding")
    usual = vectors.groupBy(length.alias("dim")).count().orderBy(F.desc("count"), "dim").limit(most).collect()
    vectors = vectors.where(length.isin([r["dim"] for r in usual]))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in _by_length(batch.column("embedding")):
                total[dim] = total.get(dim, np.zeros(dim + 1)) + np.append(rows.sum(axis=0), len(rows))
        yield pa.RecordBatch.from_pylist(
            [{"dim": d, "j": j, "x": float(x)} for d, t in total.items() for j, x in enumerate(t)],
            schema=pa.schema([("dim", pa.int32()), ("j", pa.int32()), ("x", pa.float64())]),
        )

    found: dict[int, dict[int, float]] = {}
    for r in vectors.select("embedding").mapInArrow(sums, "dim int, j int, x double").groupBy("dim", "j").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["dim"], {})[r["j"]] = r["x"]
    return {d: np.array([t[j] for j in range(d)]) / t[d] for d, t in found.items()}


def _by_length(column: pa.Array):
    lengths = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()).astype(np.float64), np.cumsum(lengths)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def build_index(vectors: DataFrame, params: RabitqParams = RabitqParams()) -> DataFrame:
    """INDEX_ROW of every usable row of vectors (columns vec_id, embedding), saved."""
    plain = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    middle = centres(plain, params.centred_lengths)

    def coded(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            n = len(batch)
            lengths = np.asarray(batch.column("embedding").value_lengths())
            code, length, fit = np.empty(n, dtype=object), np.zeros(n), np.zeros(n)
            for dim, rows in _by_length(batch.column("embedding")):
                turn = turns.setdefault(dim, rotation(dim, params.seed))
                bits, own, part = encode(rows, middle.get(dim, np.zeros(dim)), turn)
                at = lengths == dim
                code[at] = [b.tobytes() for b in bits]
                length[at], fit[at] = own, part
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), pa.array(lengths, pa.int32()), batch.column("embedding"), pa.array(code.tolist(), pa.binary()), pa.array(length), pa.array(fit)],
                names=["row", "vec_id", "dim", "embedding", "code", "length", "fit"],
            )

    named = plain.withColumn("row", F.monotonically_increasing_id())
    return saved(named.mapInArrow(coded, INDEX_ROW)).withColumn("middle", _middle(middle))


def _middle(middle: dict[int, np.ndarray]) -> Column:
    out = F.lit(None).cast("array<double>")
    for dim, centre in middle.items():
        out = F.when(F.col("dim") == dim, F.array(*[F.lit(float(x)) for x in centre])).otherwise(out)
    return out


def nearest_in_block(queries: pa.Table, rows: pa.Table, params: RabitqParams):
    """FOUND_ROW of the nearest rows of a block for each query."""
    found = []
    if len(queries) and len(rows):
        dim = queries.column("dim")[0].as_py()
        matrix = lambda t: np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(-1, dim)
        ids, vectors = rows.column("vec_id").to_numpy(), matrix(rows)
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
        length, fit = rows.column("length").to_numpy(), rows.column("fit").to_numpy()
        middle = queries.column("middle")[0].as_py()
        centre = np.zeros(dim) if middle is None else np.array(middle)
        asked = matrix(queries)
        turned = (asked - centre) @ rotation(dim, params.seed)
        names = rows.column("row").to_numpy()
        for name, query_id, query, q in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), asked, turned):
            low, high = estimate(code, length, fit, q, params.bound)
            other = names != name
            low, high, at = low[other], high[other], np.flatnonzero(other)
            if len(at) > params.k:
                at = at[low <= np.partition(high, params.k - 1)[params.k - 1]]
            score = distances(vectors[at], query)
            best = np.lexsort((ids[at], score))[: params.k]
            found.append((np.full(len(best), name), np.full(len(best), query_id), ids[at][best], score[best]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [*[np.zeros(0, np.int64)] * 3, np.zeros(0)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, params: RabitqParams = RabitqParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the index for each of queries, rows of an index themselves."""
    blocks = lambda frame: max(1, -(-(frame.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) * 8 // params.block_bytes))
    spots, parts = blocks(index), blocks(queries)
    spot = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(spots))
    part = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = index.drop("middle").withColumn("spot", spot).withColumn("part", every(parts))
    asked = queries.drop("code", "length", "fit").withColumn("part", part).withColumn("spot", every(spots))
    keys = ["dim", "spot", "part"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda q, r: nearest_in_block(q, r, params), FOUND_ROW)
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_rabitq(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    index = build_index(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(index, index.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(c.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pair
WINDOW w AS (PARTITION BY r ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""
