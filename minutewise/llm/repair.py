"""Token ids on disk by grammar compression: pairs that are frequent in a shard become rules (Re-Pair).

A shard holds the ids of consecutive documents. In each round the frequent adjacent pairs are counted over the whole
shard, each becomes a nonterminal, and its occurrences are replaced from left to right, until no pair is left with
least_count occurrences; pairs never reach past the end of a document. A file holds per shard the rules, the length each nonterminal expands to, and where each
document's symbols begin, so that one document, or a stretch of ids, is decoded without the rest.

The files are Parquet with one row per shard:
  part, shard           order of the shards; ids of lower (part, shard) come first
  doc_ids, n_ids        the documents in order and their numbers of ids, the end id included
  first_symbol          per document, where its symbols begin
  base                  the lowest nonterminal; smaller symbols are ids
  rules, expansion      per nonterminal: left and right symbol, all in turn; its number of ids
  wide, symbols         the symbols
Symbols are little-endian uint16 unless wide; rules, expansion and wide symbols are the low halves of all numbers, then the
high halves, each as little-endian uint16, as the high halves hardly take room once compressed.

Edge cases: a null text counts as empty and has the end id alone. Rows without a doc_id come first; rows that share a
doc_id, or have none, are ordered by the text's first 64 characters, then by its hash, and may lie in several parts. An empty table gives files without rows. A text of any length is kept whole in
one shard, which it may outgrow.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minutewise.llm.common import if_small, lists, read, saved, text_array
from minutewise.llm.pieces import word_encoder
from minutewise.session import shared_folder


@dataclass(frozen=True)
class RepairParams:
    """Tokenizer file (same path on every executor), end id, shard size, pairs replaced at a time, and their least count."""

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    end_id: int = 1
    shard_ids: int = 1 << 20
    pairs_per_round: int = 16_384
    least_count: int = 8


SHARD_ROW = (
    "part int, shard int, doc_ids array<long>, n_ids array<int>, first_symbol array<int>, base long, "
    "rules binary, expansion binary, wide boolean, symbols binary, total long"
)


# ---- the grammar of one shard -----------------------------------------------------------------------


BIN_BITS = 18


def _bins(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int32)


def _frequent(keys: np.ndarray, bins: np.ndarray, params: RepairParams) -> np.ndarray:
    """The most frequent keys, at most pairs_per_round, each with least_count occurrences and a bin of its own."""
    counts = np.bincount(bins, minlength=1 << BIN_BITS)
    bound = max(params.least_count, int(np.partition(counts, -params.pairs_per_round)[-params.pairs_per_round]))
    distinct, n = np.unique(keys[(counts >= bound)[bins]], return_counts=True)
    order = np.argsort(-n, kind="stable")[: params.pairs_per_round]
    chosen = distinct[order[n[order] >= params.least_count]]
    # Of pairs that share a bin the more frequent one goes first; the other's turn comes in a later round.
    return np.sort(chosen[np.unique(_bins(chosen), return_index=True)[1]])


def compress(ids: np.ndarray, ends: np.ndarray, base: int, params: RepairParams):
    """(symbols, last, rules) of a shard; ends: True at the last id of each document, as last is for symbols."""
    symbols, last, rules = ids.astype(np.uint64), ends.copy(), np.zeros((0, 2), dtype="<u4")
    while len(symbols) > 1:
        inside = np.flatnonzero(~last[:-1])
        keys = (symbols[:-1] << np.uint64(32) | symbols[1:])[inside]
        bins = _bins(keys)
        chosen = _frequent(keys, bins, params)
        if not len(chosen):
            break
        slot = np.zeros(1 << BIN_BITS, dtype=np.int32)
        slot[_bins(chosen)] = np.arange(len(chosen))
        which = slot[bins]
        hit = chosen[which] == keys
        at, which = inside[hit], which[hit]
        # Of pairs that overlap, every other one from the left is replaced.
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        at, which = at[offset % 2 == 0], which[offset % 2 == 0]
        used = np.bincount(which, minlength=len(chosen)) > 0
        symbols[at] = (base + len(rules) + np.cumsum(used) - 1).astype(np.uint64)[which]
        pairs = np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], axis=1)
        rules = np.concatenate([rules, pairs.astype("<u4")])
        last[at] = last[at + 1]
        left = np.ones(len(symbols), dtype=bool)
        left[at + 1] = False
        symbols, last = symbols[left], last[left]
    return symbols, last, rules


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for; rules use ids and earlier nonterminals only."""
    sizes = np.ones(len(rules), dtype="<u4")
    for k, pair in enumerate(rules.tolist()):
        sizes[k] = sum(1 if s < base else int(sizes[s - base]) for s in pair)
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while len(rules) and (big := symbols >= base).any():
        out = np.repeat(symbols, 1 + big)
        first = np.cumsum(1 + big) - (1 + big)
        pair = rules[symbols[big] - base]
        out[first[big]], out[first[big] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols.astype("<u4")


def stretch(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of what symbols stand for, expanding only the symbols that reach into it."""
    length = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= base
    length[big] = sizes[symbols[big].astype(np.int64) - base]
    ends = np.cumsum(length)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, base)[start - skipped : stop - skipped]


def halves(numbers: np.ndarray) -> bytes:
    """The low 16 bits of all numbers, then the high ones."""
    return np.ascontiguousarray(numbers.astype("<u4")).view("<u2").reshape(-1, 2).T.tobytes()


def from_halves(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, "<u2").reshape(2, -1).astype("<u4")
    return low | high << 16


# ---- files ------------------------------------------------------------------------------------------


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@functools.cache
def _encoder(path: str):
    return word_encoder(_tokenizer(path))


def _shard_row(part: int, shard: int, doc_ids: list, coded: list[bytes], params: RepairParams) -> dict:
    counts = np.array([len(c) // 4 for c in coded], dtype=np.int64)
    ids = np.frombuffer(b"".join(coded), "<u4")
    ends = np.zeros(len(ids), dtype=bool)
    ends[np.cumsum(counts) - 1] = True
    base = max(_tokenizer(params.tokenizer).get_vocab_size(), params.end_id + 1, int(ids.max()) + 1)
    symbols, last, rules = compress(ids, ends, base, params)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    wide = base + len(rules) > 1 << 16
    return {
        "part": part, "shard": shard, "doc_ids": doc_ids, "n_ids": counts.tolist(), "first_symbol": first.tolist(),
        "base": base, "rules": halves(rules.ravel()), "expansion": halves(expansions(rules, base)), "wide": wide,
        "symbols": halves(symbols) if wide else symbols.astype("<u2").tobytes(), "total": len(ids),
    }


def _arrow_schema() -> pa.Schema:
    long_list, int_list = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", long_list), ("n_ids", int_list),
        ("first_symbol", int_list), ("base", pa.int64()), ("rules", pa.binary()), ("expansion", pa.binary()),
        ("wide", pa.bool_()), ("symbols", pa.binary()), ("total", pa.int64()),
    ])


def write_ids(docs: DataFrame, path: str, params: RepairParams = RepairParams()) -> None:
    """Encode the columns doc_id and text of docs and write them in ascending doc_id order."""
    end = np.array([params.end_id], dtype="<u4").tobytes()

    def shards(batches):
        encode = _encoder(params.tokenizer)
        doc_ids, coded, held, shard, part = [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_pylist([_shard_row(part, shard, doc_ids, coded, params)], schema=_arrow_schema())

        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(text_array(batch.column("text")).to_pylist())):
                doc_ids.append(doc_id)
                coded.append(ids + end)
                held += len(coded[-1]) // 4
                if held >= params.shard_ids:
                    yield flush()
                    doc_ids, coded, held, shard = [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    # Ranges also part the rows of one id, or of none, so no id fills a task.
    keyed = docs.select("doc_id", "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("key"))
    order = ["doc_id", "head", "key"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("head", "key")
    rows = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(shards, SHARD_ROW)
    rows.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a written table with `start`, the number of ids before each."""
    shards = spark.read.schema(SHARD_ROW).parquet(path)
    totals = shards.select("part", "shard", "total")
    # One row per written partition; within each, one row per shard.
    earlier = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("total").alias("total")).select("part", earlier(Window.orderBy("part")).alias("part_start"))
    within = totals.select("part", "shard", earlier(Window.partitionBy("part").orderBy("shard")).alias("shard_start"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("start"))
    return shards.join(if_small(saved(starts), 1_000_000), ["part", "shard"])


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    symbols = from_halves(row["symbols"]) if row["wide"] else np.frombuffer(row["symbols"], "<u2")
    return symbols, from_halves(row["rules"]).reshape(-1, 2), from_halves(row["expansion"]), row["base"]


def document_ids(row: dict, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of the k-th document of a shard row, decoding nothing else."""
    symbols, rules, sizes, base = _opened(row)
    bounds = [*row["first_symbol"], len(symbols)]
    n = row["n_ids"][k]
    return stretch(symbols[bounds[k] : bounds[k + 1]], rules, sizes, base, start, n if stop is None else min(stop, n))


def _expanded(batches):
    """Each shard of Arrow batches of shards: doc_ids, starts, numbers of ids, and the ids of all documents."""
    for batch in batches:
        for row in batch.to_pylist():
            symbols, rules, _, base = _opened(row)
            counts = np.array(row["n_ids"], dtype=np.int64)
            yield pa.array(row["doc_ids"], pa.int64()), row["start"] + np.cumsum(counts) - counts, counts, expand(symbols, rules, base)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document of a written table."""

    def documents(batches):
        for doc_ids, starts, counts, ids in _expanded(batches):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), lists(ids.view("<i4"), counts)], names=["doc_id", "start", "ids"])

    return read_shards(spark, path).mapInArrow(documents, "doc_id long, start long, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the little-endian ids of every document of a written table."""

    def documents(batches):
        for doc_ids, starts, counts, ids in _expanded(batches):
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return read_shards(spark, path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_repair_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, as read back from the written files."""
    path = shared_folder(spark)
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_checksums(spark, path)
