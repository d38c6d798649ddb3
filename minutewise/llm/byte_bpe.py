"""Byte-level BPE: ids, character offsets and exact decoding, over Arrow batches.

The rank file lists byte strings in merge order. A tokenizer of the tokenizers library is made from it: every byte
string is spelled with one printable character per byte, and every way to split a listed string into two listed ones
is a merge with that string's rank, which is what merging by rank means. Decoding goes back through the table from
characters to bytes; a character whose bytes lie in several tokens comes back whole, as bytes are joined first.

Edge cases: a null text counts as empty, and an empty text has no ids. Texts of any length are encoded whole. Special
tokens are never recognised: their strings are ordinary text. Ids out of range make decoding fail.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from minutewise.llm.common import lists, read, stretches, text_array
from minutewise.llm.pieces import KEPT_PIECES, byte_characters, byte_level_encoder


@dataclass(frozen=True)
class BytePairParams:
    """The rank file and the pattern that cuts texts; the file must be at the same path on every executor."""

    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN


@functools.cache
def ranked(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def tokenizer(params: BytePairParams) -> Tokenizer:
    """The ranks as a tokenizer; made once in each worker."""
    ranks = ranked(params.ranks)
    characters = byte_characters()
    spelled = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = [
        (spelled[token[:k]], spelled[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    model = models.BPE(
        vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0
    )
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(params.pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made


# Bytes of text cut into pieces at a time: a whole batch. Fewer take less room, as pieces take many times that of their text, and more time.
AT_ONCE = 1 << 40


@functools.cache
def _encoder(params: BytePairParams, kept: int = KEPT_PIECES):
    return byte_level_encoder(tokenizer(params), kept)


@functools.cache
def _table(params: BytePairParams) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id, read back from the characters of the vocabulary, and their number."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer(params).get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for spelled, number in vocabulary.items():
        tokens[number] = bytes(back[c] for c in spelled)
    return tokens, np.array([len(t) for t in tokens], dtype=np.int64)


def _encode(texts: pa.Array, params: BytePairParams, kept: int = KEPT_PIECES, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    found = [ids for some in stretches(texts, at_once) for ids in _encoder(params, kept)(some.to_pylist())]
    return np.frombuffer(b"".join(found), "<i4"), np.array([len(f) // 4 for f in found], dtype=np.int64)


def encode(params: BytePairParams = BytePairParams(), kept: int = KEPT_PIECES, at_once: int = AT_ONCE):
    """A function of a text column that gives the ids, array<int>. kept, at_once: pieces that a worker keeps, and bytes that it cuts at a time."""

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        return lists(*_encode(text_array(text), params, kept, at_once))

    return ids


def encode_with_offsets(params: BytePairParams = BytePairParams()):
    """A function of a text column that gives struct<ids, starts, ends>: ids with the code points that they cover.

    Tokens that share the bytes of one character all cover it.
    """

    @F.arrow_udf("struct<ids: array<int>, starts: array<int>, ends: array<int>>")
    def offsets(text: pa.Array) -> pa.Array:
        texts = text_array(text)
        ids, counts = _encode(texts, params)
        lengths = _table(params)[1]
        starts, ends, at = [], [], 0
        for value, n in zip(texts.to_pylist(), counts):
            raw = np.frombuffer(value.encode(), np.uint8)
            character = np.cumsum((raw & 0xC0) != 0x80) - 1
            size = lengths[ids[at : at + n]]
            last = np.cumsum(size)
            starts.append(character[last - size])
            ends.append(character[last - 1] + 1)
            at += n
        flat = lambda x: lists(np.concatenate([*x, np.zeros(0)]).astype(np.int32), counts)
        return pa.StructArray.from_arrays([lists(ids, counts), flat(starts), flat(ends)], names=["ids", "starts", "ends"])

    return offsets


@functools.cache
def _strings(params: BytePairParams) -> tuple[pa.Array, pa.Array]:
    """The bytes of every id, and its decimal digits."""
    table = _table(params)[0]
    return pa.array(table, pa.binary()), pa.array([str(k) for k in range(len(table))], pa.string())


def decode(params: BytePairParams = BytePairParams()):
    """A function of an id list column that gives the bytes; null for null."""

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        taken = _strings(params)[0].take(ids.flatten())
        # The bytes of all ids lie in one row already; a text is what lies between its first and its last.
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[ends] if len(taken) else np.zeros(len(ends), np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary()))

    return raw


def ids_digest(ids, params: BytePairParams = BytePairParams()):
    """sha256 of the decimal ids of a list column, joined by one space."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        digits = _strings(params)[1].take(column.flatten())
        ends = np.cumsum([0, *pc.fill_null(column.value_lengths(), 0).to_pylist()]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), digits), " ")
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())

    return digest(ids)


def round_trip(docs: DataFrame, params: BytePairParams = BytePairParams(), kept: int = KEPT_PIECES, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row of docs. kept, at_once: as of encode."""
    ids = docs.select("doc_id", encode(params, kept, at_once)(F.col("text")).alias("ids"))
    return ids.select("doc_id", "ids", decode(params)(F.col("ids")).alias("decoded"))


def digested(coded: DataFrame, *more: str) -> DataFrame:
    """What round_trip gives, as counts and digests; and more of its columns."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return digested(round_trip(read(spark, sf_dir, "documents").select("doc_id", "text")))
