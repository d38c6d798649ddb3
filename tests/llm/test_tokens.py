"""Byte-level BPE against tiktoken, and grammar-compressed ids against the tokenizers library."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from frames import LONG, ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minutewise.llm import byte_bpe, repair


@pytest.fixture(scope="module")
def exact():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_of_odd_texts(spark, exact):
    frame = docs(spark, ODD)
    got = byte_bpe.round_trip(frame).join(byte_bpe.digested(byte_bpe.round_trip(frame)).dropDuplicates(["doc_id"]), "doc_id").collect()
    texts = {i: t or "" for i, t in ODD if i is not None}
    assert len(got) == sum(i is not None for i, _ in ODD)
    for r in got:
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "\n a", "a\n \nb", "it's  we'll\t x", "x   y　 z", "\x1c \x1d a", "1 22 ½²", "日本 語", "👩‍👩‍👧 é"])
def test_pieces_are_cut_where_the_pattern_cuts(exact, text):
    assert np.frombuffer(byte_bpe._encoder(byte_bpe.BytePairParams())([text])[0], "<u4").tolist() == exact.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBé .,'!\n\t1_-ß日 s", max_size=40))
def test_pieces_of_any_text(exact, text):
    assert np.frombuffer(byte_bpe._encoder(byte_bpe.BytePairParams())([text])[0], "<u4").tolist() == exact.encode_ordinary(text)
    path = repair.RepairParams().tokenizer
    whole = repair._tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(repair._encoder(path)([text])[0], "<u4").tolist() == whole


def test_offsets_cover_split_characters(spark):
    text = "na👩ïve 日本語"
    row = docs(spark, [(1, text)]).select(byte_bpe.encode_with_offsets()(F.col("text")).alias("t")).first().t
    table = byte_bpe._table(byte_bpe.BytePairParams())[0]
    at = 0
    for number, start, end in zip(row.ids, row.starts, row.ends):
        raw = table[number]
        assert text.encode()[at : at + len(raw)] == raw
        assert len(text[:start].encode()) <= at and len(text[:end].encode()) >= at + len(raw)
        at += len(raw)
    assert row.ends[-1] == len(text)


def test_empty_table(spark):
    none = docs(spark, [])
    assert byte_bpe.digested(byte_bpe.round_trip(none)).collect() == []


def test_repair_grammar_round_trip():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50, 3000), np.tile([7, 8, 9, 8], 500)]).astype("<u4")
    ends = rng.random(len(ids)) < 0.01
    ends[-1] = True
    params = repair.RepairParams(pairs_per_round=64, least_count=4)
    symbols, last, rules = repair.compress(ids, ends, 1000, params)
    assert len(symbols) < 0.7 * len(ids) and last.sum() == ends.sum()
    # Nothing is left to replace: no pair within a document stands there least_count times without overlap.
    pairs, at = {}, {}
    for i in np.flatnonzero(~last[:-1]):
        pair = (int(symbols[i]), int(symbols[i + 1]))
        if at.get(pair, -2) < i - 1:
            pairs[pair], at[pair] = pairs.get(pair, 0) + 1, i
    assert max(pairs.values()) < 4
    assert (repair.expand(symbols, rules, 1000) == ids).all()
    sizes = repair.expansions(rules, 1000)
    assert all(len(repair.expand(np.array([1000 + k]), rules, 1000)) == n for k, n in enumerate(sizes))
    for start, stop in ((0, 1), (10, 900), (2999, 5000), (4990, 5000), (17, 17)):
        assert (repair.stretch(symbols, rules, sizes, 1000, start, stop) == ids[start:stop]).all()


def test_ids_on_disk(spark, tmp_path):
    path, params = str(tmp_path / "ids"), repair.RepairParams(shard_ids=500)
    repair.write_ids(docs(spark, ODD), path, params)
    got = repair.read_ids(spark, path).join(repair.read_checksums(spark, path), ["doc_id", "start"]).orderBy("start").collect()
    tk = Tokenizer.from_file(params.tokenizer)
    tk.encode_special_tokens = True
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    # Two rows have no id to join by.
    none = [r for r in repair.read_checksums(spark, path).orderBy("start").collect() if r.doc_id is None]
    assert len(none) == 2 and none[0].start == 0 and (none[0].n_tokens, none[0].ids_crc32) == (1, zlib.crc32(struct.pack("<I", 1)))
    at, ordered = none[0].n_tokens + none[1].n_tokens, ordered[2:]
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    for r, (_, text) in zip(got, ordered):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.ids) == (at, ids)
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    rows = [r.asDict() for r in repair.read_shards(spark, path).collect()]
    row = next(r for r in rows if 7 in r["doc_ids"])
    k = row["doc_ids"].index(7)
    assert repair.document_ids(row, k, 100, 200).tolist() == tk.encode(LONG, add_special_tokens=False).ids[100:200]


def test_no_ids_on_disk(spark, tmp_path):
    path = str(tmp_path / "none")
    repair.write_ids(docs(spark, []), path)
    assert repair.read_ids(spark, path).collect() == []
