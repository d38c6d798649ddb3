"""What a Python worker takes and keeps from one stage to the next."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from minutewise.llm import byte_bpe, language, pieces
from minutewise.llm.common import stretches


def test_stretches_hold_every_text_once():
    texts = pa.array(["", "a b", "x" * 10, "", "hello world " * 3, ""], pa.large_string())
    assert [s.to_pylist() for s in stretches(texts, 8)] == [["", "a b", "x" * 10], ["", "hello world " * 3], [""]]
    assert [s.to_pylist() for s in stretches(texts.slice(2, 2), 8)] == [["x" * 10], [""]]
    assert [len(s) for s in stretches(texts.slice(0, 0), 8)] == [0]


def test_a_batch_is_not_made_ngrams_at_once(spark):
    texts = pa.array(["one and the same line again, " * 700] * 200, pa.large_string())
    params = language.LanguageParams()
    model = language.LanguageModel(("a", "b"), np.ones((params.buckets + 1, 2), np.float32), 1.0, 0.0, params,
                                   np.zeros((params.buckets + 1, 2), np.float32), np.full((2, language.LENGTH_CLASSES), -np.inf))
    tracemalloc.start()
    found = language.identify(model).func(texts)
    assert len(found) == 200 and not any(found.field("rejected").to_pylist())
    assert len(language._counts(texts, params)[0]) == 200
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * texts.nbytes


def test_pieces_kept_are_bounded_and_ids_stay():
    texts = pa.array([" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}, ab{k % 7}" for k in range(j, j + 300)) for j in range(0, 3000, 150)], pa.large_string())
    params = byte_bpe.BytePairParams()
    whole = byte_bpe._encode(texts, params)
    few = byte_bpe._encode(texts, params, 500, 2_000)
    assert (whole[0] == few[0]).all() and (whole[1] == few[1]).all()
    spaced = byte_bpe._encoder(params, 500).__closure__
    held = [c.cell_contents for c in spaced if isinstance(c.cell_contents, pieces.Pieces)]
    assert held and all(len(p._known) <= 700 and len(p._before) <= 700 for p in held)
    assert corpus_pipeline.KEPT_PIECES < byte_bpe.KEPT_PIECES and corpus_pipeline.AT_ONCE < byte_bpe.AT_ONCE
