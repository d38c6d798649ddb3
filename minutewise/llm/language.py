"""Language identification: averaged hashed subword embeddings with a linear softmax.

Training is stochastic gradient descent in numpy on a bounded sample; prediction scores every whole text. A text's
vector is the mean of the embeddings of its hashed byte n-grams. As the softmax is linear, embedding and output
matrix are multiplied once, and a text's logits are the mean of one table row per n-gram.

A softmax is sure of gibberish too, so rejection rests on a second measure: how usual a text's n-grams are in the language told,
as the mean log share of their buckets in training. Its bounds are calibrated by length on held-back texts and pieces of them.

Edge cases: a null text, an empty one and one without a letter get `und`, score 0 and are rejected. Where nothing
can be learned (no labelled row) every text gets `und`. Ties go to the language that sorts first. Repeated rows
are scored alike; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import held_out, lists, read, stretches, text_array, utf8_bytes

UNKNOWN = "und"

# The n-grams of a text take some tens of times its bytes, and a worker keeps what it once took; so a batch is not worked on at once.
STRETCH_BYTES = 1 << 19


@dataclass(frozen=True)
class LanguageParams:
    """Size of the model and of the sample it is fitted on."""

    buckets: int = 1 << 14
    dim: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    # The sample: about this many documents of each language, chosen by a hash of the id; all if fewer.
    docs_per_language: int = 600
    # The set of languages must be a closed one.
    max_languages: int = 1024
    epochs: int = 8
    rate: float = 0.5
    # Of the correctly told held-back texts, about this share may fall below the rejection bound at most.
    lost: float = 0.001
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets + 1, languages); the last row is zero
    temperature: float
    reject_below: float
    params: LanguageParams
    usual: np.ndarray | None = None  # like table: log shares of the buckets in each language
    # Least mean log share of a text with 4**k to 4**(k+1) n-grams, by language and k.
    usual_below: np.ndarray | None = None


# Letters and whatever lies beyond ASCII stay; digits, signs and white space become one separator.
_KEEP = np.full(256, 32, dtype=np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def ngrams(texts: pa.Array, params: LanguageParams) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Bucket of the byte n-gram at each position, one order after the other, and the byte length of each text.

    An n-gram that would leave its text has the bucket number `buckets`.
    """
    raw, lengths = utf8_bytes(pc.utf8_lower(texts))
    code = np.concatenate([_KEEP[raw], np.zeros(max(params.orders), dtype=np.uint32)])
    ends = np.cumsum(lengths)

    def of(order: int) -> np.ndarray:
        h = np.full(len(raw), 2166136261 + order, dtype=np.uint32)
        for j in range(order):
            h ^= code[j : j + len(raw)]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h %= np.uint32(params.buckets)
        for back in range(1, order):
            at = ends - back
            h[at[(at >= ends - lengths) & (lengths > 0)]] = params.buckets
        return h.view(np.int32)

    return map(of, params.orders), lengths


def _counts(texts: pa.Array, params: LanguageParams) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = []
    for some in stretches(texts, STRETCH_BYTES):
        grams, lengths = ngrams(some, params)
        grams = np.stack([*grams])
        ends = np.cumsum(lengths)
        for start, end in zip(ends - lengths, ends):
            ids, n = np.unique(grams[:, start:end], return_counts=True)
            real = ids < params.buckets
            found.append((ids[real], n[real]))
    return [f[0] for f in found], [f[1] for f in found]


LENGTH_CLASSES = 16
# A class needs so many held-back texts for a bound, which lies so far down the way from their low quantile to n-grams by chance.
LEAST_CALIBRATED, MARGIN = 20, 1 / 3


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n, 1)) // 2, 0, LENGTH_CLASSES - 1).astype(np.int64)


def _pieces(texts: pa.Array) -> pa.Array:
    """A piece of each text, 12 to 324 characters from somewhere in it on."""
    out = []
    for text in texts.to_pylist():
        mark = zlib.crc32(text.encode())
        start = (mark >> 8) % max(len(text) - 12, 1)
        out.append(text[start : start + (12, 36, 108, 324)[mark % 4]])
    return pa.array(out, pa.large_string())


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from the columns doc_id, text and lang of docs, all of which may be learned from.

    Reads lang of every row to set the share of each language that the sample takes, then the sampled texts. What comes
    to the driver are bucket counts, at most `buckets` a document, of about docs_per_language documents a language.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    totals = known.groupBy("lang").count().orderBy("lang").limit(params.max_languages + 1).collect()
    if len(totals) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages")
    languages = tuple(r["lang"] for r in totals)
    if not languages:
        return LanguageModel((), np.zeros((params.buckets + 1, 0)), 1.0, 0.0, params)
    bounds = spark.createDataFrame(
        [(r["lang"], k, int(1_000_000 * params.docs_per_language / r["count"]) + 1) for k, r in enumerate(totals)],
        "lang string, label int, bound long",
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(1_000_000))

    def features(batches):
        for batch in batches:
            texts, columns = text_array(batch.column("text")), []
            for part in (texts, _pieces(texts)):
                for x in (found := _counts(part, params)):
                    flat = np.concatenate([*x, np.zeros(0)]).astype(np.int32)
                    columns.append(lists(flat, np.array([len(y) for y in found[0]], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *columns],
                names=["doc_id", "label", "ids", "n", "piece_ids", "piece_n"],
            )

    # At most max_languages rows.
    sample = known.join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("doc_id", "text", "label")
    rows = sample.mapInArrow(features, "doc_id long, label int, ids array<int>, n array<int>, piece_ids array<int>, piece_n array<int>").toArrow()
    rows = rows.to_pandas().sort_values(["doc_id", "label"], ignore_index=True)
    return _train(rows, languages, params)


def _train(rows: pd.DataFrame, languages: tuple[str, ...], params: LanguageParams) -> LanguageModel:
    rng = np.random.default_rng(params.seed)
    rows = rows[rows["ids"].map(len) > 0].reset_index(drop=True)
    labels = rows["label"].to_numpy()
    inputs = [(np.asarray(i), (np.asarray(n) / np.sum(n)).astype(np.float32)) for i, n in zip(rows["ids"], rows["n"])]
    order = rng.permutation(len(inputs))
    calibration, training = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(calibration):
        calibration = training
    embed = rng.uniform(-1, 1, (params.buckets, params.dim)).astype(np.float32) / params.dim
    out = np.zeros((params.dim, len(languages)), dtype=np.float32)
    # Rare languages must not drown, so a step is scaled by how rare its language is.
    weight = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    steps, done = params.epochs * max(len(training), 1), 0
    for _ in range(params.epochs):
        for k in rng.permutation(training):
            ids, share = inputs[k]
            rate = params.rate * (1 - done / steps) * min(float(weight[labels[k]]), 4.0)
            done += 1
            hidden = share @ embed[ids]
            logits = hidden @ out
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            # As usual for averaged embeddings, each n-gram of the text takes the whole step.
            embed[ids] -= (rate * np.minimum(share * len(ids), 1.0))[:, None] * back
    table = np.concatenate([embed @ out, np.zeros((1, len(languages)), dtype=np.float32)]).astype(np.float32)
    logits = np.array([inputs[k][1] @ table[inputs[k][0]] for k in calibration]).reshape(-1, len(languages))
    truth = labels[calibration]

    def probabilities(t):
        z = logits / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    # Temperature with the best likelihood on texts that took no part in training.
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(probabilities(t)[np.arange(len(truth)), truth], 1e-12)).sum() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = probabilities(temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth] if len(truth) else np.zeros(0)
    # Never much above an even split: rejection is for texts that are no language's, not for short ones.
    bound = min(float(np.quantile(right, params.lost)), 1.3 / len(languages)) if len(right) else 0.0
    usual = np.zeros((params.buckets, len(languages)))
    for k in training:
        np.add.at(usual[:, labels[k]], inputs[k][0], inputs[k][1])
    usual = (usual + 0.01 / params.buckets) / (usual.sum(axis=0) + 0.01)
    usual = np.concatenate([np.log(usual), np.zeros((1, len(languages)))]).astype(np.float32)
    return LanguageModel(languages, table, temperature, bound, params, usual, _usual_bounds(rows, order[: len(order) // 5], usual, params.lost))


def _usual_bounds(rows: pd.DataFrame, apart: np.ndarray, usual: np.ndarray, lost: float) -> np.ndarray:
    """Least mean log share by language and length class, from the rows that took no part in training and their pieces.

    A class with few texts has the loosest bound of the other languages, else that of the next shorter class; none if there is
    no such class. Shorter texts vary more, so they never have a stricter bound than longer ones.
    """
    seen: dict[tuple[int, int], list[float]] = {}
    for label, *parts in rows.iloc[apart][["label", "ids", "n", "piece_ids", "piece_n"]].itertuples(index=False):
        for ids, n in (parts[:2], parts[2:]):
            if total := int(np.sum(n)):
                mean = float(np.asarray(n) @ usual[np.asarray(ids), label]) / total
                seen.setdefault((label, int(_length_class(np.array(total)))), []).append(mean)
    bounds = np.full((usual.shape[1], LENGTH_CLASSES), -np.inf)
    for (label, k), means in seen.items():
        if len(means) >= LEAST_CALIBRATED:
            low, chance = float(np.quantile(means, lost)), float(usual[:-1, label].mean())
            bounds[label, k] = low - MARGIN * max(low - chance, 0.0)
    for k in range(LENGTH_CLASSES):
        if (set_ := np.isfinite(bounds[:, k])).any():
            bounds[~set_, k] = bounds[set_, k].min()
    for k in range(1, LENGTH_CLASSES):
        bounds[:, k] = np.maximum(bounds[:, k], bounds[:, k - 1])
    return bounds


def _predict(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, probability, rejected) of each text."""
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages or not len(texts):
        return np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
    grams, lengths = ngrams(texts, model.params)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    some = lengths > 0
    sums = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros(len(texts))
    columns = [np.ascontiguousarray(c) for c in model.table.T]
    shares = [np.ascontiguousarray(c) for c in model.usual.T]
    usual = np.zeros_like(sums)
    for order, buckets in zip(model.params.orders, grams):
        if some.any():
            for c, column in enumerate(columns):
                sums[some, c] += np.add.reduceat(column[buckets], starts[some], dtype=np.float64)
                usual[some, c] += np.add.reduceat(shares[c][buckets], starts[some], dtype=np.float64)
        counts += np.maximum(lengths - order + 1, 0)
    z = sums / np.maximum(counts, 1)[:, None] / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    told = p.argmax(axis=1)
    best = np.where(letters, told, -1)
    score = np.where(letters, p.max(axis=1), 0.0)
    mean = usual[np.arange(len(texts)), told] / np.maximum(counts, 1)
    strange = (counts > 0) & (mean < model.usual_below[told, _length_class(counts)])
    return best, score, ~letters | (score < model.reject_below) | strange


def identify(model: LanguageModel):
    """A function of a text column that gives the struct lang_pred, score, rejected."""
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def language(text: pa.Array) -> pa.Array:
        told = [_predict(some, model) for some in stretches(text_array(text), STRETCH_BYTES)]
        best, score, rejected = map(np.concatenate, zip(*told))
        return pa.StructArray.from_arrays(
            [names.take(pa.array(np.where(best < 0, len(model.languages), best))), pa.array(score), pa.array(rejected)],
            names=["lang_pred", "score", "rejected"],
        )

    return language


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a language model may learn from: those outside the fold kept for judging it."""
    return docs.where(~held_out(F.col("doc_id"), 4, 2))


def with_language(docs: DataFrame, text: Column, model: LanguageModel, name: str = "language") -> DataFrame:
    """docs with one more column, the struct that identify gives."""
    return docs.withColumn(name, identify(model)(text))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = docs.select("doc_id", identify(fit(learnable(docs)))(F.col("text")).alias("t"))
    return told.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "t.lang_pred", "t.score", "t.rejected")
