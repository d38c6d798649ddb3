"""Toxicity of disguised text: noisy-channel decoding by Viterbi under a character model, then a score.

What a writer meant is taken to be plain letters sent through a channel that swaps letters for look-alikes (leetspeak),
repeats them, and puts signs or spaces between them. Each token that is not plainly a word, and each run of lone
characters, is a lattice: a character may stand for one of several letters, or for none. Viterbi decoding finds the best
letters under a four-gram character model that is counted over the words of all documents. A token of letters alone counts as
it stands and in its other readings: letters of other alphabets and accents as the plain ones, doubled letters as one. The
score joins the log-odds of
the restored words that tell the classes apart, calibrated by logistic regression.

Edge cases: a null or empty text has no words and gets the score of a text without any telling word. Where there is no
label, or one class only, the scores are the share of label 1, 0 if there is none. Several labels of one
document count as toxic if one is. Rows without a doc_id are scored but never learned from. Whole texts of any length
are read. Repeated rows are scored alike; other columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import fold, held_out, read, saved, text_array, words_of
from minutewise.llm.simhash import fingerprint


@dataclass(frozen=True)
class ToxicityParams:
    """The sample of labelled rows that is learned from, and what makes a word telling."""

    # About this many labelled documents, chosen by a hash of the id; all if there are fewer.
    labelled: int = 40_000
    # A word is telling if its share in toxic texts exceeds that in others by this many standard errors.
    errors: float = 5.0
    least_toxic: int = 3
    # The most telling words that a model has.
    lexicon: int = 50_000
    seed: int = 3


# ---- the channel ------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE = 26  # the code of a word's beginning and end
SYMBOLS = 27

# What may stand for a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "т": "t", "к": "k",
}
COST_LEET, COST_DROP, COST_REPEAT, COST_STRANGE = -2.0, -1.0, -1.5, -6.0


@functools.lru_cache(1 << 16)
def readings(character: str) -> str:
    """The letters that a character may stand for."""
    if character in LETTERS:
        return character
    base = unicodedata.normalize("NFKD", character)[0].lower()
    return LEET.get(character) or (base if base in LETTERS else LEET.get(base, ""))


_CODES = {letter: code for code, letter in enumerate(LETTERS)}
# Paths that a first, narrow pass keeps at a character, and what rounding may add to a path.
_NARROW, _ROUNDING = 12, 1e-6


class Letters:
    """The character model in plain lists: log probabilities by history and next symbol, and the highest of each pair of symbols."""

    def __init__(self, model: np.ndarray):
        self.told = model.ravel().tolist()
        self.pairs = model.max(axis=(0, 1)).tolist()


def _at_best(steps: list, pairs: list[list[float]]) -> list[list[float]]:
    """Before each step, by the last symbol: a bound that what is still to come can't exceed."""
    bound = [row[EDGE] for row in pairs]
    bounds = [bound]
    for codes, swap, drop, dropped in reversed(steps):
        onward = [(code, swap + bound[code]) for _, code in codes]
        bound = [max([row[code] + b for code, b in onward] + ([kept + drop] if dropped else []), default=-np.inf) for row, kept in zip(pairs, bound)]
        bounds.append(bound)
    return bounds[::-1]


def _best_path(steps: list, told: list[float], bounds: list[list[float]], least: float, narrow: bool) -> tuple[float, str]:
    """(log probability, letters) of the best path of least or more; narrow: among few."""
    # Best path to each history, as one number: (log probability, letters so far).
    best: dict[int, tuple[float, str]] = {SYMBOLS**3 - 1: (0.0, "")}
    for (codes, swap, drop, dropped), bound in zip(steps, bounds):
        step: dict[int, tuple[float, str]] = {}
        rows = best.items()
        if narrow and len(best) > _NARROW:
            rows = heapq.nlargest(_NARROW, rows, key=lambda row: row[1][0] + bound[row[0] % SYMBOLS])
        for history, (score, text) in rows:
            if score + bound[history % SYMBOLS] < least:
                continue
            if dropped and (history not in step or step[history][0] < score + drop):
                step[history] = (score + drop, text)
            score += swap
            for letter, code in codes:
                to = history % SYMBOLS**2 * SYMBOLS + code
                reached = score + told[history * SYMBOLS + code]
                if to not in step or step[to][0] < reached:
                    step[to] = (reached, text + letter)
        best = step
    return max(((score + told[history * SYMBOLS + EDGE], text) for history, (score, text) in best.items()), default=(-np.inf, ""))


def restore(token: str, model: np.ndarray | Letters, inserted: bool = True) -> str:
    """The most likely letters behind a token; model: log probabilities by three symbols of history and the next.

    inserted: whether a letter or digit may stand for nothing. Paths that can't become as likely as the best of a narrow
    pass are left where that shows; the result is that of all paths.
    """
    model = model if isinstance(model, Letters) else Letters(model)
    steps, before = [], ""
    for character in token:
        letters = readings(character)
        # A sign between letters may be dropped cheaply, a repeated letter too, any other character hardly ever.
        drop = COST_REPEAT if character == before else COST_STRANGE if character.isalnum() else COST_DROP
        swap = 0.0 if letters == character else COST_LEET
        steps.append(([(letter, _CODES[letter]) for letter in letters], swap, drop, inserted or not letters or drop > COST_STRANGE))
        before = character
    bounds = _at_best(steps, model.pairs)
    sure = _best_path(steps, model.told, bounds, -np.inf, True)[0]
    return _best_path(steps, model.told, bounds, sure - _ROUNDING * (1 + len(token)), False)[1]


# ---- words of texts -----------------------------------------------------------------------------------

_PLAIN = r"^[^\p{L}\p{N}]*(?P<core>\p{L}+)[^\p{L}\p{N}]*$"
_TRIPLE = "|".join(c * 3 for c in LETTERS)
_HAS_LETTER = r"[\p{L}]"
# What a plain word must have to be read in another way, and a token without a letter to be read at all.
_DISGUISABLE = "[^a-z]|" + "|".join(c * 2 for c in LETTERS)
_ALL_SIGNS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in LEET) + r"].*[" + "".join(f"\\x{{{ord(c):x}}}" for c in LEET) + "]"
_DOUBLED = re.compile(r"(.)\1+")
# Doubled places of a word whose readings are all taken; beyond, all doubled, none, and the most likely reading.
_MANY_DOUBLED = 6
# Parts of a run of lone characters are looked up to this length; no word is longer.
_LONGEST = 64


def other_readings(word: str) -> tuple[list[str], bool]:
    """What a word of letters may stand for besides itself, and whether it has more readings than were taken."""
    plain = word if word.isascii() else "".join(map(readings, word))
    places = [m.span() for m in _DOUBLED.finditer(plain)]
    if len(places) == 1 and plain is word:
        (start, end), = places
        return [word[: start + 1] + word[end:]], False
    if len(places) < 2:
        found = {plain, _DOUBLED.sub(r"\1", plain)} if places else {plain}
        return sorted(found - {word, ""}), False
    found = {plain}
    for kept in itertools.product((False, True), repeat=len(places)) if len(places) <= _MANY_DOUBLED else [(False,) * len(places)]:
        parts, at = [], 0
        for (start, end), whole in zip(places, kept):
            parts.append(plain[at : end if whole else start + 1])
            at = end
        found.add("".join([*parts, plain[at:]]))
    return sorted(found - {word, ""}), len(places) > _MANY_DOUBLED


def plain_words(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The letters of each token without the signs around it, and whether it is plainly a word."""
    # Most tokens are small letters alone, which the costly pattern would only give back.
    other = pc.invert(pc.match_substring_regex(tokens, "^[a-z]+$"))
    found = pc.struct_field(pc.extract_regex(tokens.filter(other), _PLAIN), "core")  # null where it does not fit
    core = pc.replace_with_mask(tokens, other, found)
    plain = pc.and_(core.is_valid(), pc.invert(pc.match_substring_regex(tokens, _TRIPLE)))
    return pc.if_else(plain, core, ""), plain.to_numpy(zero_copy_only=False)


def count_letters(texts: pa.Array, total: np.ndarray) -> None:
    """Add the four-grams of the plain words of texts to total (SYMBOLS ** 4 counts)."""
    words, _ = words_of(texts)
    core, plain = plain_words(words.dictionary)
    ascii_only = pc.match_substring_regex(core, "^[a-z]+$").to_numpy(zero_copy_only=False)
    times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
    kept = np.flatnonzero(plain & ascii_only)
    if not len(kept):
        return
    spelled = "~~~" + "~~~".join(core.take(pa.array(kept)).to_pylist()) + "~~~"
    code = np.frombuffer(spelled.encode(), np.uint8).astype(np.int32)
    code = np.where(code == 126, EDGE, code - 97)
    # The word that each position belongs to: a word ends with the first edge behind it.
    lengths = np.array(pc.binary_length(core.take(pa.array(kept))))
    owner = np.repeat(np.arange(len(kept)), lengths + 3)
    gram = ((code[:-3] * SYMBOLS + code[1:-2]) * SYMBOLS + code[2:-1]) * SYMBOLS + code[3:]
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 3) - (lengths + 3), lengths + 3)
    real = offset <= lengths[owner]
    np.add.at(total, gram[: len(owner)][real], times[kept][owner[real]])


def character_model(texts: DataFrame) -> np.ndarray:
    """Interpolated four-gram log probabilities from the column text of all rows; the counts are SYMBOLS ** 4 at most."""

    def counted(batches):
        total = np.zeros(SYMBOLS**4, dtype=np.int64)
        for batch in batches:
            count_letters(text_array(batch.column("text")), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    found = texts.select("text").mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**4)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    # From short to long histories, each leaning on the shorter one by about five observations.
    for order in range(1, 5):
        n = counts.sum(axis=tuple(range(4 - order)))
        p = (n + 5 * p) / (n.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


class Restorer:
    """Restored words of a batch of texts, with what was decoded before kept for the next."""

    KEPT = 200_000

    def __init__(self, model: np.ndarray):
        self._model, self._known, self._other = Letters(model), {}, {}

    def restored(self, token: str, inserted: bool = True) -> str:
        if token not in self._known:
            self._make_room(self._known)
            self._known[token] = restore(token, self._model, inserted)
        return self._known[token]

    def _make_room(self, known: dict) -> None:
        if len(known) >= self.KEPT:
            known.clear()

    def _others(self, word: str) -> list[int]:
        """Hashes of what a plain word may stand for besides itself."""
        if word not in self._other:
            self._make_room(self._other)
            found, more = other_readings(word)
            self._other[word] = [*map(xxhash.xxh64_intdigest, [*found, *([self.restored(word)] if more else [])])]
        return self._other[word]

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every distinct word of each text, disguised ones restored."""
        words, counts = words_of(texts)
        tokens, index = words.dictionary, words.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), counts)
        core, plain = plain_words(tokens)
        spelled = core.to_pylist()
        matches = lambda column, pattern: pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
        lettered = matches(tokens, _HAS_LETTER)
        for wanted, inserted in ((~plain & lettered, True), (~lettered & matches(tokens, _ALL_SIGNS), False)):
            chosen = np.flatnonzero(wanted)
            for k, token in zip(chosen, tokens.take(pa.array(chosen)).to_pylist()):
                spelled[k] = self.restored(token, inserted)
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, spelled), dtype=np.uint64, count=len(spelled)).view(np.int64)
        # The other readings of each token, and each of them once for every place where the token stands.
        chosen = np.flatnonzero(plain & matches(core, _DISGUISABLE))
        others = [self._others(spelled[k]) for k in chosen]
        sizes = np.zeros(len(tokens), dtype=np.int64)
        sizes[chosen] = [*map(len, others)]
        flat = np.fromiter(itertools.chain.from_iterable(others), dtype=np.uint64, count=sizes.sum()).view(np.int64)
        there = np.flatnonzero(sizes[index])
        times = sizes[index[there]]
        first = (np.cumsum(sizes) - sizes)[index[there]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        more_ids, more_of = self._runs(tokens, index, owner)
        ids = np.concatenate([hashed[index], flat[np.repeat(first, times) + within], more_ids])
        of = np.concatenate([owner, np.repeat(owner[there], times), more_of])
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
        return ids[new], of[new]

    def _runs(self, tokens: pa.Array, index: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of three or more lone characters are read as one word; its parts may be words as well."""
        lone = (pc.utf8_length(tokens).to_numpy() == 1)[index]
        if not lone.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(lone)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(at)))
        ids, of = [], []
        for s, n in zip(starts[sizes >= 3], sizes[sizes >= 3]):
            word = self.restored("".join(tokens.take(pa.array(index[at[s] : at[s] + n])).to_pylist()))
            parts = [word[a:b] for a in range(len(word)) for b in range(a + 3, min(len(word), a + _LONGEST) + 1)]
            for part in {word, *parts}:
                ids.append(xxhash.xxh64_intdigest(part))
                of.append(owner[at[s]])
        return np.array(ids, dtype=np.uint64).view(np.int64), np.array(of, dtype=np.int64)


# ---- the classifier -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ToxicityModel:
    letters: np.ndarray
    words: np.ndarray  # sorted hashes of the telling words
    weights: np.ndarray
    slope: float
    offset: float

    def odds(self, restorer: Restorer, texts: pa.Array) -> np.ndarray:
        """Root of the summed squares of the weights of the distinct telling words of each text.

        Words of one text depend on each other, so a second one adds less than the first: a plain sum would learn from
        texts with several that one is not enough.
        """
        ids, of = restorer.hashes(texts)
        total = np.zeros(len(texts))
        if len(self.words):
            slot = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
            hit = self.words[slot] == ids
            np.add.at(total, of[hit], self.weights[slot[hit]] ** 2)
        return np.sqrt(total)

    def scores(self, restorer: Restorer, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.odds(restorer, texts), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """text, toxic of about params.labelled rows of docs whose id has a label that may be learned from, without near copies; saved."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(1 << 20))
    chosen = known.where(place < int((1 << 20) * min(1.0, params.labelled / max(n, 1))))
    # The sample's size is bounded by params.labelled, so its ids are.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Near copies count once, or any word of a much copied text would tell.
    return saved(sample.select("text", "toxic", fingerprint(F.col("text")).alias("fp")).dropDuplicates(["fp", "toxic"]).drop("fp"))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); the character model counts every text of docs."""
    letters = character_model(docs)
    sample = labelled_sample(docs, labels, params)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(clean + toxic, 1)
        return ToxicityModel(letters, np.zeros(0, np.int64), np.zeros(0), 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0)

    def counted(batches):
        restorer = Restorer(letters)
        for batch in batches:
            ids, of = restorer.hashes(text_array(batch.column("text")))
            label = batch.column("toxic").to_numpy()[of]
            words, slot = np.unique(ids, return_inverse=True)
            n = np.bincount(slot * 2 + label, minlength=2 * len(words)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n[:, 1]), pa.array(n[:, 0])], names=["word", "toxic", "clean"])

    seen = sample.mapInArrow(counted, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share_t, share_c = F.col("t") / F.lit(toxic), F.col("c") / F.lit(clean)
    mean = (F.col("t") + F.col("c")) / F.lit(toxic + clean)
    error = F.sqrt(mean * (1 - mean) * F.lit(1 / toxic + 1 / clean))
    gap = F.try_divide(share_t - share_c, error)  # null for a word of every text
    telling = seen.where(F.col("t") >= params.least_toxic).withColumn("gap", gap).where(F.col("gap") > params.errors)
    rows = telling.orderBy(F.desc("gap"), "word").limit(params.lexicon).toArrow()
    words = rows.column("word").to_numpy()
    order = np.argsort(words)
    t, c = (rows.column(k).to_numpy()[order] for k in "tc")
    weights = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    bare = ToxicityModel(letters, words[order], weights, 1.0, 0.0)

    def weighed(batches):
        restorer = Restorer(letters)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bare.odds(restorer, text_array(batch.column("text")))), batch.column("toxic")], names=["odds", "toxic"])

    pairs = sample.mapInArrow(weighed, "odds double, toxic int").toArrow()
    slope, offset = _calibrated(pairs.column("odds").to_numpy(), pairs.column("toxic").to_numpy())
    return ToxicityModel(letters, bare.words, weights, slope, offset)


def _calibrated(odds: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, a little regularised, by Newton's method with halved steps where needed."""
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    sign = np.where(label == 1, 1.0, -1.0)
    ridge = np.array([0.02, 1e-4])

    def loss(w):
        return np.logaddexp(0, -sign * (x @ w)).sum() + 0.5 * (ridge * w**2).sum()

    w = np.array([0.0, np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (label - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def toxicity(model: ToxicityModel):
    """A function of a text column that gives the score, 0 to 1."""
    restorer = []  # one in each worker, made when first needed

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if not restorer:
            restorer.append(Restorer(model.letters))
        return pa.array(model.scores(restorer[0], text_array(text)))

    return score


def restored(letters: np.ndarray):
    """A function of a text column that gives its words after decoding, joined by spaces."""

    @F.arrow_udf("string")
    def decoded(text: pa.Array) -> pa.Array:
        restorer, out = Restorer(letters), []
        for value in text_array(text).to_pylist():
            words = value.lower().split()
            joined: list[str] = []
            while words:
                run = next((k for k, w in enumerate(words) if len(w) > 1), len(words))
                if run >= 3:
                    joined.append(restorer.restored("".join(words[:run])))
                    words = words[run:]
                else:
                    word = words.pop(0)
                    core, plain = plain_words(pa.array([word], pa.large_string()))
                    joined.append(core[0].as_py() if plain[0] else restorer.restored(word) or word)
            out.append(" ".join(joined))
        return pa.array(out, pa.string())

    return decoded


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    score: Column = toxicity(fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))(F.col("text"))
    told = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
