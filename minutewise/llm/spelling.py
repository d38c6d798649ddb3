"""Spelling variants: words one edit apart, found with a bidirectional FM-index, and the form that each goes back to.

Two words are one insertion, deletion or replacement apart only if one half of the first stands unchanged in the second, at
its beginning or at its end. So there are two search schemes: match the left half exactly, from the middle out to the
delimiter, then extend to the right across the other half, allowing one error; or the right half, then to the left. The
index is over the delimited words of a shard, #word#word..., and holds the rotations' order for both reading directions:
a pattern is an interval of ranks in each, which an extension on either side narrows in step. Each index is a wavelet
matrix of the last column, which gives ranks, the number of smaller symbols and the symbols that an interval can go on with.

A shard is all that a search needs, not the whole vocabulary: words go to shards by the beginnings and endings that can be the
half of a word one edit away, and each word asks one shard for each of its halves. If the words of one beginning or
ending are more than a shard holds, they are dealt over several, each asked in blocks, so a task's memory is bounded.

Edge cases: a null or empty text has no words; a null doc_id counts as empty text in the draw of typos. Repeated rows count each
time. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import CRC_SQL, crc32_sql, if_small, read, saved


@dataclass(frozen=True)
class SpellingParams:
    """Least code points and occurrences of a word; how many times as frequent a form is; which runs get a typo; sizes of shards and query blocks."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    typo_every: int = 31
    shard_chars: int = 1 << 20
    block: int = 1 << 13


# ---- the vocabulary ------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word and n, of the words that occur often enough."""
    # A shorter run can't become a word, as typos only shorten.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{params.least_length},}}"), F.lit(0))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", _UPPER, _LOWER).alias("run")
    )
    drawn = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gone), F.substr("run", gone + 2))
    words = drawn.select(F.when(F.col("h") % params.typo_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= params.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= params.least_count)


# ---- the index -----------------------------------------------------------------------------------


def _rotations(text: np.ndarray) -> np.ndarray:
    """The starts of the rotations of a text in their order; no two may be equal."""
    n, bits = len(text), max(int(text.max()).bit_length(), 1)
    key, width = np.zeros(n, dtype=np.int64), 62 // bits
    for k in range(width):
        key = (key << bits) | np.roll(text, -k)
    rank = np.unique(key, return_inverse=True)[1]
    while rank.max() < n - 1:
        rank = np.unique(rank * n + np.roll(rank, -width), return_inverse=True)[1]
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class _Wavelet:
    """A wavelet matrix: a bit of every symbol per level, ones after zeros in the next."""

    def __init__(self, column: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (column >> level) & 1
            ones = np.zeros(len(column) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(column) - int(ones[-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.bits = bits
        nothing = np.zeros(1 << bits, dtype=np.int64)
        self.first = self.narrowed(nothing, nothing, np.arange(1 << bits))[0]

    def narrowed(self, lo: np.ndarray, width: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the symbol's run of each interval starts among equal bits, its width, and how many smaller symbols the interval has."""
        hi, smaller = lo + width, np.zeros(len(lo), dtype=np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            smaller += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo, hi - lo, smaller

    def symbols(self, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every interval each symbol it has: number of the interval, symbol, start, width, and number of smaller ones."""
        which, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        hi = lo + width
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            left, right = (hi - b) - (lo - a), b - a
            none, some = left > 0, right > 0
            which = np.concatenate([which[none], which[some]])
            smaller = np.concatenate([smaller[none], (smaller + left)[some]])
            symbol = np.concatenate([symbol[none] * 2, symbol[some] * 2 + 1])
            lo, hi = np.concatenate([(lo - a)[none], (zeros + a)[some]]), np.concatenate([(hi - b)[none], (zeros + b)[some]])
        return which, symbol, lo, hi - lo, smaller


# A search's state: number of the query, first rank when read forwards and backwards, and how many ranks.
State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
RIGHT, LEFT = 0, 1


class BidirectionalIndex:
    """Both directions of the words with a delimiter before each; words are distinct and sorted."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), dtype=np.uint32)
        # Code points become numbers in their order; the delimiter is number 0.
        self.alphabet, text = np.unique(points, return_inverse=True)
        text = text.astype(np.int64)
        bits = max(int(len(self.alphabet) - 1).bit_length(), 1)
        self.size, self.starts = len(text), np.concatenate([[0], np.cumsum(np.bincount(text))[:-1]])
        forwards, backwards = _rotations(text), _rotations(text[::-1])
        # Extending to the left reads the symbol before; to the right, the same of the text read backwards.
        self.columns = {LEFT: _Wavelet(text[forwards - 1], bits), RIGHT: _Wavelet(text[::-1][backwards - 1], bits)}
        # The words in the order of the delimiters before them.
        self.word_at = np.searchsorted(np.flatnonzero(text == 0), forwards[: len(words)])

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols; -1 where the index lacks a code point."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at, -1)

    def everything(self, queries: int) -> State:
        zero = np.zeros(queries, dtype=np.int64)
        return np.arange(queries), zero, zero, np.full(queries, self.size)

    def _moved(self, state: State, side: int, symbol: np.ndarray, lo: np.ndarray, width: np.ndarray, smaller: np.ndarray) -> State:
        query, forward, backward, _ = state
        first = self.starts[symbol] + lo - self.columns[side].first[symbol]
        return (query, forward + smaller, first, width) if side == RIGHT else (query, first, backward + smaller, width)

    def extended(self, state: State, side: int, symbols: np.ndarray) -> State:
        """The states whose pattern can go on with their query's symbol on a side."""
        symbol = symbols[state[0]]
        state, symbol = tuple(x[symbol >= 0] for x in state), symbol[symbol >= 0]
        moved = self._moved(state, side, symbol, *self.columns[side].narrowed(state[2 if side == RIGHT else 1], state[3], symbol))
        return tuple(x[moved[3] > 0] for x in moved)

    def branches(self, state: State, side: int) -> tuple[State, np.ndarray]:
        """Every state with each symbol that it can go on with, and the symbols."""
        which, symbol, lo, width, smaller = self.columns[side].symbols(state[2 if side == RIGHT else 1], state[3])
        return self._moved(tuple(x[which] for x in state), side, symbol, lo, width, smaller), symbol

    def matched(self, state: State, side: int, rows: np.ndarray) -> State:
        """State after all symbols of rows, a row for each query."""
        for symbols in rows.T:
            state = self.extended(state, side, symbols)
        return state

    def one_error(self, exact: State, side: int, rows: np.ndarray) -> State:
        """The states after rows, whose last symbol is the delimiter, with exactly one error before it; each pattern once."""
        joined = lambda states: tuple(map(np.concatenate, zip(*states)))
        last = rows.shape[1] - 1
        wrong = tuple(x[:0] for x in exact)
        for j, symbols in enumerate(rows.T):
            onward, symbol = self.branches(exact, side)
            right = symbol == symbols[onward[0]]
            other = tuple(x[~right & (symbol != 0)] for x in onward)
            # One symbol more, which isn't the next one: of a run of equal ones it comes last.
            found = [self.extended(wrong, side, symbols), self.extended(other, side, symbols)]
            if j < last:
                # Another symbol, or one less: of a run of equal ones the last.
                single = np.ones(len(rows), dtype=bool) if j + 1 == last else rows[:, j] != rows[:, j + 1]
                found += [other, tuple(x[single[exact[0]]] for x in exact)]
            wrong, exact = joined(found), tuple(x[right] for x in onward)
        return wrong

    def near(self, words: list[str], left: bool, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a word asked, number of a word of the index) by the scheme that matches the left half, or the right one.

        Pairs that the left scheme finds are left out by the other.
        """
        asked, found = [], []
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, chosen in by_length.items():
            half = length // 2
            for a in range(0, len(chosen), block):
                some = np.array(chosen[a : a + block])
                rows = self.codes([words[i] for i in some])
                end = np.zeros((len(rows), 1), dtype=rows.dtype)
                outwards = {LEFT: np.hstack([rows[:, :half][:, ::-1], end]), RIGHT: np.hstack([rows[:, half:], end])}
                first, then = (LEFT, RIGHT) if left else (RIGHT, LEFT)
                state = self.one_error(self.matched(self.everything(len(rows)), first, outwards[first]), then, outwards[then])
                asked.append(some[state[0]])
                found.append(self.word_at[state[1]])
        return np.concatenate(asked or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


# ---- the search over shards ----------------------------------------------------------------------


def _halves(word: Column) -> Column:
    """Where a word is held and where it asks: left (whether it is the left half), key, asks."""
    n = F.length(word)

    def keys(left: bool, own: Column, least: Column, most: Column) -> list[Column]:
        # The lengths of the halves of words one shorter to one longer: two numbers, one of them the word's own.
        def part(size: Column) -> Column:
            return F.substring(word, F.lit(1), size) if left else F.substr(word, n - size + 1)

        other = F.when(least < own, least).otherwise(most)
        return [F.struct(F.lit(left).alias("left"), part(size).alias("key"), F.lit(asks).alias("asks")) for size, asks in ((own, True), (other, False))]

    down = lambda x: F.floor(x / 2).cast("int")
    return F.array(*keys(True, down(n), down(n - 1), down(n + 1)), *keys(False, down(n + 1), down(n), down(n + 2)))


def _routed(vocab: DataFrame, params: SpellingParams) -> tuple[DataFrame, int]:
    """shard, left, word, n, holds, asks: the rows of every shard; and how many shards there are about."""
    rows = vocab.select("word", "n", F.inline(_halves(F.col("word"))))
    sizes = rows.groupBy("left", "key").agg(F.sum(F.length("word") + 1).alias("chars"))
    crowded = saved(sizes.where(F.col("chars") > params.shard_chars).select("left", "key", F.ceil(F.col("chars") / params.shard_chars).cast("int").alias("parts")))
    # Each word is held four times; half of the shards are for either half.
    chars = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(2 * chars // params.shard_chars, 1)
    place = F.concat_ws(":", F.col("left"), F.pmod(F.xxhash64("key"), F.lit(shards)))
    usual = F.struct(place.alias("shard"), F.lit(True).alias("holds"), "asks")
    told = rows.join(if_small(crowded), ["left", "key"], "left")
    # Of a crowded key, each part of its words is asked by each part of them.
    part, every = F.pmod(F.xxhash64("word"), F.col("parts")), F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda held, asked: F.concat_ws(":", F.col("left"), F.col("key"), held, asked).alias("shard")
    held = F.transform(every, lambda k: F.struct(cell(part, k), F.lit(True).alias("holds"), F.lit(False).alias("asks")))
    asked = F.transform(every, lambda k: F.struct(cell(k, part), F.lit(False).alias("holds"), F.lit(True).alias("asks")))
    split = F.when(F.col("asks"), F.concat(held, asked)).otherwise(held)
    cells = F.when(F.col("parts").isNull(), F.array(usual)).otherwise(split)
    return told.select("left", "word", "n", F.inline(cells)), shards


def near_words(vocab: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n_near, and best_n and best: of the most frequent near word (the first of several), for each word of vocab (word, n; saved) that has one."""
    kind = "word string, n_near long, best_n long, best string"

    def searched(shard: pa.Table) -> pa.Table:
        held = shard.filter(shard["holds"])
        # A word whose two keys fall into one shard is there twice.
        counts = dict(zip(held["word"].to_pylist(), held["n"].to_pylist()))
        words = sorted(counts)
        asking = sorted(set(shard.filter(shard["asks"])["word"].to_pylist()))
        left = bool(shard["left"][0].as_py())
        if not words or not asking:
            return _nothing()
        asked, found = BidirectionalIndex(words).near(asking, left, params.block)
        if not left:
            new = np.fromiter((not words[v].startswith(asking[q][: len(asking[q]) // 2]) for q, v in zip(asked, found)), bool, len(asked))
            asked, found = asked[new], found[new]
        n = np.array([counts[w] for w in words], dtype=np.int64)
        order = np.lexsort((found, -n[found], asked))
        asked, found = asked[order], found[order]
        some, first, near = np.unique(asked, return_index=True, return_counts=True)
        best = found[first]
        columns = [pa.array([asking[q] for q in some], pa.string()), pa.array(near.astype(np.int64)), pa.array(n[best]), pa.array([words[v] for v in best], pa.string())]
        return pa.table(columns, names=["word", "n_near", "best_n", "best"])

    routed, shards = _routed(vocab, params)
    pairs = routed.repartition(max(shards, int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").groupBy("shard").applyInArrow(searched, kind)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def _nothing() -> pa.Table:
    return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form; saved): where following forms ends. A form is more frequent, so there are no rings."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        # Each round doubles the steps; chains are short, as frequencies rise tenfold with every step.
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        up = saved(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    vocab = saved(vocabulary(docs, params))
    near = saved(near_words(vocab, params))
    told = vocab.join(near, "word", "left")
    is_form = F.col("best_n") >= params.ratio * F.col("n")
    told = saved(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
        )
    )
    roots = _roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with the form and the root that it is a variant of."""
    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


_OCTETS = "list_transform(range(strlen(keyed)), lambda i: CAST('0x' || substr(hex(encode(keyed)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"

OP12_SQL = f"""WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
drawn AS (SELECT run, {crc32_sql(_OCTETS)} AS h FROM (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS keyed FROM runs), tab),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word FROM drawn),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON rest = v.word UNION SELECT v.word, less.word FROM less JOIN v ON rest = v.word),
best AS MATERIALIZED (SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS other, max(v.n) AS other_n
  FROM near JOIN v ON v.word = near.other GROUP BY 1),
told AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
  CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM told UNION ALL SELECT up.word, form FROM up JOIN told ON told.word = up.root WHERE form IS NOT NULL)
SELECT told.word, told.form, up.root, told.n, told.n_near, told.form_n FROM told JOIN up ON told.word = up.word JOIN told t ON t.word = up.root AND t.form IS NULL"""
