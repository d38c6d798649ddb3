"""A hierarchical Pitman-Yor language model over words, with seating sampled by Gibbs, and the texts' log probabilities.

Two levels: a restaurant per context, the word before hashed to one of a fixed number, and one parent that they all share,
whose base is even over the words seen and one for all others. A context's customers are its tokens; each
of its tables is a customer of the parent. A round of Gibbs sampling takes every customer out and seats it anew: one at a
time in dishes of fewer than 16, an eighth of the dish at a time in larger ones; the predictive probabilities of several samples are averaged.

How it is spread: documents are counted in batches of about batch_tokens tokens. What a batch asks about, its distinct
(word, context) pairs with their counts in training, goes to parts by the word's hash, packed as arrays; a frequent pair
is one entry per batch, so none is hot. A part knows all contexts of its words, so dishes, their tables and
the parent's seats of these words are sampled where they lie. Only totals are shared: tokens and tables by context, and a few
sums, which are of fixed size. Parts sample against the totals at the start and their own changes since; the
same draws are made again when the probabilities are taken, now with each sample's exact totals, so that these
sum to one. The answers go back to the batches by the order of their pairs.

Edge cases: a null or empty text is its end token alone. Without any training row every token has probability 1. A row
without a doc_id is scored, not learned from. Repeated rows are scored alike, and learned from as often as they stand
there. Empty tables give no rows. Other columns are not looked at. Log probabilities of a token are single
precision, their sums double.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import held_out, read, saved, text_array, words_of

CONTEXT_BITS = 16
END, START = np.uint64(xxhash.xxh64_intdigest(b"")), np.uint64(xxhash.xxh64_intdigest(b" "))  # neither is a word
ONE_BY_ONE = 16  # dishes of fewer customers are reseated one customer at a time


@dataclass(frozen=True)
class PitmanYorParams:
    """Strengths of the two levels, sampling, and the sizes of batches and parts."""

    strength: float = 5.0
    parent_strength: float = 5.0
    # A round reseats every customer; samples are taken after `burn` rounds, `gap` rounds apart.
    burn: int = 4
    samples: int = 3
    gap: int = 1
    seed: int = 7
    batch_tokens: int = 2_000_000
    part_bytes: int = 8 << 20
    least_parts: int = 32


# ---- packed arrays ------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one byte string; bytes of equal weight lie together, which compresses well."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<3sQQ", a.dtype.str.encode(), len(raw), len(small)) + small)
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, size, small = struct.unpack_from("<3sQQ", blob, at)
        at += struct.calcsize("<3sQQ")
        kind = np.dtype(kind.decode())
        raw = pa.decompress(blob[at : at + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += small
    return out


# ---- batches --------------------------------------------------------------------------------------------


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, context) of every token, an end token after each text, and the number of tokens of each text."""
    words, counts = words_of(texts)
    distinct = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    lengths = counts + 1
    last = np.cumsum(lengths) - 1
    hashed = np.empty(lengths.sum(), dtype=np.uint64)
    inner = np.ones(len(hashed), dtype=bool)
    inner[last] = False
    hashed[inner] = distinct[words.indices.to_numpy()]
    hashed[last] = END
    before = np.empty_like(hashed)
    before[1:] = hashed[:-1]
    before[last - lengths + 1] = START
    context = (before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CONTEXT_BITS)
    return hashed, context.astype(np.uint16), lengths


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """The part of each word; grows with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


COUNTED_ROW = "batch long, part int, pairs binary, doc_ids array<long>, held_out array<boolean>, lengths array<int>, places binary"


def _counted(batch: int, doc_ids: list, held: list, columns: list, parts: int) -> list[dict]:
    """The rows of a batch: one with its documents, and one for each part that it asks."""
    words, context, lengths = (np.concatenate(c) for c in zip(*columns))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    distinct, word = np.unique(words, return_inverse=True)
    keys, pair = np.unique(word << CONTEXT_BITS | context, return_inverse=True)
    trained = np.bincount(pair, weights=~np.array(held, dtype=bool)[owner], minlength=len(keys)).astype(np.uint32)
    # The order of a text's pairs doesn't matter for its sum; sorted, they take less room.
    order = np.sort(owner << 32 | pair) & 0xFFFFFFFF
    places = np.diff(order, prepend=0)
    starts = np.cumsum(lengths) - lengths
    places[starts] = order[starts]
    rows = [{"batch": batch, "part": -1, "doc_ids": doc_ids, "held_out": held, "lengths": lengths.tolist(), "places": packed(places.astype(np.uint32))}]
    bounds = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1))
    edges = np.searchsorted(keys, bounds << CONTEXT_BITS)
    sizes = np.bincount(keys >> CONTEXT_BITS, minlength=len(distinct)).astype(np.uint32)
    for p in range(parts):
        a, b, i, j = bounds[p], bounds[p + 1], edges[p], edges[p + 1]
        if a < b:
            gaps = np.diff(distinct[a:b], prepend=np.uint64(0))
            rows.append({"batch": batch, "part": p, "pairs": packed(gaps, sizes[a:b], keys[i:j].astype(np.uint16), trained[i:j])})
    return rows


def count_batches(docs: DataFrame, parts: int, params: PitmanYorParams) -> DataFrame:
    """COUNTED_ROW of docs (doc_id, text, held_out), saved."""
    schema = pa.schema([
        ("batch", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()),
    ])

    def counted(batches):
        doc_ids, held, columns, tokens, number, task = [], [], [], 0, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            task = batch.column("task")[0].as_py()
            columns.append(tokens_of(text_array(batch.column("text"))))
            doc_ids += batch.column("doc_id").to_pylist()
            held += batch.column("held_out").to_pylist()
            tokens += len(columns[-1][0])
            if tokens >= params.batch_tokens:
                yield pa.RecordBatch.from_pylist(_counted(task << 24 | number, doc_ids, held, columns, parts), schema=schema)
                doc_ids, held, columns, tokens, number = [], [], [], 0, number + 1
        if columns:
            yield pa.RecordBatch.from_pylist(_counted(task << 24 | number, doc_ids, held, columns, parts), schema=schema)

    return saved(docs.withColumn("task", F.spark_partition_id()).mapInArrow(counted, COUNTED_ROW))


def _asked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """What several batches ask: all words and, for each pair, word place, context and training count; sizes by batch."""
    words, sizes, contexts, counts = [], [], [], []
    for blob in blobs:
        gaps, size, context, count = unpacked(blob)
        words.append(np.cumsum(gaps, dtype=np.uint64))
        sizes.append(size)
        contexts.append(context)
        counts.append(count)
    place = np.repeat(np.arange(sum(map(len, words))), np.concatenate(sizes))
    return np.concatenate(words), place, np.concatenate(contexts), np.concatenate(counts), [*map(len, words)], [*map(len, contexts)]


# ---- restaurants ----------------------------------------------------------------------------------------


class Tables:
    """The tables of many dishes, as one array of sizes in the order of dishes."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        # All customers of a dish share a table at first.
        self.customers = customers.astype(np.int64).copy()
        self.number = (self.customers > 0).astype(np.int64)
        self.sizes = self.customers[self.customers > 0].astype(np.float64)
        self._discount, self._rng = discount, rng

    def _starts(self) -> np.ndarray:
        return np.cumsum(self.number) - self.number

    def _drawn(self, dishes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A table of each dish, by weight."""
        reach = np.cumsum(weights)
        start = self._starts()[dishes]
        before = np.where(start > 0, reach[start - 1], 0.0)
        total = reach[start + self.number[dishes] - 1] - before
        drawn = np.searchsorted(reach, before + self._rng.random(len(dishes)) * total, "right")
        return np.clip(drawn, start, start + self.number[dishes] - 1)

    def remove(self, dishes: np.ndarray) -> np.ndarray:
        """Take a random customer of each dish out; whether that closed a table."""
        at = self._drawn(dishes, self.sizes)
        self.sizes[at] -= 1
        closed = self.sizes[at] == 0
        self.sizes = np.delete(self.sizes, at[closed])
        self.customers[dishes] -= 1
        self.number[dishes[closed]] -= 1
        return closed

    def add(self, dishes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Seat a customer of each dish, at a new table with weight fresh; whether that opened one."""
        old = self.customers[dishes] - self._discount * self.number[dishes]
        opened = (self._rng.random(len(dishes)) * (old + fresh) >= old) | (self.number[dishes] == 0)
        if not opened.all():
            self.sizes[self._drawn(dishes[~opened], self.sizes - self._discount)] += 1
        at = (self._starts() + self.number)[dishes[opened]]
        self.sizes = np.insert(self.sizes, at, 1.0)
        self.customers[dishes] += 1
        self.number[dishes[opened]] += 1
        return opened


    def _block(self, dishes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many customers of each dish come or go at once: an eighth of those there, so that odds hardly change."""
        return np.minimum(left, np.maximum(1, self.customers[dishes] // 8))

    def remove_many(self, dishes: np.ndarray, count: np.ndarray) -> None:
        """Take count random customers of each dish out, in blocks."""
        left = count.copy()
        while (some := np.flatnonzero(left > 0)).size:
            block = self._block(dishes[some], left[some])
            drawn = np.bincount(self._drawn(np.repeat(dishes[some], block), self.sizes), minlength=len(self.sizes))
            taken = np.minimum(drawn, self.sizes)  # a table drawn too often gives what it has
            owner = np.repeat(np.arange(len(self.number)), self.number)
            self.sizes = self.sizes - taken
            gone = np.bincount(owner, weights=taken, minlength=len(self.number)).astype(np.int64)
            empty = self.sizes == 0
            self.customers -= gone
            self.number -= np.bincount(owner[empty], minlength=len(self.number))
            self.sizes = self.sizes[~empty]
            left[some] -= gone[dishes[some]]

    def add_many(self, dishes: np.ndarray, count: np.ndarray, fresh: np.ndarray | float) -> None:
        """Seat count customers of each dish in blocks, each at a new table with weight fresh."""
        left, fresh = count.copy(), np.broadcast_to(np.asarray(fresh, dtype=np.float64), dishes.shape)
        while (some := np.flatnonzero(left > 0)).size:
            at = dishes[some]
            block = self._block(at, left[some])
            old = self.customers[at] - self._discount * self.number[at]
            opened = self._rng.binomial(block, np.where(self.number[at] == 0, 1.0, fresh[some] / (fresh[some] + old)))
            seated = np.repeat(at, block - opened)
            if len(seated):
                self.sizes = self.sizes + np.bincount(self._drawn(seated, self.sizes - self._discount), minlength=len(self.sizes))
            self.sizes = np.insert(self.sizes, np.repeat((self._starts() + self.number)[at], opened), 1.0)
            self.customers[at] += block
            self.number[at] += opened
            left[some] -= block

    def reseat(self, weight) -> None:
        """Take every customer out and seat it anew; weight(opened by dish so far) gives each dish's weight of a new table."""
        before, left = self.number.copy(), self.customers.copy()
        while (some := np.flatnonzero(left > 0)).size:
            block, fresh = self._block(some, left[some]), weight(self.number - before)[some]
            if block.max() == 1:
                self.remove(some)
                self.add(some, fresh)
            else:
                self.remove_many(some, block)
                self.add_many(some, block, fresh)
            left[some] -= block


def tables_by_size(customers: np.ndarray, discount: float, rng: np.random.Generator) -> list[tuple[np.ndarray, Tables]]:
    """Dishes and their tables by number of customers, so that a round's work is in proportion to the customers."""
    size = np.minimum(customers, ONE_BY_ONE)
    groups = [np.flatnonzero(size == s) for s in np.unique(size)]
    return [(g, Tables(customers[g], discount, rng)) for g in groups]


@dataclass(frozen=True)
class Totals:
    """What all parts share: by context its tokens and dishes; sums over all; discounts."""

    tokens: np.ndarray
    dishes: np.ndarray
    n_tokens: int
    n_words: int
    discount: float
    parent_discount: float


def sampled(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, part: int, params: PitmanYorParams):
    """(tables of each pair, parent's customers and tables of each word) of every sample.

    word, context, count: the pairs of a part seen in training, sorted; n_words: its words.
    """
    rng = np.random.default_rng([params.seed, part])
    d, d0 = totals.discount, totals.parent_discount
    floor = 1.0 / (totals.n_words + 1)
    many = np.flatnonzero(count > 1)  # a lone customer always has the one table
    groups = [(many[g], tables) for g, tables in tables_by_size(count[many], d, rng)]
    parent = Tables(np.bincount(word, minlength=n_words), d0, rng)
    by_context = totals.dishes.astype(np.float64)
    share = len(count) / max(int(totals.dishes.sum()), 1)
    out = []

    def believed() -> np.ndarray:
        """The parent's probability of each word; sums over the parts are told from this part's share of the dishes."""
        n, m = parent.customers.sum() / max(share, 1e-12), parent.number.sum() / max(share, 1e-12)
        p0 = params.parent_strength
        return (parent.customers - d0 * parent.number + (p0 + d0 * m) * floor) / (p0 + n)

    for turn in range(params.burn + params.samples * params.gap):
        change, base = np.zeros(n_words), believed()
        for pairs, tables in groups:
            before, own = tables.number.copy(), context[pairs]
            odds = base[word[pairs]]

            def weight(opened):
                return (params.strength + d * (by_context + np.bincount(own, weights=opened, minlength=1 << CONTEXT_BITS))[own]) * odds

            tables.reseat(weight)
            opened = tables.number - before
            by_context = by_context + np.bincount(own, weights=opened, minlength=1 << CONTEXT_BITS)
            change += np.bincount(word[pairs], weights=opened, minlength=n_words)
        change = change.astype(np.int64)
        new = lambda: (params.parent_strength + d0 * parent.number.sum() / max(share, 1e-12)) * floor
        less, more = np.flatnonzero(change < 0), np.flatnonzero(change > 0)
        parent.remove_many(less, -change[less])
        parent.add_many(more, change[more], new())
        if (shared := np.flatnonzero(parent.customers > 1)).size:
            parent.remove(shared)
            parent.add(shared, np.full(len(shared), new()))
        if turn >= params.burn and (turn - params.burn + 1) % params.gap == 0:
            number = np.ones(len(count), dtype=np.int64)
            for pairs, tables in groups:
                number[pairs] = tables.number
            out.append((number, parent.customers.copy(), parent.number.copy()))
    return out


# ---- the three passes over the parts ----------------------------------------------------------------------

STATE_ROW = "part int, words binary, pairs binary"


def _joined(blobs: list[bytes]):
    """(words, word of each trained pair, its context, its count) over several batches, sorted."""
    words, place, context, count, _, _ = _asked(blobs)
    distinct, word = np.unique(words, return_inverse=True)
    seen = count > 0
    keys, slot = np.unique(word[place[seen]] << CONTEXT_BITS | context[seen], return_inverse=True)
    total = np.bincount(slot, weights=count[seen], minlength=len(keys)).astype(np.int64)
    trained, word = np.unique(keys >> CONTEXT_BITS, return_inverse=True)
    return distinct[trained], word, (keys & ((1 << CONTEXT_BITS) - 1)).astype(np.int64), total


def _by_context(context: np.ndarray, *weights: np.ndarray) -> pa.Table:
    """Sums by context; context -1 holds what is not by context."""
    at = np.unique(context)
    sums = [np.bincount(context, weights=w, minlength=1 << CONTEXT_BITS)[at] for w in weights]
    return pa.table([pa.array(at), *map(pa.array, sums)], names=["context", *(f"x{k}" for k in range(len(weights)))])


def join_parts(counted: DataFrame) -> DataFrame:
    """STATE_ROW of every part: its words and the pairs seen in training; saved."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("batch")
        words, word, context, count = _joined(rows.column("pairs").to_pylist())
        part = rows.column("part")[0].as_py()
        blob = packed(word.astype(np.uint32), context.astype(np.uint16), count.astype(np.uint64))
        return pa.Table.from_pylist([{"part": part, "words": packed(words), "pairs": blob}], schema=pa.schema([("part", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())]))

    asked = counted.where("part >= 0").select("batch", "part", "pairs")
    return saved(asked.groupBy("part").applyInArrow(join, STATE_ROW))


def _opened(row: dict):
    word, context, count = unpacked(row["pairs"])
    return unpacked(row["words"])[0], word.astype(np.int64), context.astype(np.int64), count.astype(np.int64)


def totals_of(state: DataFrame) -> Totals:
    """Sums over all parts; a row for each context comes to the driver, of which there is a fixed number."""

    def summed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, word, context, count = _opened(row)
                t = _by_context(context, count, np.ones(len(count)), count == 1, count == 2)
                fans = np.bincount(word, minlength=len(words))
                apart = [len(words), (fans == 1).sum(), (fans == 2).sum(), 0]
                yield from t.to_batches()
                yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([float(x)]) for x in apart)], names=t.column_names)

    sums = [F.sum(f"x{k}").alias(f"x{k}") for k in range(4)]
    found = state.mapInArrow(summed, "context long, x0 double, x1 double, x2 double, x3 double").groupBy("context").agg(*sums).toArrow()
    at = found.column("context").to_numpy()
    x = np.stack([found.column(f"x{k}").to_numpy() for k in range(4)], axis=1).reshape(-1, 4)
    tokens, dishes = np.zeros(1 << CONTEXT_BITS), np.zeros(1 << CONTEXT_BITS)
    tokens[at[at >= 0]], dishes[at[at >= 0]] = x[at >= 0, 0], x[at >= 0, 1]
    n_words, one, two = (x[at == -1, :3].sum(axis=0) if (at == -1).any() else np.zeros(3)).tolist()
    # The usual estimate of a discount, from how many dishes have one customer and how many two.
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5
    once, twice = x[at >= 0, 2].sum(), x[at >= 0, 3].sum()
    return Totals(tokens, dishes, int(tokens.sum()), int(n_words), discount(once, twice), discount(one, two))


def tables_of(state: DataFrame, totals: Totals, params: PitmanYorParams) -> tuple[np.ndarray, np.ndarray]:
    """(tables by sample and context; parent's customers and tables by sample), over all parts."""

    def summed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, word, context, count = _opened(row)
                draws = sampled(word, context, count, len(words), totals, row["part"], params)
                t = _by_context(context, *(number for number, _, _ in draws))
                yield from t.to_batches()
                for context_id, column in ((-1, 1), (-2, 2)):
                    yield pa.RecordBatch.from_arrays([pa.array([context_id]), *(pa.array([float(draw[column].sum())]) for draw in draws)], names=t.column_names)

    names = [f"x{k}" for k in range(params.samples)]
    schema = ", ".join(["context long", *(f"{n} double" for n in names)])
    found = state.mapInArrow(summed, schema).groupBy("context").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    at = found.column("context").to_numpy()
    x = np.stack([found.column(n).to_numpy() for n in names], axis=0).reshape(params.samples, -1)
    by_context = np.zeros((params.samples, 1 << CONTEXT_BITS))
    by_context[:, at[at >= 0]] = x[:, at >= 0]
    parent = np.stack([x[:, at == k].sum(axis=1) for k in (-1, -2)], axis=1)
    return by_context, parent


ANSWER_ROW = "batch long, part int, answers binary"


def answers(counted: DataFrame, totals: Totals, by_context: np.ndarray, parent: np.ndarray, params: PitmanYorParams) -> DataFrame:
    """ANSWER_ROW: for the pairs of each batch and part, in their order, log10 probabilities; the words' counts and numbers of pairs."""
    schema = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("answers", pa.binary())])

    def answered(table: pa.Table) -> pa.Table:
        rows = table.sort_by("batch")
        blobs, part = rows.column("pairs").to_pylist(), rows.column("part")[0].as_py()
        words, word, context, count = _joined(blobs)
        draws = sampled(word, context, count, len(words), totals, part, params)
        times = np.bincount(word, weights=count, minlength=len(words) + 1).astype(np.uint64)  # the last: a word never seen
        asked, place, own_context, _, n_words, n_pairs = _asked(blobs)
        slot = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
        slot = np.where(words[slot] == asked, slot, len(words)) if len(words) else np.zeros(len(asked), dtype=np.int64)
        own_context = own_context.astype(np.int64)
        keys, key = word << CONTEXT_BITS | context, slot[place] << CONTEXT_BITS | own_context
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        known = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
        p = np.zeros(len(key))
        for k, (number, customers, seats) in enumerate(draws):
            n, m = parent[k]
            spare = (params.parent_strength + totals.parent_discount * m) / (totals.n_words + 1)
            base = (np.append(customers - totals.parent_discount * seats, 0.0) + spare) / (params.parent_strength + n)
            own = np.zeros(len(key))
            own[known] = count[at[known]] - totals.discount * number[at[known]]
            more = params.strength + totals.discount * by_context[k][own_context]
            p += (own + more * base[slot[place]]) / (params.strength + totals.tokens[own_context])
        logs = np.log10(np.minimum(p / len(draws), 1.0)).astype(np.float32)
        sizes = np.bincount(place, minlength=len(asked)).astype(np.uint32)
        out, i, j = [], 0, 0
        for batch, a, b in zip(rows.column("batch").to_pylist(), n_words, n_pairs):
            out.append({"batch": batch, "part": part, "answers": packed(logs[j : j + b], times[slot[i : i + a]], sizes[i : i + a])})
            i, j = i + a, j + b
        return pa.Table.from_pylist(out, schema=schema)

    asked = counted.where("part >= 0").select("batch", "part", "pairs")
    return asked.groupBy("part").applyInArrow(answered, ANSWER_ROW)


SCORED_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, params: PitmanYorParams = PitmanYorParams()) -> DataFrame:
    """SCORED_ROW of docs (doc_id, text, held_out), learned from those that are not held out."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(params.least_parts, -(-size // params.part_bytes))
    counted = count_batches(docs, parts, params)
    state = join_parts(counted)
    totals = totals_of(state)
    by_context, parent = tables_of(state, totals, params)
    told = answers(counted, totals, by_context, parent, params)
    n, v = totals.n_tokens, totals.n_words
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def scored(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        documents, told = rows[0], [unpacked(r["answers"]) for r in rows[1:]]
        logs, times, sizes = (np.concatenate(c) for c in zip(*told))
        of_pair = np.repeat(times, sizes).astype(np.float64)
        lengths = np.array(documents["lengths"], dtype=np.int64)
        ends = np.cumsum(lengths)
        gaps = unpacked(documents["places"])[0].astype(np.int64)
        run = np.cumsum(gaps)
        starts = ends - lengths
        place = run - np.repeat(run[starts] - gaps[starts], lengths)
        base = np.log10((of_pair + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x[place], starts) for x in (of_pair > 0, base, logs.astype(np.float64))]
        columns = [documents["doc_ids"], documents["held_out"], lengths, sums[0].astype(np.int64), np.full(len(lengths), n), sums[1], sums[2]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    documents = counted.where("part < 0").select("batch", "part", "doc_ids", "held_out", "lengths", "places")
    return documents.unionByName(told, allowMissingColumns=True).groupBy("batch").applyInArrow(scored, SCORED_ROW)


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the model and under the word counts alone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 1)))
