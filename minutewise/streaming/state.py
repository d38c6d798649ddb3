"""What the streaming queries keep per key in Spark's state store, between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

# Rows of a frame handed back to Spark.
_CHUNK = 10_000


class OpenBucket(StatefulProcessor):
    """The value counts of a part of an open bucket, keyed by bucket (microseconds), service, endpoint and part.

    A batch adds its counts, rewrites only the values it brings, and gives back all of the part's values; a row with
    n = 0 only asks for them. A timer at the bucket's end clears the state once the watermark has passed, and rows of a
    bucket that ended no later than the watermark are late and dropped.
    """

    OUTPUT = "bucket long, service string, endpoint string, latency_ms double, n long, errors long"

    def __init__(self, window_seconds: int):
        self._width_ms = window_seconds * 1000

    def init(self, handle) -> None:
        self._handle = handle
        self._counts = handle.getMapState("counts", "latency_ms double", "n long, errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end_ms = key[0] // 1000 + self._width_ms
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            return
        added: dict[float, tuple[int, int]] = {}
        for frame in rows:
            real = frame[frame["n"] > 0]
            sums = real.groupby("latency_ms", sort=False)[["n", "errors"]].sum()
            for value, n, errors in zip(sums.index, sums["n"], sums["errors"]):
                before = added.get(value, (0, 0))
                added[value] = (before[0] + int(n), before[1] + int(errors))
        known = self._counts.exists()
        if added and not known:
            self._handle.registerTimer(end_ms)
        out: list[tuple[float, int, int]] = []
        # Values that the batch doesn't bring pass through; nothing but the batch is held.
        for (value,), (n, errors) in self._counts.iterator() if known else ():
            if value in added:
                added[value] = (added[value][0] + n, added[value][1] + errors)
            else:
                out.append((value, n, errors))
            if len(out) == _CHUNK:
                yield self._frame(key, out)
                out = []
        for value, counts in added.items():
            self._counts.updateValue((value,), counts)
            out.append((value, *counts))
        for start in range(0, len(out), _CHUNK):
            yield self._frame(key, out[start : start + _CHUNK])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._counts.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, rows) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["latency_ms", "n", "errors"])
        return frame.assign(bucket=key[0], service=key[1], endpoint=key[2])[["bucket", "service", "endpoint", "latency_ms", "n", "errors"]]


class SeriesTail(StatefulProcessor):
    """The last rows of a series, keyed by service and endpoint.

    A batch's rows that are newer than what is known come back with fresh = true, after the kept rows, which are their
    history. Buckets of a series arrive in order, so anything not newer was seen before; of repeats in a batch the row
    with most requests counts. A series whose newest bucket lies ttl_seconds behind the watermark is forgotten.
    """

    ROW = "bucket long, request_count long, error_count long, p50 double, p95 double, p99 double"
    OUTPUT = f"service string, endpoint string, {ROW}, fresh boolean"
    _FIELDS = ["bucket", "request_count", "error_count", "p50", "p95", "p99"]

    def __init__(self, rows: int, ttl_seconds: int):
        self._rows, self._ttl_ms = rows, ttl_seconds * 1000

    def init(self, handle) -> None:
        self._handle = handle
        self._tail = handle.getListState("tail", self.ROW)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        known = [tuple(r) for r in self._tail.get()]
        self._keep(known, self._records(initialState))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = [tuple(r) for r in self._tail.get()]
        newest = known[-1][0] if known else None
        best: dict[int, tuple] = {}
        for frame in rows:
            for row in self._records(frame):
                if newest is None or row[0] > newest:
                    # Most requests first, then the rest of the row: the same one in every rerun.
                    best[row[0]] = max(best.get(row[0], row), row, key=lambda r: r[1:])
        if not best:
            return
        fresh = [best[b] for b in sorted(best)]
        self._keep(known, fresh)
        frame = pd.DataFrame(known + fresh, columns=self._FIELDS)
        yield frame.assign(service=key[0], endpoint=key[1], fresh=[False] * len(known) + [True] * len(fresh))[["service", "endpoint", *self._FIELDS, "fresh"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self._due([tuple(r) for r in self._tail.get()])
        if due > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(due)
        else:
            self._tail.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _keep(self, known: list[tuple], fresh: list[tuple]) -> None:
        kept = sorted(known + fresh)[-self._rows :]
        self._tail.put(kept)
        # One timer at a time; it looks again for what came since when it is due.
        if not known:
            self._handle.registerTimer(self._due(kept))

    def _due(self, rows: list[tuple]) -> int:
        return rows[-1][0] // 1000 + self._ttl_ms

    def _records(self, frame: pd.DataFrame) -> list[tuple]:
        return list(frame[self._FIELDS].astype(object).itertuples(index=False, name=None))
