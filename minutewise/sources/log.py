"""An append log with offsets: numbered segments of raw lines, read as a stream from where a group of readers stopped.

A segment is a folder of parquet files with one column, `raw`. It counts once its writer has finished it, and never changes
after. An offset names the next row to read, as segment and row; rows of a segment are numbered through its files in
the order of their names. Spark keeps the offsets of a query in its checkpoint, so a stopped query goes on where it was.
A group's own positions, for whoever watches it, lie beside the segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "append_log"
ROW = "raw string, segment bigint, row bigint"

# Rows that a stream takes in at once, and that a task of it reads, unless told otherwise.
ROWS_PER_BATCH, ROWS_PER_TASK = 1_000_000, 100_000


@dataclass(frozen=True, order=True)
class Offset:
    """The next row to read."""

    segment: int = 0
    row: int = 0


@dataclass
class Range(InputPartition):
    """Rows first to last, the latter excluded, of a segment's file, which starts with row `start` of the segment."""

    path: str
    segment: int
    start: int
    first: int
    last: int


class Log:
    """The segments of a log folder and the positions of its groups; used on the driver."""

    def __init__(self, path: str):
        self._files, self._root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._sizes: dict[int, list[tuple[str, int]]] = {}

    def segments(self, since: int = 0) -> list[int]:
        """Numbers of the finished segments from one on."""
        found = self._files.get_file_info(fs.FileSelector(self._root, allow_not_found=True))
        numbers = sorted(int(f.base_name.partition("=")[2]) for f in found if f.base_name.startswith("segment="))
        # Those known already are finished; the marker of the others is looked for.
        return [n for n in numbers if n >= since and (n in self._sizes or self._finished(n))]

    def _finished(self, segment: int) -> bool:
        return self._files.get_file_info(f"{self._folder(segment)}/_SUCCESS").type == fs.FileType.File

    def _folder(self, segment: int) -> str:
        return f"{self._root}/segment={segment:012d}"

    def files(self, segment: int) -> list[tuple[str, int]]:
        """Path and number of rows of each file, from their footers."""
        if segment not in self._sizes:
            listed = self._files.get_file_info(fs.FileSelector(self._folder(segment)))
            paths = sorted(f.path for f in listed if f.base_name.endswith(".parquet"))
            with ThreadPoolExecutor(8) as pool:
                rows = list(pool.map(lambda p: pq.read_metadata(p, filesystem=self._files).num_rows, paths))
            self._sizes[segment] = list(zip(paths, rows))
        return self._sizes[segment]

    def rows(self, segment: int) -> int:
        return sum(n for _, n in self.files(segment))

    def after(self, start: Offset, limit: int | None) -> Offset:
        """The offset at most limit rows after start, or the newest one."""
        at = start
        for segment in self.segments(start.segment):
            begin = start.row if segment == start.segment else 0
            there = self.rows(segment) - begin
            if limit is not None and there >= limit:
                return Offset(segment, begin + limit)
            limit = None if limit is None else limit - there
            at = max(at, Offset(segment, begin + there))
        return at

    def between(self, start: Offset, end: Offset) -> int:
        """Rows from start to end, the latter excluded."""
        rows = 0
        for segment in self.segments(start.segment):
            if segment > end.segment:
                break
            first = start.row if segment == start.segment else 0
            rows += (end.row if segment == end.segment else self.rows(segment)) - first
        return max(rows, 0)

    def ranges(self, start: Offset, end: Offset, size: int) -> list[Range]:
        """What lies from start to end, in pieces of at most size rows of one file."""
        out = []
        for segment in self.segments(start.segment):
            if segment > end.segment:
                break
            low = start.row if segment == start.segment else 0
            high = end.row if segment == end.segment else self.rows(segment)
            begin = 0
            for path, n in self.files(segment):
                for first in range(max(low, begin), min(high, begin + n), size):
                    out.append(Range(path, segment, begin, first, min(first + size, high, begin + n)))
                begin += n
        return out

    def position(self, group: str) -> tuple[Offset, Offset]:
        """How far a group was handed rows, and how far it has finished them."""
        try:
            with self._files.open_input_stream(f"{self._root}/_groups/{group}.json") as file:
                known = json.loads(file.read())
        except FileNotFoundError:
            return Offset(), Offset()
        return Offset(**known["handed"]), Offset(**known["finished"])

    def place(self, group: str, handed: Offset, finished: Offset) -> None:
        self._files.create_dir(f"{self._root}/_groups")
        with self._files.open_output_stream(f"{self._root}/_groups/{group}.json") as file:
            file.write(json.dumps({"handed": asdict(handed), "finished": asdict(finished)}).encode())


class _Reader(DataSourceStreamReader):
    """Offsets on the driver, rows in the tasks."""

    def __init__(self, options):
        self._path, self._group = options["path"], options["group"]
        self._limit = int(options.get("maxRowsPerBatch", ROWS_PER_BATCH)) or None
        self._task_rows = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self._log: Log | None = None

    @property
    def log(self) -> Log:
        if self._log is None:
            self._log = Log(self._path)
        return self._log

    def initialOffset(self) -> dict:  # noqa: N802
        return asdict(Offset())

    def latestOffset(self) -> dict:  # noqa: N802
        # Spark may ask many times before it plans a batch, and doesn't say where it is: the limit counts from the last plan.
        handed, _ = self.log.position(self._group)
        return asdict(self.log.after(handed, self._limit))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        handed, finished = self.log.position(self._group)
        if Offset(**end) > handed:
            self.log.place(self._group, Offset(**end), finished)
        return self.log.ranges(Offset(**start), Offset(**end), self._task_rows)

    def commit(self, end: dict) -> None:
        handed, _ = self.log.position(self._group)
        self.log.place(self._group, handed, Offset(**end))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self._path) if "://" in self._path or self._path.startswith("file:") else (fs.LocalFileSystem(), None)
        with files.open_input_file(partition.path) as opened:
            stored, row = pq.ParquetFile(opened), partition.start
            # Row groups outside of the range are passed over by their counts.
            for k in range(stored.num_row_groups):
                n = stored.metadata.row_group(k).num_rows
                if row < partition.last and row + n > partition.first:
                    at = row
                    for batch in stored.iter_batches(row_groups=[k], columns=["raw"]):
                        low, high = max(partition.first - at, 0), min(partition.last - at, len(batch))
                        if low < high:
                            raw = batch.column(0).slice(low, high - low).cast(pa.string())
                            numbers = pa.array(range(at + low, at + high), pa.int64())
                            yield pa.RecordBatch.from_arrays([raw, pa.array([partition.segment] * len(raw), pa.int64()), numbers], ["raw", "segment", "row"])
                        at += len(batch)
                row += n


class AppendLog(DataSource):
    """Registered as `append_log`; options: path, group, maxRowsPerBatch (0: all there is), rowsPerTask.

    Spark asks sources written in Python once in a run with availableNow, so such a run takes one batch.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def append_segment(lines: DataFrame, path: str, segment: int) -> None:
    """Write `raw` lines as a segment; writing one again, as a replayed batch does, replaces it. Numbers must rise."""
    lines.select("raw").write.mode("overwrite").parquet(f"{path}/segment={segment:012d}")


def stream_log(spark: SparkSession, path: str, group: str, max_rows: int = ROWS_PER_BATCH) -> DataFrame:
    """The log as a stream of raw, segment, row. A group is one reader: the query that has its checkpoint."""
    spark.dataSource.register(AppendLog)
    return spark.readStream.format(FORMAT).option("path", path).option("group", group).option("maxRowsPerBatch", max_rows).load()


def group_lag(path: str, group: str) -> tuple[int, int, int]:
    """Rows in the log, rows handed out and not known to be finished, and rows not handed out yet."""
    log = Log(path)
    (handed, finished), newest = log.position(group), log.after(Offset(), None)
    return log.between(Offset(), newest), log.between(finished, handed), log.between(handed, newest)
