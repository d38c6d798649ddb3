"""The append log: offsets, limits, restarts and who is how far."""

import pytest
from pyspark.sql import functions as F

from minutewise.sources import log
from minutewise.sources.log import Log, Offset

EACH = {"processingTime": "0 seconds"}


@pytest.fixture
def home(spark, tmp_path):
    put(spark, tmp_path, 0, 0, 25, files=3)
    put(spark, tmp_path, 1, 25, 40)
    return tmp_path


def put(spark, home, segment, first, last, files=1):
    lines = spark.range(first, last).select(F.concat(F.lit("x"), "id").alias("raw"))
    log.append_segment(lines.repartition(files), str(home / "log"), segment)


def run(spark, home, limit, break_at=None):
    """Rows of each batch that ended; a break after a batch's rows were taken."""
    seen = []

    def take(batch, batch_id):
        seen.append(sorted(int(r.raw[1:]) for r in batch.collect()))
        if batch_id == break_at:
            raise RuntimeError("broken on purpose")

    rows = log.stream_log(spark, str(home / "log"), "g", limit)
    query = rows.writeStream.option("checkpointLocation", str(home / "cp")).trigger(**EACH).foreachBatch(take).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return seen


def test_offsets(home):
    held = Log(str(home / "log"))
    assert held.segments() == [0, 1] and held.rows(0) == 25
    assert held.after(Offset(), 10) == Offset(0, 10) and held.after(Offset(0, 20), 10) == Offset(1, 5)
    assert held.after(Offset(1, 5), None) == Offset(1, 15) == held.after(Offset(0, 25), 100)
    assert held.after(Offset(1, 15), 10) == Offset(1, 15)
    assert held.between(Offset(0, 20), Offset(1, 5)) == 10 and held.between(Offset(1, 5), Offset(0, 20)) == 0
    pieces = held.ranges(Offset(0, 3), Offset(1, 9), 4)
    assert sum(p.last - p.first for p in pieces) == 31 and max(p.last - p.first for p in pieces) <= 4
    assert Log(str(home / "nothing")).after(Offset(), 5) == Offset()


def test_limit_restart_and_lag(spark, home):
    path = str(home / "log")
    (home / "log" / "segment=000000000009").mkdir()  # its writer isn't done
    assert log.group_lag(path, "g") == (40, 0, 40)
    assert list(map(len, run(spark, home, 10))) == [10, 10, 10, 10]
    put(spark, home, 2, 40, 47, files=2)
    assert log.group_lag(path, "g")[2] == 7
    assert run(spark, home, 3)[-1:] and log.group_lag(path, "g")[2] == 0
    assert run(spark, home, 3) == []


def test_rows_count_once_over_a_break(spark, home):
    with pytest.raises(Exception):
        run(spark, home, 10, break_at=1)
    again = run(spark, home, 10)
    # The batch that broke comes again as it was; the ones before it don't.
    assert list(map(len, again)) == [10, 10, 10]
    first = sorted(set(range(40)) - {x for batch in again for x in batch})
    assert len(first) == 10
