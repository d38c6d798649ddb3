"""The registry without the optional part, in a process of its own; how the late runs get their events."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as app

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys
from importlib.abc import MetaPathFinder

class Hidden(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {hidden}:
            raise ModuleNotFoundError("hidden", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as app
names = set(app.queries())
assert names == set(app._telemetry_queries()) | {kept}, names
assert set(app.oracle_sql()) <= names
"""


@pytest.mark.parametrize(
    "hidden, kept",
    [(["minutewise.llm"], "set()"), (["corpus_pipeline"], "set(app.llm.QUERIES)"), (["corpus_pipeline", "minutewise.llm"], "set()")],
)
def test_import_with_parts_hidden(hidden, kept):
    if "llm" in kept and not (ROOT / "minutewise" / "llm").exists():
        pytest.skip("the optional part is gone")
    code = HIDDEN.format(hidden=hidden, kept=kept)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_late_runs_write_in_parts_and_read_in_one_batch(spark, tmp_path):
    rest = "id AS user_id", "'view' AS event_type", "1.5D AS value", """'{"k": 1}' AS props"""
    for p, day in enumerate(("2024-01-05", "2024-01-25")):
        rows = spark.range(0, 1000, 1, 4).selectExpr(f"{1000 * p} + id AS event_id", f"TIMESTAMP_NTZ '{day}' AS ts", *rest)
        rows.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    batches = []

    def start(events):
        rows = events.writeStream.foreachBatch(lambda batch, _: batches.append(batch.count()))
        return rows.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    app._run_twice(spark, str(tmp_path), str(tmp_path), start)
    # The first write holds one in ten twice, and leaves one in ten to the second.
    assert batches == [1000, 1100]
    assert len(list((tmp_path / "log").glob("*.parquet"))) > 4
