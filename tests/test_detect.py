import random
import statistics
from datetime import datetime

import pytest
from conftest import minute
from pyspark.sql import functions as F

from minutewise.functions.forest import flagged_scores, forest_scores
from minutewise.operators import detect as det
from minutewise.operators.history import latest_rows
from minutewise.params import Params
from minutewise.schemas import METRIC
from minutewise.sources import tables

STABLE = [61, 64, 58, 63, 60, 59, 62, 65, 57, 61]  # mean 61, deviation about 2.6


def series(spark, p95s, name="a"):
    rows = [(minute(i), name, "/x", 100, 2, 50.0, float(v), 110.0) for i, v in enumerate(p95s)]
    return spark.createDataFrame(rows, METRIC)


def last(spark, kind, history, current, params=Params()):
    metrics = series(spark, [*history, current])
    rows = getattr(det, kind)(metrics, "p95", params).where(F.col("minute_bucket") == F.lit(minute(len(history))))
    found = rows.collect()
    return found[0].score if found else None


def test_short_history(spark):
    assert last(spark, "zscore", STABLE[:5], 500) is None and last(spark, "ewma", STABLE[:5], 500) is None


def test_normal_value(spark):
    assert last(spark, "zscore", STABLE, 66) is None and last(spark, "ewma", STABLE, 62) is None


def test_high_and_low_values(spark):
    assert last(spark, "zscore", STABLE, 1000) > 3 and last(spark, "ewma", STABLE, 1000) > 3
    assert last(spark, "zscore", STABLE, 1) < -3


def test_constant_history(spark):
    assert last(spark, "zscore", [50] * 10, 999) is None and last(spark, "ewma", [50] * 10, 999) is None


def test_ewma_forgets_an_old_outlier(spark):
    params = Params(min_history=26, zscore_threshold=0.0)
    history = [40] * 7 + [300] + [40] * 18
    assert abs(last(spark, "ewma", history, 75, params)) > abs(last(spark, "zscore", history, 75, params))


def twin_zscore(current, history, threshold=3.0):
    dev = statistics.stdev(history)
    z = (current - statistics.mean(history)) / dev if dev else 0.0
    return z if dev and abs(z) >= threshold else None


def twin_ewma(current, history, alpha=0.3, threshold=3.0):
    mean, var = history[0], 0.0
    for v in history[1:]:
        move = alpha * (v - mean)
        var = (1 - alpha) * (var + (v - mean) * move)
        mean += move
    z = (current - mean) / var**0.5 if var else 0.0
    return z if var and abs(z) >= threshold else None


def random_metrics(spark, seed=11, length=120):
    rng = random.Random(seed)
    rows = []
    for s in range(4):
        bucket = 0
        for _ in range(length if s else length * 5):  # the first series is far longer
            bucket += rng.choice([1, 1, 1, 2, 40, 1500])  # gaps don't count as history
            n = rng.randint(1, 50)
            p95 = rng.choice([80.0, rng.gauss(100, 10), rng.gauss(100, 10), 400.0])
            rows.append((minute(bucket), f"s{s}", "/x", n, rng.randint(0, n) if rng.random() < 0.2 else 0,
                         p95 / 2, p95, p95 * 1.2))
    return spark.createDataFrame(rows, METRIC), rows


def twin_hits(rows, signal):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    value = (lambda r: r[6]) if signal == "p95" else (lambda r: r[4] / r[3])
    z, e = {}, {}
    for name, points in by.items():
        for i in range(10, len(points)):
            history = [value(p) for p in points[i - 10 : i]]
            key = (points[i][0].replace(tzinfo=None), name)
            for out, score in ((z, twin_zscore(value(points[i]), history)), (e, twin_ewma(value(points[i]), history))):
                if score is not None:
                    out[key] = score
    return z, e


@pytest.mark.parametrize("signal", ["p95", "error_rate"])
@pytest.mark.parametrize("chunk_rows", [31, 500])
def test_scores_equal_a_plain_loop(spark, signal, chunk_rows):
    metrics, rows = random_metrics(spark)
    z, e = twin_hits(rows, signal)
    params = Params(chunk_rows=chunk_rows)
    for kind, expected in (("zscore", z), ("ewma", e)):
        got = {(r.minute_bucket, r.service): r.score for r in getattr(det, kind)(metrics, signal, params).collect()}
        assert len(expected) > 5 and got == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("chunk_rows", [40, 500])
def test_since_changes_nothing_but_the_range(spark, chunk_rows):
    metrics, rows = random_metrics(spark, 12)
    params = Params(chunk_rows=chunk_rows)
    buckets = sorted(r[0] for r in rows)
    start = buckets[len(buckets) // 2]
    key = ["minute_bucket", "service", "detector", "signal", "score"]
    full = det.detect(metrics, params).where(F.col("minute_bucket") >= F.lit(start)).select(*key)
    part = det.detect(metrics, params, since=start).select(*key)
    assert sorted(part.collect()) == sorted(full.collect()) and part.count() > 0


def test_earlier_rows_are_history_only(spark):
    metrics, rows = random_metrics(spark, 13)
    cut = sorted(r[0] for r in rows)[len(rows) // 2]
    older, newer = metrics.where(F.col("minute_bucket") < F.lit(cut)), metrics.where(F.col("minute_bucket") >= F.lit(cut))
    tail = latest_rows(older, 30)
    key = ["minute_bucket", "service", "detector", "signal", "score"]
    assert sorted(det.detect(newer, earlier=tail).select(*key).collect()) == sorted(
        det.detect(metrics, since=cut).select(*key).collect()
    )


def sample(i):
    """A quiet series, different in every bucket."""
    return (240 + 7 * i % 11, 1 + 3 * i % 4, 12.0 + i * i % 5, 31.0 + 5 * i % 9, 44.0 + i % 6)


SPIKE = (255, 130, 410.0, 1200.0, 1750.0)


def bucket_rows(spark, points):
    rows = [(minute(i), "a", "/x", *p) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, METRIC)


def found_at_end(spark, points, params=Params()):
    rows = det.detect(bucket_rows(spark, points), params, since=minute(len(points) - 1)).collect()
    assert all(r.reason for r in rows)
    return rows


def test_forest_on_few_rows(spark):
    points = [sample(i) for i in range(15)]
    params = Params(forest_min_history=10)
    for current, history in ((sample(4), points), (SPIKE, points[:5])):
        rows = det.forest(bucket_rows(spark, [*history, current]), params, since=minute(len(history))).collect()
        assert rows == []
    out = [det.forest(bucket_rows(spark, [*points, (249, 90, 300.0, 700.0, 960.0)]), params, since=minute(15)).collect()
           for _ in range(2)]
    assert out[0] == out[1] and len(out[0]) == 1 and out[0][0].score < 0


def test_fusion(spark):
    points = [sample(i) for i in range(30)]
    assert found_at_end(spark, [*points, sample(30)]) == []
    assert found_at_end(spark, [SPIKE]) == []
    assert {"zscore", "isolation_forest"} <= {r.detector for r in found_at_end(spark, [*points, SPIKE])}
    few = {r.detector for r in found_at_end(spark, [*points[:15], SPIKE])}
    assert "zscore" in few and "isolation_forest" not in few


def test_finding_ids_and_reasons(spark):
    points = [sample(i) for i in range(30)]
    rows = found_at_end(spark, [*points, SPIKE])
    again = found_at_end(spark, [*points, SPIKE])
    assert sorted(r.id for r in rows) == sorted(r.id for r in again) and len({r.id for r in rows}) == len(rows)
    texts = {(r.detector, r.signal): r.reason for r in rows}
    assert texts["zscore", "p95"].startswith("p95 latency 1200.0ms is ")
    assert texts["zscore", "p95"].endswith(" std devs from the 10-bucket baseline")
    assert texts["ewma", "error_rate"].endswith(" std devs from the EWMA baseline (alpha=0.3)")
    assert "lower = more anomalous" in texts["isolation_forest", "multivariate"]
    assert isinstance(rows[0].created_at, datetime)


def test_forest_separates_outliers():
    import numpy as np

    rng = np.random.RandomState(0)
    history = rng.normal(size=(40, 30, 5))
    normal, far = np.zeros((40, 5)), np.full((40, 5), 9.0)
    trained, near_score = forest_scores(history, normal)
    _, far_score = forest_scores(history, far)
    assert trained.shape == (40, 30) and (trained < 0).all() and (trained > -1).all()
    assert (far_score < near_score).all()
    assert not np.isnan(flagged_scores(history, far, 0.05)).any()
    assert np.isnan(flagged_scores(history, normal, 0.05)).all()


def test_forest_answers_do_not_depend_on_the_batch():
    import numpy as np

    rng = np.random.RandomState(1)
    history, current = rng.normal(size=(150, 30, 5)), rng.normal(size=(150, 5)) * 2
    whole = flagged_scores(history, current, 0.05)
    single = np.array([flagged_scores(history[i : i + 1], current[i : i + 1], 0.05)[0] for i in range(150)])
    np.testing.assert_array_equal(whole, single)


def test_forest_on_constant_and_long_histories():
    import numpy as np

    flat = np.ones((2, 30, 5))
    assert np.isnan(flagged_scores(flat, np.ones((2, 5)), 0.05)).all()
    long = np.random.RandomState(2).normal(size=(1, 600, 5))  # more rows than a tree samples
    _, score = forest_scores(long, np.full((1, 5), 8.0))
    assert score[0] < -0.6


def test_unknown_signal(spark):
    with pytest.raises(ValueError):
        det.zscore(series(spark, STABLE), "p50")


def test_history_is_searched_back_only_as_far_as_needed(spark, tmp_path, monkeypatch):
    def days(name, numbers):
        return [(minute(1440 * d + k), name, "/x", 10, 0, 1.0, 1.0, 1.0) for d in numbers for k in range(4)]

    rows = days("dense", range(40)) + days("sparse", [2, 30, 39]) + days("gone", range(39))
    tables.write_batch(spark.createDataFrame(rows, METRIC), str(tmp_path / "m"), 0)
    asked = []
    read = tables.read_metrics
    monkeypatch.setattr(tables, "read_metrics", lambda s, c, r=None, start=None, end=None: (asked.append((start, end)), read(s, c, r, start, end))[1])
    for n in (8, 9):
        wanted, earlier = tables.read_since(spark, str(tmp_path / "m"), minute(1440 * 39), n)
        assert wanted.count() == 8
        got = sorted((r.service, r.minute_bucket) for r in earlier.collect())
        past = [r for r in rows if r[0] < minute(1440 * 39)]
        want = [(s, r[0]) for s in ("dense", "sparse") for r in [x for x in past if x[1] == s][-n:]]
        assert [(s, m.replace(tzinfo=None)) for s, m in got] == sorted((s, m.replace(tzinfo=None)) for s, m in want)
    asked.clear()
    wanted, earlier = tables.read_since(spark, str(tmp_path / "m"), minute(1440 * 39), 4)
    # Four rows of `dense` lie a day back, those of `sparse` nine; days before the second week are never opened.
    assert earlier.count() == 8 and min(start for start, _ in asked[1:]) >= minute(1440 * 7) and len(asked) == 5
