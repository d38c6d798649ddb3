from types import SimpleNamespace

import pytest

from minutewise.session import shared_folder, small


def session(master, setting=None, directory=None):
    unique = SimpleNamespace(randomUUID=lambda: SimpleNamespace(toString=lambda: "u"))
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: directory),
        _jvm=SimpleNamespace(java=SimpleNamespace(util=SimpleNamespace(UUID=unique))),
    )


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_no_silent_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master))


def test_shared_folder_follows_the_cluster():
    assert shared_folder(session("yarn", "hdfs://n/cp/")) == "hdfs://n/cp/minutewise/app/u"
    assert shared_folder(session("yarn", None, "hdfs://n/set/x")) == "hdfs://n/set/x/minutewise/app/u"
    assert shared_folder(session("local[4]")).rpartition("/")[2].startswith("minutewise-")


def test_only_counted_small_tables_are_broadcast(spark):
    rows = spark.range(10)
    assert "ResolvedHint" in small(rows, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small(rows, 9)._jdf.queryExecution().analyzed().toString()
