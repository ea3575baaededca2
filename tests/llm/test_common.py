from types import SimpleNamespace

import pytest

from inkmeter.llm import common as C


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    assert C.shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert C.shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://x", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            C.shared_dir(session(master))


def test_release_deletes_what_was_written(spark):
    t = C.stable(spark.range(3), "here")
    path = C._written[-1].removeprefix("file://")
    import os

    assert t.count() == 3 and os.path.isdir(path)
    before = list(C._written)
    C.release(spark, C._written[-1:])
    assert not os.path.exists(path) and C._written == before[:-1]


def test_batches_to_workers_are_bounded(spark):
    assert [C._bytes(x) for x in ("64m", "67108864b", "2 g", "100", "-1b", "0")] == [64 << 20, 64 << 20, 2 << 30, 100, float("inf"), float("inf")]
    C.on_workers(spark)
    assert C._bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= C.BATCH_BYTES
