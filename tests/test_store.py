import pytest
from pyspark.sql import functions as F

from trackmill.streaming import store

DAY = 86_400_000_000
SCHEMA = "id long, us long, env string"


@pytest.fixture
def held(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"))


def rows(spark, ids, env="e", days=5):
    return spark.createDataFrame([(i, (i % days) * DAY + i, env) for i in ids], SCHEMA)


def ids(s):
    return sorted(r["id"] for r in s.read(SCHEMA).collect())


def test_a_batch_that_is_run_again_writes_its_rows_once(spark, held):
    assert ids(held) == []
    held.flush(rows(spark, range(20)), 0)
    held.flush(rows(spark, range(20, 30)), 1)
    held.flush(rows(spark, range(20, 30)), 1)
    assert ids(held) == list(range(30))


def test_a_stream_that_is_stopped_and_resumed(spark, tmp_path, held):
    into = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(into)
    for n in range(3):
        rows(spark, range(10 * n, 10 * n + 10)).coalesce(1).write.mode("append").parquet(into)
    failed = []

    def fail(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the flush of batch 1")

    q = store.run_loop(stream(), str(tmp_path / "cp"), [(1, held.flush), (1, fail)])
    with pytest.raises(Exception, match="lost after"):
        q.awaitTermination()
    assert ids(held) == list(range(20))  # batch 1 was written, but not committed
    counted = []
    store.run_loop(stream(), str(tmp_path / "cp"), [(1, held.flush), (2, lambda b, n: counted.append(n))]).awaitTermination()
    assert ids(held) == list(range(30)) and counted == [2]


def test_expired_days_go(spark, held):
    held.flush(rows(spark, range(50)).unionByName(rows(spark, range(100, 120), "f")), 0)
    held.flush(rows(spark, range(50, 60)).unionByName(rows(spark, range(200, 210), "kept")), 1)
    assert held.clean({"e": 2, "f": 0}, 4) == 2 * 2 + 4
    assert ids(held) == [i for i in range(60) if i % 5 >= 2] + [i for i in range(100, 120) if i % 5 == 4] + list(range(200, 210))


def test_compaction_keeps_all_rows_in_fewer_files(spark, held):
    for n in range(4):
        held.flush(rows(spark, range(n, 400, 4)), n)
    before = len(held.live())
    assert held.compact(3, SCHEMA) == 3 * 4
    assert ids(held) == list(range(400)) and len(held.live()) == before - 9
    files = [r[0] for r in held.read(SCHEMA).where(F.col("us") < 3 * DAY).select(F.col("_metadata.file_path")).distinct().collect()]
    assert len(files) == 3 and all("zstd" in f for f in files)
    held.flush(rows(spark, range(400, 410)), 4)  # late rows of packed days
    assert ids(held) == list(range(410))
    assert held.compact(3, SCHEMA) == 6 and held.compact(3, SCHEMA) == 0
    assert ids(held) == list(range(410)) and len([p for p in held.live() if p.startswith("packed")]) == 3


@pytest.mark.parametrize("stop", ["written", "listed"])
def test_a_crash_in_a_compaction_loses_and_repeats_nothing(spark, held, stop):
    for n in range(2):
        held.flush(rows(spark, range(n, 60, 2)), n)
    held.compact(4, SCHEMA, stop=stop)
    assert ids(held) == list(range(60))
    held.compact(4, SCHEMA)
    assert ids(held) == list(range(60)) and len(held._glob("packed=*")) == 1
    assert len(held._glob("batch=*/p_env=*/p_day=*")) == 2  # the fifth day's
