"""A store that a stream is flushed into: idempotent by batch, cleaned of expired days, compacted.

Every micro-batch has a folder of its own, partitioned by environment and day, and overwrites it when it
is run again, so that a job that is stopped and resumed holds each row once. A compaction writes the chosen
days into a folder of its own and then, as one rename, puts a list beside it of what it replaces; from this
moment readers take it in the place of these. Whatever a crash leaves is either not listed yet, and
ignored, or listed already, and skipped, until the next compaction removes it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackmill.sources import views as V
from trackmill.sources.tables import materialise
from trackmill.streaming.stream import event_stream

#: Retention of the query, in days by environment; days after which the query compacts.
RETAIN, COMPACT = {"campus": 20, "factory": 10}, 7
_LIST = "replaces"


class Store:
    """Rows with env and us under a folder that the cluster shares; days are whole days of us."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _glob(self, pattern: str) -> list[str]:
        """Folders below the root, as paths from it."""
        found = self.fs.globStatus(self._path(f"{self.root}/{pattern}")) or []
        names = (str(x.getPath().toUri().getPath()) for x in found)
        return sorted(n[n.rindex("/" + re.split(r"[=*]", pattern)[0]) + 1 :] for n in names)

    def flush(self, rows: DataFrame, batch: int) -> None:
        """Write a micro-batch, or write it again."""
        cut = rows.withColumns({"p_env": F.col("env"), "p_day": F.floor(F.col("us") / V.DAY)})
        cut.write.mode("overwrite").partitionBy("p_env", "p_day").parquet(f"{self.root}/batch={batch}")

    def _runs(self) -> dict[str, list[str]]:
        """Compactions that count, and what each replaces."""
        out = {}
        for path in self._glob(f"packed=*/{_LIST}"):
            text = self.spark.read.text(f"{self.root}/{path}", wholetext=True).first()
            out[path.split("/")[0]] = text[0].split("\n") if text else []
        return out

    def live(self) -> dict[str, tuple[str, int]]:
        """Folders of one environment and day that hold the rows: path to (env, day)."""
        runs = self._runs()
        gone = {x for r in runs.values() for x in r}
        paths = self._glob("batch=*/p_env=*/p_day=*") + [p for p in self._glob("packed=*/p_env=*/p_day=*") if p.split("/")[0] in runs]
        key = lambda p: (re.search(r"p_env=([^/]*)", p)[1], int(re.search(r"p_day=(-?\d+)", p)[1]))
        return {p: key(p) for p in paths if p not in gone}

    def read(self, schema, paths: Iterable[str] | None = None) -> DataFrame:
        """The rows, or those of some folders."""
        paths = list(self.live() if paths is None else paths)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _delete(self, paths: Iterable[str]) -> None:
        for p in paths:
            self.fs.delete(self._path(f"{self.root}/{p}"), True)

    def clean(self, retain: dict[str, int], today: int) -> int:
        """Delete days that are older than their environment's retention; how many folders went.
        Environments without a policy stay."""
        old = [p for p, (env, day) in self.live().items() if env in retain and day < today - retain[env]]
        self._delete(old)
        return len(old)

    def compact(self, before: int, schema, codec: str = "zstd", stop: str | None = None) -> int:
        """Rewrite the days before `before` that a batch's folder holds, with a codec that packs well; how many
        folders were replaced. stop (for tests): "written" or "listed", where it ends as if it had crashed."""
        runs = self._runs()
        self._delete([p for p in self._glob("packed=*") if p not in runs])  # never listed
        for listed in runs.values():
            self._delete(listed)
        todo = {p for p, (_, day) in self.live().items() if day < before and p.startswith("batch=")}
        days = {self.live()[p] for p in todo}
        todo |= {p for p, day in self.live().items() if day in days}  # with what was packed of them
        if not todo:
            return 0
        run = f"packed={uuid.uuid4().hex}"
        rows = self.read(schema, sorted(todo)).withColumns({"p_env": F.col("env"), "p_day": F.floor(F.col("us") / V.DAY)})
        rows.hint("rebalance", "p_env", "p_day").write.option("compression", codec).partitionBy("p_env", "p_day").parquet(f"{self.root}/{run}")
        if stop == "written":
            return 0
        draft = self._path(f"{self.root}/{run}/{_LIST}.draft")
        out = self.fs.create(draft)
        out.write(bytearray("\n".join(sorted(todo)).encode()))
        out.close()
        self.fs.rename(draft, self._path(f"{self.root}/{run}/{_LIST}"))
        if stop != "listed":
            self._delete(sorted(todo))
        return len(todo)


def run_loop(stream: DataFrame, where: str, steps: list[tuple[int, Callable[[DataFrame, int], None]]], every: str | None = None) -> StreamingQuery:
    """A loop over a stream's micro-batches: of steps (n, f), f(batch, number) runs in every n-th one. every: the
    trigger's interval, such as "30 seconds"; none takes what is there and ends. where: the checkpoint's folder."""

    def one(batch: DataFrame, number: int) -> None:
        for n, f in steps:
            if number % n == 0:
                f(batch, number)

    writer = stream.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", where)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- queries

SCHEMA = "id long, us long, person string, camera string, env string, x double, y double"


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def flush_and_clean(s: SparkSession, d: str) -> DataFrame:
    """Events flushed as a stream, and cleaned by retention after the last batch's newest day."""
    _, path = materialise(s.range(0))
    store = Store(s, path + "-store")

    def clean(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("us")).first()[0]
        if newest is not None:
            store.clean(RETAIN, newest // V.DAY)

    run_loop(_columns(event_stream(s, d)), path + "-state", [(1, store.flush), (1, clean)]).awaitTermination()
    return store.read(SCHEMA).groupBy("env").agg(F.count("*").alias("n"), F.min("us").alias("oldest"), F.count_distinct(F.floor(F.col("us") / V.DAY)).alias("days"))


def compacted_store(s: SparkSession, d: str) -> DataFrame:
    """Events flushed in three batches and compacted: rows, and by how many folders each day is held."""
    _, path = materialise(s.range(0))
    store = Store(s, path + "-store")
    rows = _columns(V.tracking_events(s, d))
    for n in range(3):
        store.flush(rows.where(F.col("id") % 3 == n), n)
    store.compact(rows.agg(F.max("us")).first()[0] // V.DAY - COMPACT, SCHEMA)
    held = store.read(SCHEMA).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1))
    return held.groupBy("env", F.floor(F.col("us") / V.DAY).alias("day")).agg(F.count("*").alias("n"), F.count_distinct("folder").alias("folders"), F.sum("id").alias("ids"))


QUERIES = {f.__name__: f for f in (flush_and_clean, compacted_store)}
_DAY = "us // 86400000000"
SQL = {
    "flush_and_clean": f"WITH {V.EVENTS_SQL} SELECT env, count(*) AS n, min(us) AS oldest, count(DISTINCT {_DAY}) AS days FROM ev WHERE {_DAY} >= (SELECT max({_DAY}) FROM ev) - CASE env WHEN 'campus' THEN 20 ELSE 10 END GROUP BY env",
    "compacted_store": f"WITH {V.EVENTS_SQL}, g AS (SELECT env, {_DAY} AS day, count(*) AS n, count(DISTINCT id % 3) AS parts, sum(id)::BIGINT AS ids FROM ev GROUP BY 1, 2) SELECT env, day, n, CASE WHEN day < (SELECT max(day) FROM g) - 7 THEN 1 ELSE parts END AS folders, ids FROM g",
}
