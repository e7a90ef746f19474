"""Tables that streams fold their batches into, by a commit log.

A table is a number of buckets by hash of a key.  A batch rewrites only the buckets that
its keys fall into, in a folder of its own, and then commits by appending one row a bucket
to the log, all in one file: a reader, a restart and the next batch see either all of it or
nothing.  A batch that is tried again after its commit does nothing; one that was lost
before its commit is worked out anew, and its folder is never read.  A table belongs to one
checkpoint, as its batches are known by their number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "batch long, bucket int, path string"
BUCKET = "_bucket"
Step = Callable[[DataFrame, DataFrame], DataFrame]


class CommittedTable:
    """A bucketed table under ``base``; ``first`` is its content before any batch."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str = "symbol", buckets: int = 8):
        self.spark, self.base, self.schema, self.key, self.buckets = spark, base, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.base}/log")
        except AnalysisException:  # nothing is committed yet
            return self.spark.createDataFrame([], LOG)

    def committed(self) -> int | None:
        """Number of the last batch in the log; -1 after the first content, None before it."""
        return self.log().agg(F.max("batch")).first()[0]

    def paths(self) -> dict[int, str]:
        """Folder of each bucket's newest version: one row a bucket."""
        return {r.bucket: r.path for r in self.log().groupBy("bucket").agg(F.max_by("path", "batch").alias("path")).collect()}

    def read(self, only: list[int] | None = None) -> DataFrame:
        by_path: dict[str, list[int]] = {}
        for b, path in self.paths().items():
            if only is None or b in only:
                by_path.setdefault(path, []).append(b)
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        parts = [self.spark.read.schema(stored).parquet(path).where(F.col(BUCKET).isin(held)).drop(BUCKET) for path, held in by_path.items()]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, batch: int, buckets: list[int], between: Callable[[int], None] | None = None) -> None:
        """Write ``rows`` as the new version of ``buckets`` and log it; ``between`` runs after the
        write and before the log."""
        path = f"{self.base}/data/{batch}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).write.partitionBy(BUCKET).parquet(path)
        if between:
            between(batch)
        self.spark.createDataFrame([(batch, b, path) for b in buckets], LOG).coalesce(1).write.mode("append").parquet(f"{self.base}/log")

    def start(self, first: DataFrame) -> None:
        if self.committed() is None:
            self.commit(first, -1, list(range(self.buckets)))

    def fold(self, stream: DataFrame, step: Step, between: Callable[[int], None] | None = None) -> DataFrame:
        """Fold all there is of ``stream`` in by ``step`` (rows of the touched buckets, batch) and
        read the table; a restart goes on with the same ``base``."""

        def batch(df: DataFrame, number: int) -> None:
            done = self.committed()
            if done is not None and number <= done:
                return
            df = df.persist()  # its keys are read before its rows
            try:
                touched = sorted(r.b for r in df.select(self.bucket().alias("b")).distinct().collect())
                if touched:
                    self.commit(step(self.read(touched), df), number, touched, between)
            finally:
                df.unpersist()

        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.read()


def fingerprint(ledger: DataFrame, bars: DataFrame, known: str = "updated_at") -> str:
    """What a report over ledger and bars depends on: counts, newest ids, times and a checksum."""
    a = ledger.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.sum(F.pmod(F.xxhash64(*sorted(ledger.columns)), F.lit(1 << 40))).alias("sum"))
    b = bars.agg(F.count(F.lit(1)).alias("bars"), F.max(known if known in bars.columns else "session_date").cast("string").alias("at"), F.sum(F.pmod(F.xxhash64(*sorted(bars.columns)), F.lit(1 << 40))).alias("bar_sum"))
    told = [df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0] for df in (a, b)]  # one row each
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


class KeyedReport:
    """A report that is worked out anew only when its fingerprint has changed (R7, A14)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.computed = 0

    def current(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored report of ``key``, or the one that ``make`` gives, stored first."""
        try:
            held = self.spark.read.schema("key string, path string").parquet(f"{self.base}/keys").where(F.col("key") == key).agg(F.min("path")).first()[0]
        except AnalysisException:
            held = None
        if held is None:
            held = f"{self.base}/reports/{uuid.uuid4().hex}"
            make().write.parquet(held)
            self.spark.createDataFrame([(key, held)], "key string, path string").write.mode("append").parquet(f"{self.base}/keys")
            self.computed += 1
        return self.spark.read.parquet(held)


def refresh_modes(stored: DataFrame, symbols: DataFrame, full_refreshes: DataFrame, now: Column, full_after_days: int = 7, overlap_days: int = 10) -> DataFrame:
    """(symbol, mode, since): how each symbol's series is to be refreshed (R1).

    ``full`` where nothing is stored, no full refresh is known or the last one is a week old;
    else ``overlap``, from ten days before the newest stored session.  ``full_refreshes`` has
    symbol and refreshed_at.
    """
    newest = stored.groupBy("symbol").agg(F.max("session_date").alias("newest"))
    last = full_refreshes.groupBy("symbol").agg(F.max("refreshed_at").alias("refreshed_at"))
    rows = symbols.select("symbol").distinct().join(newest, "symbol", "left").join(last, "symbol", "left")
    old = F.col("newest").isNull() | F.col("refreshed_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("refreshed_at") >= full_after_days * 86400)
    return rows.select("symbol", F.when(old, "full").otherwise("overlap").alias("mode"), F.when(~old, F.date_sub("newest", overlap_days)).alias("since"))


def refreshed(stored: DataFrame, batch: DataFrame, modes: DataFrame, step: Step) -> DataFrame:
    """``stored`` after ``batch``: symbols in mode ``full`` take the batch's series alone, others
    merge its rows from ``since`` on by ``step``."""
    full = modes.where("mode = 'full'").join(batch.select("symbol").distinct(), "symbol", "left_semi").select("symbol")
    rest = modes.where("mode = 'overlap'").select("symbol", "since")
    kept = stored.join(full, "symbol", "left_anti")
    merged = step(kept, batch.join(rest, "symbol").where(F.col("session_date") >= F.col("since")).select(*batch.columns))
    return merged.unionByName(batch.join(full, "symbol", "left_semi").select(*stored.columns))
