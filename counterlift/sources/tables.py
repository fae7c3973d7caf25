"""Reading and writing the tables of the method: pairs, keyed results, run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("study_id", T.StringType()),
        T.StructField("test_store", T.LongType()),
        T.StructField("control_store", T.LongType()),
        T.StructField("abs_perc_diff", T.DoubleType()),
    ]
)

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()),
        T.StructField("query_step", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("query_start_time", T.TimestampNTZType()),
        T.StructField("query_end_time", T.TimestampNTZType()),
        T.StructField("query_duration_in_seconds", T.LongType()),
        T.StructField("query_duration_in_minutes", T.DoubleType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pairs_csv(spark: SparkSession, path: str, keep_study: bool = False) -> DataFrame:
    """Store pairs of a CSV with a header; the study column is ignored unless asked for."""
    df = spark.read.schema(PAIR_SCHEMA).option("header", True).csv(path)
    return df if keep_study else df.drop("study_id")


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Matched pairs as CSV with a header: test_store, control_store, abs_perc_diff."""
    pairs.select("test_store", "control_store", "abs_perc_diff").write.mode("overwrite").option("header", True).csv(path)


def create_or_replace(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes a result over whatever the path held and returns its scan."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyedTable:
    """A table of versioned key partitions below ``path``, whose rows are replaced key by key.

    ``data`` holds every version of a key's rows, ``manifest/n`` says which version of each key counts. A
    replacement writes the rows first and the next manifest last; a manifest counts once its job has
    committed it, so a reader sees the table before or after, and a writer that is lost leaves it as it was.
    One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "campaign_id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _listed(self, folder: str) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(there)] if fs.exists(there) else []

    def _newest(self) -> int:
        numbers = sorted((int(n) for n in self._listed(f"{self.path}/manifest") if n.isdigit()), reverse=True)
        return next((n for n in numbers if "_SUCCESS" in self._listed(f"{self.path}/manifest/{n}")), 0)

    def _manifest(self) -> DataFrame:
        n = self._newest()
        kind = self.schema[self.key].dataType.simpleString()
        shape = f"`{self.key}` {kind}, _version string"
        return self.spark.read.schema(shape).parquet(f"{self.path}/manifest/{n}") if n else self.spark.createDataFrame([], shape)

    def rows(self) -> DataFrame:
        """The counting version of every key."""
        now = self._manifest()
        if not any(n.startswith("_version=") for n in self._listed(f"{self.path}/data")):
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(self._stored()).parquet(f"{self.path}/data")
        return every.join(now, [self.key, "_version"], "left_semi").select(*self.schema.names)

    def replace(self, df: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """Replaces the rows of ``keys``, by default of those in ``df``, by the rows of ``df``; other keys stay.

        A key without rows in ``df`` has none afterwards. Keys must not be null. Returns the table.
        """
        version = uuid.uuid4().hex
        fresh = df.select(*self.schema.names).withColumn("_version", F.lit(version))
        # few files per key; a very large key is split
        fresh.hint("rebalance", self.key).write.mode("append").partitionBy("_version", self.key).parquet(f"{self.path}/data")
        written = [n for n in self._listed(f"{self.path}/data/_version={version}") if n.startswith(f"{self.key}=")]
        none = self.spark.createDataFrame([], self.schema).select(self.key)
        new = self.spark.read.schema(self._stored()).parquet(f"{self.path}/data").filter(F.col("_version") == version).select(self.key).distinct() if written else none
        gone = new if keys is None else keys.select(self.key).distinct().unionByName(new)
        n = self._newest()
        kept = self._manifest().join(gone, self.key, "left_anti")
        kept.unionByName(new.withColumn("_version", F.lit(version))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{n + 1}")
        return self.rows()

    def _stored(self) -> T.StructType:
        return T.StructType([*[f for f in self.schema if f.name != self.key], T.StructField("_version", T.StringType()), self.schema[self.key]])

    def delete_old(self) -> int:
        """Deletes versions and manifests that no longer count; returns how many version folders went."""
        n = self._newest()
        used = {r[0] for r in self._manifest().select("_version").distinct().collect()}  # one per replacement that still counts
        conf = self.spark._jsc.hadoopConfiguration()
        gone = 0
        for folder, names in ((f"{self.path}/data", [v for v in self._listed(f"{self.path}/data") if v.startswith("_version=") and v[9:] not in used]),
                              (f"{self.path}/manifest", [m for m in self._listed(f"{self.path}/manifest") if m.isdigit() and int(m) != n])):
            for name in names:
                there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
                there.getFileSystem(conf).delete(there, True)
                gone += name.startswith("_version=")
        return gone


def replace_keyed(df: DataFrame, path: str, key: str = "campaign_id", keys: DataFrame | None = None) -> DataFrame:
    """Replaces the rows of ``keys``, or of the keys present in ``df``, in the keyed table below ``path``.

    Running a campaign again therefore leaves one copy of its rows, and none if it found nothing.
    """
    return KeyedTable(df.sparkSession, path, df.schema, key).replace(df, keys)


def empty_like(df: DataFrame) -> DataFrame:
    """A table without rows and with the schema of ``df``."""
    return df.sparkSession.createDataFrame([], df.schema)


def zero_sku_log(campaigns: DataFrame, skus: DataFrame, start, end) -> DataFrame:
    """Run-log rows of the campaigns that were left out because none of their SKUs is promoted."""
    none = campaigns.select("campaign_id").distinct().join(skus.filter(F.col("article").isNotNull()).select("campaign_id").distinct(), "campaign_id", "left_anti")
    seconds = int((end - start).total_seconds())
    return none.select(
        "campaign_id", F.lit("1").alias("query_step"), F.lit("Excluded for having zero promoted skus").alias("query_type"),
        F.lit(start).cast("timestamp_ntz").alias("query_start_time"), F.lit(end).cast("timestamp_ntz").alias("query_end_time"),
        F.lit(seconds).cast("long").alias("query_duration_in_seconds"), F.lit(seconds / 60).alias("query_duration_in_minutes"),
    )


def log_entry(spark: SparkSession, campaign_id: str, step: str, kind: str, start, end) -> DataFrame:
    """One run-log row with its duration."""
    seconds = int((end - start).total_seconds())
    return spark.createDataFrame([(campaign_id, step, kind, start, end, seconds, seconds / 60)], RUN_LOG_SCHEMA)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def unfinished(campaigns: DataFrame, log: DataFrame, done_step: str) -> DataFrame:
    """Campaigns without a finished run in the log (NULL log keys match nothing)."""
    done = log.filter((F.col("query_step") == done_step) & F.col("campaign_id").isNotNull())
    return campaigns.join(done.select("campaign_id").distinct(), "campaign_id", "left_anti")


def run_progress(log: DataFrame, campaigns: DataFrame, done_step: str) -> DataFrame:
    """Campaigns done and remaining, mean minutes and the estimated hours left."""
    done = log.filter(F.col("query_step") == done_step).agg(
        F.count_distinct("campaign_id").alias("n_done"), F.avg("minutes").alias("avg_minutes"),
        (F.sum("minutes") / 60).alias("hours_elapsed"),
    )
    total = campaigns.agg(F.count_distinct("campaign_id").alias("n_total"))
    return (
        done.crossJoin(F.broadcast(total))
        .withColumn("n_remaining", F.col("n_total") - F.col("n_done"))
        .withColumn("hours_remaining", F.col("avg_minutes") * F.col("n_remaining") / 60)
        .drop("n_total")
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Latest step and longest duration per campaign."""
    return log.groupBy("campaign_id").agg(
        F.max("query_step").alias("latest_step"), F.max("minutes").alias("minutes")
    )
