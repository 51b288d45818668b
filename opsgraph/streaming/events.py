"""Structured Streaming over event files: windows with a watermark, deduplication, and keyed upserts of each batch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Event files of a folder as they come, `files` a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark; state older than that is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows. Also right for a table that doesn't stream."""
    timed = events if "at" in events.columns else events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.groupBy(F.window("at", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of `gap`."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


POINTER = "pointer.json"


def upsert_to(rows: DataFrame, table: str, key: str, order: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Keeps the row of greatest `order` of each key in a folder, in `parts` partitions by the key's hash; a batch rewrites those its keys are in. See `upserted` for reading.

    What a batch rewrites it writes as a new version beside the old; then a pointer file, which says the
    version of each partition, is put in place by one rename. A batch that dies before that has changed
    nothing, one that is run again finds its own rows and changes nothing. The versions that a batch
    replaces go when the next one has switched.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r[0] for r in own.select("_part").distinct().collect()]  # `parts` at most
        if not touched:
            return
        told = _pointed(spark, table)
        before = _read(spark, table, {p: v for p, v in told["now"].items() if int(p) in touched}, batch)
        both = own if before is None else before.unionByName(own)
        latest = both.groupBy("_part", key).agg(F.max(F.struct(F.col(order).alias("_o"), F.struct(*batch.columns).alias("_r")))["_r"].alias("r")).select("r.*", "_part")
        version = uuid.uuid4().hex
        latest.repartition("_part").write.partitionBy("_part").parquet(f"{table}/{version}")
        now = told["now"] | {str(p): version for p in touched}
        _point(spark, table, {"now": now, "before": {p: v for p, v in told["now"].items() if int(p) in touched}})
        for p, v in told["before"].items():
            if now.get(p) != v:
                _files(spark, f"{table}/{v}/_part={p}", lambda fs, place: fs.delete(place, True))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows that upsert_to keeps, by the pointer as it is now."""
    empty = spark.createDataFrame([], schema)
    found = _read(spark, table, _pointed(spark, table)["now"], empty)
    return empty if found is None else found.drop("_part")


def _files(spark: SparkSession, path: str, work: Callable):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return work(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)


def _pointed(spark: SparkSession, table: str) -> dict[str, dict[str, str]]:
    """Of each partition the version that counts, and the one that the last batch replaced."""
    if not _files(spark, f"{table}/{POINTER}", lambda fs, place: fs.exists(place)):
        return {"now": {}, "before": {}}
    return json.loads(spark.read.text(f"{table}/{POINTER}", wholetext=True).first()[0])


def _point(spark: SparkSession, table: str, told: dict) -> None:
    """Writes the pointer beside the old one and renames it, so that it is the old or the new one at any time."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def write(fs, place) -> None:
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
        out.close()
        overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(place, hadoop.Path(f"{table}/{POINTER}"), overwrite)

    _files(spark, f"{table}/{POINTER}.{uuid.uuid4().hex}", write)


def _read(spark: SparkSession, table: str, versions: dict[str, str], like: DataFrame) -> DataFrame | None:
    found = None
    for version in sorted(set(versions.values())):
        paths = [f"{table}/{version}/_part={p}" for p, v in versions.items() if v == version]
        rows = spark.read.schema(like.schema).parquet(*paths).withColumn("_part", F.regexp_extract(F.input_file_name(), "_part=([0-9]+)", 1).cast("int"))
        found = rows if found is None else found.unionByName(rows)
    return found
