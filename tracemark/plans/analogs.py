"""The driver's tables seen as landmarks, clips, songs and evaluation records.

A user of events or a supplier of lineitem stands for a song, one of its rows for a peak at a whole hour or day; parts
stand for songs of a library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 300  # ticks of a clip
EVERY = 20  # the songs whose ids this divides are cut to clips, whole
NOISE_DROP = 3  # every third row of a noisy clip is lost


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_peaks(events: DataFrame) -> DataFrame:
    base = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 100).when(F.col("event_type") == "error", 200).when(F.col("event_type") == "signup", 300).otherwise(400)
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.select(F.col("event_id").alias("pid"), F.col("user_id").alias("song_id"), hours.cast("int").alias("t"),
                         (base + F.least(F.floor("value"), F.lit(99))).cast("int").alias("f"), F.col("value").alias("amp"))


def line_peaks(lineitem: DataFrame) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return lineitem.select(F.col("l_suppkey").alias("song_id"), days.cast("int").alias("t"), F.pmod("l_partkey", F.lit(512)).cast("int").alias("f"), F.col("l_extendedprice").alias("amp"))


def _clip_id(length: int):
    return (F.col("song_id") * 1000 + F.floor(F.col("t") / length) + 100).cast("long")


def clip_peaks(peaks: DataFrame, remainder: int = 0, length: int = LENGTH) -> DataFrame:
    """Clips: all peaks of every twentieth song in stretches of `length` ticks, with times from the clip's own start."""
    cut = peaks.filter(F.pmod("song_id", F.lit(EVERY)) == remainder)
    return cut.withColumns({"clip_id": _clip_id(length), "t": (F.col("t") - F.floor(F.col("t") / length) * length).cast("int")}).drop("song_id")


def clip_ids(peaks: DataFrame, remainder: int = 0, length: int = LENGTH) -> DataFrame:
    return peaks.filter(F.pmod("song_id", F.lit(EVERY)) == remainder).select(_clip_id(length).alias("clip_id")).distinct()


def part_songs(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("id"), F.lit("file").alias("source"), F.col("p_partkey").cast("string").alias("source_id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.col("p_type")).alias("album"),
        (F.col("p_size") * 10.0).alias("duration_s"), F.format_string("%03d/%06d.mp3", F.col("p_partkey").try_cast("int") / 1000, F.col("p_partkey")).alias("file_path"),
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("content_hash"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))


def line_records(lineitem: DataFrame) -> DataFrame:
    """Evaluation records: rows of lineitem with its quantities as aligned matches, and so on."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return lineitem.select(
        F.when(F.pmod(key, F.lit(2)) == 0, "positive").otherwise("negative").alias("kind"),
        F.when(F.pmod(key, F.lit(4)) == 1, "calibration").otherwise("test").alias("split"),
        F.col("l_returnflag").alias("condition"), F.when(F.col("l_linestatus") == "O", 5).otherwise(10).alias("clip_s"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.col("l_suppkey")).alias("true_song_id"), (F.col("l_quantity") * 0.1).alias("true_start_s"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.col("l_suppkey") + F.when(F.pmod(key, F.lit(6)) == 0, 1).otherwise(0)).alias("best_song_id"),
        F.col("l_quantity").cast("long").alias("aligned"), F.lit(1).cast("long").alias("runner_up"), (F.col("l_discount") * F.col("l_quantity") / 10.0).alias("confidence"),
        (F.col("l_quantity") * 0.1 + F.col("l_tax")).alias("offset_s"), F.col("l_partkey").alias("query_hashes"), F.col("l_orderkey").alias("db_hits"),
        (F.col("l_tax") * 100.0).alias("t_fingerprint_ms"), (F.col("l_discount") * 100.0).alias("t_lookup_ms"), F.lit(1.0).alias("t_score_ms"))
