"""Evaluation: query sets, splits and guards, calibration and metrics over records of many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig, MatchConfig
from tracemark.functions.scalars import seeded_uniform, stem, track_id_from_path
from tracemark.operators.audio import slice_seconds
from tracemark.operators.quantiles import percentiles
from tracemark.scratch import with_rank

SWEEP = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)


def matched(aligned: Column, confidence: Column, best: Column, threshold: Column, min_aligned: int) -> Column:
    """F9."""
    return best.isNotNull() & (aligned >= min_aligned) & (confidence >= threshold)


def split_holdout(files: DataFrame) -> DataFrame:
    """Files (path, ...) with split, by turns calibration and test in the order of paths."""
    odd = F.col("_place") % 2 == 1
    return with_rank(files, ["path"], "_place").withColumn("split", F.when(odd, "calibration").otherwise("test")).drop("_place")


def guard_holdout(holdout: DataFrame, songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are not in the library, and one row with the number of those that are."""
    known = songs.select("content_hash").distinct()
    return holdout.join(known, "content_hash", "left_anti"), holdout.join(known, "content_hash", "left_semi").agg(F.count(F.lit(1)).alias("in_library"))


def exclude(holdout: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose track is not excluded, and the texts "stem: reason" of those that are."""
    named = holdout.withColumn("track_id", track_id_from_path(F.col("path")))
    out = named.join(exclusions, "track_id").select(F.concat(stem(F.col("path")), F.lit(": "), F.col("reason")).alias("excluded"))
    return named.join(exclusions, "track_id", "left_anti"), out


def query_grid(sources: DataFrame, clip_lengths: tuple[int, ...] = (5, 10), seed: int = 0) -> DataFrame:
    """Each source (song_id, duration_s, ...) with each clip length that leaves half a second, and a start
    drawn evenly from 0 to duration - length."""
    rows = sources.withColumn("clip_s", F.explode(F.array(*map(F.lit, clip_lengths)))).filter(F.col("duration_s") >= F.col("clip_s") + 0.5)
    return rows.withColumn("start_s", seeded_uniform(seed, F.col("song_id"), F.col("clip_s")) * (F.col("duration_s") - F.col("clip_s")))


def query_sources(positives: DataFrame, holdout: DataFrame) -> DataFrame:
    """(kind, split, song_id, path, duration_s) of library songs (song_id, duration_s), which are positive and all for
    tests, and of files outside of it (path, split, duration_s), negative ones for calibration and tests."""
    inside = positives.select(F.lit("positive").alias("kind"), F.lit("test").alias("split"), "song_id", F.lit(None).cast("string").alias("path"), "duration_s")
    outside = holdout.select(F.lit("negative").alias("kind"), "split", F.lit(None).cast("long").alias("song_id"), "path", "duration_s")
    return inside.unionByName(outside)


def cut_clips(queries: DataFrame) -> DataFrame:
    """Queries with samples cut to the clip."""
    return queries.withColumn("samples", slice_seconds(F.col("samples"), F.col("sample_rate"), F.col("start_s"), F.col("clip_s")))


def clip_lengths(records: DataFrame) -> DataFrame:
    """L6."""
    return records.select("clip_s").distinct().orderBy("clip_s")


def calibrate(records: DataFrame, min_aligned: int = MatchConfig().min_aligned_matches) -> DataFrame:
    """(threshold) the least of 0, 0.01 to 1 that no negative of the calibration split reaches, else 1. One pass."""
    eligible = F.col("best_song_id").isNotNull() & (F.col("aligned") >= min_aligned)
    top = records.filter((F.col("kind") == "negative") & (F.col("split") == "calibration") & eligible).agg(F.max("confidence").alias("top"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: F.round(i / 100.0, 2))
    free = F.filter(grid, lambda t: t > F.col("top"))
    return top.select(F.when(F.col("top").isNull(), 0.0).when(F.size(free) == 0, 1.0).otherwise(F.array_min(free)).alias("threshold"))


def judged(records: DataFrame, threshold: DataFrame, min_aligned: int = MatchConfig().min_aligned_matches) -> DataFrame:
    """records with threshold (a one-row table), is_match, correct and raw_correct."""
    rows = records.crossJoin(F.broadcast(threshold.limit(1)))
    hit = matched(F.col("aligned"), F.col("confidence"), F.col("best_song_id"), F.col("threshold"), min_aligned)
    raw = F.coalesce(F.col("best_song_id") == F.col("true_song_id"), F.lit(False))
    return rows.withColumns({"is_match": hit, "correct": hit & raw, "raw_correct": raw})


def accuracy(rows: DataFrame, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """By condition, one column for each clip length of the share of correct positives, and of raw ones."""
    positive = rows.filter(F.col("kind") == "positive").groupBy("condition").pivot("clip_s", list(lengths) if lengths else None)
    return positive.agg(F.avg(F.col("correct").cast("double")).alias("top1"), F.avg(F.col("raw_correct").cast("double")).alias("raw_top1"))


def false_positives(rows: DataFrame) -> DataFrame:
    """A10: (condition, clip_s, n, n_wrong, rate) of negatives of the test split; a null condition and length is all."""
    test = rows.filter((F.col("kind") == "negative") & (F.col("split") == "test"))
    return test.groupingSets([["condition", "clip_s"], []], "condition", "clip_s").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("is_match").cast("long")), F.lit(0)).alias("n_wrong")).withColumn(
        "rate", F.when(F.col("n") > 0, F.col("n_wrong") / F.col("n")))


def threshold_sweep(records: DataFrame, threshold: DataFrame, min_aligned: int = MatchConfig().min_aligned_matches, grid: tuple[float, ...] = SWEEP) -> DataFrame:
    """(t, chosen, accuracy, fpr) for the thresholds of the grid and the chosen one, over all records."""
    spark = records.sparkSession
    ts = spark.createDataFrame([(float(t),) for t in grid], "t double").unionByName(threshold.select(F.col("threshold").alias("t"))).distinct()
    ts = ts.crossJoin(threshold).select("t", (F.col("t") == F.col("threshold")).alias("chosen"))
    rows = records.crossJoin(F.broadcast(ts))
    hit = matched(F.col("aligned"), F.col("confidence"), F.col("best_song_id"), F.col("t"), min_aligned)
    good = F.coalesce(hit & (F.col("best_song_id") == F.col("true_song_id")), F.lit(False)).cast("double")
    return rows.groupBy("t", "chosen").agg(F.avg(F.when(F.col("kind") == "positive", good)).alias("accuracy"),
                                           F.avg(F.when(F.col("kind") == "negative", hit.cast("double"))).alias("fpr"))


def offset_error(rows: DataFrame) -> DataFrame:
    """Median, 95th percentile and share within 100 ms of the offset errors of correct positives."""
    err = rows.filter((F.col("kind") == "positive") & F.col("correct")).select(F.abs(F.col("offset_s") - F.col("true_start_s")).alias("e"))
    spread = percentiles(err, [], F.col("e"), {"median_s": 0.5, "p95_s": 0.95})
    rest = err.agg(F.avg((F.col("e") <= 0.1).cast("double")).alias("within_100ms"), F.count(F.lit(1)).alias("n"))
    return rest.join(spread, how="left").select("median_s", "p95_s", "within_100ms", "n")


def latency(records: DataFrame) -> DataFrame:
    """By clip length, mean and percentiles of the total time, means of its parts, of hashes and of rows hit."""
    total = F.col("t_fingerprint_ms") + F.col("t_lookup_ms") + F.col("t_score_ms")
    spread = percentiles(records, ["clip_s"], total, {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("clip_s", "_clip_s")
    means = records.groupBy("clip_s").agg(
        F.avg(total).alias("mean_ms"), *[F.avg(c).alias(c) for c in ("t_fingerprint_ms", "t_lookup_ms", "t_score_ms", "query_hashes", "db_hits")])
    return means.join(spread, F.col("clip_s").eqNullSafe(F.col("_clip_s")), "left").drop("_clip_s")


def index_size(index: DataFrame, songs: DataFrame) -> DataFrame:
    """A16."""
    return songs.agg(F.count(F.lit(1)).alias("songs")).crossJoin(index.agg(F.count(F.lit(1)).alias("rows"))).withColumn(
        "rows_per_song", F.col("rows") / F.greatest(F.lit(1), F.col("songs")))


def markdown_table(df: DataFrame, limit: int = 500) -> str:
    """A small metric table as Markdown; more than limit rows raise an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report table is small")
    def cell(x):
        return "n/a" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|---" * len(df.columns) + "|", *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_report(records: DataFrame, path: str, cfg: FingerprintConfig = FingerprintConfig()) -> str:
    """Records as JSON below path, and the report's text, which is also written as one text file."""
    threshold = calibrate(records)
    rows = judged(records, threshold)
    lengths = tuple(r["clip_s"] for r in clip_lengths(records).collect())
    parts = [("Top-1 accuracy", accuracy(rows, lengths).orderBy("condition")), ("False positives", false_positives(rows).orderBy("condition", "clip_s")),
             ("Threshold", threshold_sweep(records, threshold).orderBy("t")), ("Offset error", offset_error(rows)), ("Latency", latency(records).orderBy("clip_s"))]
    text = "\n\n".join([f"Configuration {cfg.version()}", *(f"### {name}\n\n{markdown_table(df)}" for name, df in parts)])
    records.write.mode("overwrite").json(f"{path}/records")
    records.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return text
