"""Structured Streaming forms of identification and ingest.

Identification ranks over whole batches, so each micro-batch is one batch plan. Results are written below batch=N with
overwrite, so a replayed batch replaces its own rows and adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemark.config import FingerprintConfig, Limits, MatchConfig
from tracemark.functions.scalars import is_audio
from tracemark.operators.audio import accept_clips, find_audio_peaks
from tracemark.operators.hashing import generate_hashes
from tracemark.operators.matching import match_fingerprints
from tracemark.plans.library import Library
from tracemark.sources.files import FILE_SCHEMA


def identify_batch(clips: DataFrame, index: DataFrame, fp: FingerprintConfig = FingerprintConfig(), cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Clips (clip_id, sample_rate, samples) to matches with reject_reason; too short clips have one."""
    taken, rejected = accept_clips(clips)
    peaks = find_audio_peaks(taken, fp, key="clip_id")
    found = match_fingerprints(taken, generate_hashes(peaks, fp, key="clip_id"), index, cfg, fp)
    return found.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected.withColumnRenamed("reason", "reject_reason"), allowMissingColumns=True)


def identify_stream(clips: DataFrame, index: Callable[[], DataFrame], out: str, checkpoint: str, fp: FingerprintConfig = FingerprintConfig(),
                    cfg: MatchConfig = MatchConfig(), once: bool = True) -> StreamingQuery:
    """A stream of clips to rows of matches in Parquet. index is asked anew for each batch, so it may grow."""
    def each(df: DataFrame, batch_id: int) -> None:
        identify_batch(df, index(), fp, cfg).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = clips.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of new audio files below root; empty and too large ones are left out."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(root)
    return files.filter(is_audio(F.col("path")) & F.col("length").between(1, Limits.song_bytes))


def ingest_stream(files: DataFrame, library: Library, checkpoint: str, indexers=None, once: bool = True, remove_failed: bool = False) -> StreamingQuery:
    """New files to the library. Content hashes make a replayed batch do nothing. remove_failed deletes the
    stored uploads that could not be ingested, a list as long as the failures of one batch."""
    def each(df: DataFrame, batch_id: int) -> None:
        found = library.ingest(df.select("path", "content").withColumn("source", F.lit("upload")), indexers)
        if remove_failed:
            for row in found.filter("outcome = 'failed'").select("path").collect():
                fs, path = library.manifests.fs(row["path"])
                fs.delete(path, False)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
