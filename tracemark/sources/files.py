"""Files as tables: discovery, content hashes, PCM decoding, track metadata and exclusion lists."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.functions.scalars import is_audio, track_id_from_path
from tracemark.scratch import join_hot

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def discover(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Audio files below root by path, the first `limit` of them (0 or None: all). Contents are read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(is_audio(F.col("path")))
    return files.orderBy("path").limit(limit) if limit else files


def holdout_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """*.mp3 files below root by path, the first `limit` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp3").load(root)
    return files.orderBy("path").limit(limit) if limit else files


def with_content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """The SHA-256 of the bytes, by which files are told apart."""
    return files.withColumn("content_hash", F.sha2(F.col(content), 256))


def mark_first(files: DataFrame, key: str = "path") -> DataFrame:
    """Files with first, whether a file is the one of least key with its content_hash (rows that repeat a key are alike;
    null is a content too). A content may have most of the files: keys fold on the map side, and files stay where they are."""
    rows = files.withColumn("_content", F.coalesce("content_hash", F.lit("")))
    least = rows.groupBy("_content").agg(F.min(key).alias("_least"))
    return join_hot(rows, least, ["_content"]).withColumn("first", F.col(key).eqNullSafe(F.col("_least"))).drop("_content", "_least")


def load_tracks(spark: SparkSession, path: str) -> DataFrame:
    """S3: a CSV whose first two rows name the columns (group and field): (track_id, title, artist, album, genre,
    subset, duration_s). Rows whose first cell is not all digits are skipped, cells are trimmed, empty ones null; of
    repeated ids the last row of the file holds."""
    raw = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    groups, fields = raw.limit(2).collect()
    at = {(g, f): c for g, f, c in zip(groups, fields, raw.columns, strict=True)}

    def cell(group: str, field: str) -> Column:
        c = at.get((group, field))
        return F.lit(None).cast("string") if c is None else F.nullif(F.trim(F.col(c)), F.lit(""))

    first = F.col(raw.columns[0])
    rows = raw.withColumn("_line", F.monotonically_increasing_id()).filter(first.rlike("^[0-9]+$")).select(
        first.cast("long").alias("track_id"), "_line", F.struct(
            cell("track", "title").alias("title"), cell("artist", "name").alias("artist"), cell("album", "title").alias("album"),
            cell("track", "genre_top").alias("genre"), cell("set", "subset").alias("subset"), cell("track", "duration").try_cast("double").alias("duration_s")).alias("t"))
    return rows.groupBy("track_id").agg(F.max_by("t", "_line").alias("t")).select("track_id", "t.*")


def small_tracks(tracks: DataFrame) -> DataFrame:
    """F11."""
    return tracks.filter(F.col("subset") == "small")


def with_tracks(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files with their track's metadata where the path names one."""
    named = files.withColumn("track_id", track_id_from_path(F.col("path")))
    return named.join(tracks, "track_id", "left")


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of (track_id, library_id, reason); blank lines and those that begin with # are skipped."""
    shape = r"^\s*(\S+)\s+(\S+)\s+(.*)$"
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.regexp_extract("value", shape, 1).cast("long").alias("track_id"), F.regexp_extract("value", shape, 2).alias("library_id"),
                        F.regexp_extract("value", shape, 3).alias("reason"))


def not_present(wanted: DataFrame, present: DataFrame, key: str = "track_id") -> DataFrame:
    """What is wanted and not there."""
    return wanted.join(present.select(key), key, "left_anti")


def decode_wav(data: bytes, sample_rate: int) -> np.ndarray:
    """PCM of 8, 16, 24 or 32 bits or floats of 32 or 64 bits to mono float32 at sample_rate, from any rate.

    Channels are added with 1/sqrt(2) each.
    """
    kind, rate, channels, bits, body = _riff(data)
    width = bits // 8
    body = body[:len(body) // max(width, 1) * width]
    if kind in (1, 0xFFFE) and bits == 8:  # the only unsigned form
        x = (np.frombuffer(body, np.uint8) - 128.0) / 128.0
    elif kind in (1, 0xFFFE) and bits in (16, 24, 32):
        wide = np.zeros((len(body) // width, 4), np.uint8)
        wide[:, 4 - width:] = np.frombuffer(body, np.uint8).reshape(-1, width)
        x = wide.reshape(-1).view("<i4") / 2.0 ** 31
    elif kind == 3 and bits in (32, 64):
        x = np.frombuffer(body, f"<f{width}").astype(np.float64)
    else:
        raise ValueError(f"no PCM of 8 to 32 bits: format {kind}, {bits} bits")
    if not channels or not rate:
        raise ValueError("a WAV file without channels or rate")
    x = x[:len(x) // channels * channels].reshape(-1, channels)
    mono = resample(x[:, 0] if channels == 1 else x.sum(axis=1) / np.sqrt(2.0), rate, sample_rate)
    if not len(mono):
        raise ValueError("no audio in it")
    return mono.astype(np.float32)


def _riff(data: bytes) -> tuple[int, int, int, int, bytes]:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
        if name == b"fmt ":
            form = data[at + 8:at + 8 + size]
        elif name == b"data":
            body = data[at + 8:at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None or len(form) < 16:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate = (int.from_bytes(form[i:j], "little") for i, j in ((0, 2), (2, 4), (4, 8)))
    return kind, rate, channels, int.from_bytes(form[14:16], "little"), body


def resample(x: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """x at another rate, by a windowed sinc with `zeros` zero crossings on each side, below the lower of the half rates.

    The rates are in the ratio of whole numbers, so the output's samples fall into as many phases as the numerator, and
    all samples of a phase have the same taps.
    """
    if rate == to or not len(x):
        return x
    shared = math.gcd(rate, to)
    up, down = to // shared, rate // shared
    cut = min(1.0, up / down)
    half = math.ceil(zeros / cut)
    around = np.arange(-half, half + 1)
    padded = np.pad(x, half + 1)
    out = np.zeros(-(-len(x) * up // down))
    for phase in range(min(up, len(out))):
        places = np.arange(phase, len(out), up) * down
        at, part = places // up, (phase * down % up) / up
        away = (around - part) * cut
        taps = np.sinc(away) * np.where(abs(away) < zeros, np.cos(np.pi * away / (2 * zeros)) ** 2, 0.0)
        for some in np.array_split(np.arange(len(at)), -(-len(at) // 4096)):  # a bounded number of windows at once
            out[places[some] // down] = padded[at[some, np.newaxis] + around + half + 1] @ (taps / taps.sum())
    return out


def encode_wav(samples: np.ndarray, sample_rate: int) -> bytes:
    """16-bit mono or (frames x channels) PCM, for fixtures and exports."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(files: DataFrame, sample_rate: int = 11_025, key: str = "content_hash", content: str = "content") -> DataFrame:
    """(key, sample_rate, samples, error) of files; a file that cannot be decoded has an error and no samples."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            samples, errors = [], []
            for data in batch[content]:
                try:
                    samples.append(decode_wav(bytes(data or b""), sample_rate))
                    errors.append(None)
                except ValueError as e:
                    samples.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({key: batch[key], "sample_rate": sample_rate, "samples": samples, "error": errors})

    return files.select(key, content).mapInPandas(run, f"{key} string, sample_rate int, samples array<float>, error string")


