"""Peak picking on long grids (song_id, t, f, db): neighbourhood extremes, thresholds and the density cap.

Windows never gather a song: they run along one line of the grid, and lines over time are cut in blocks with a halo.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig, Limits
from tracemark.functions.scalars import bin_to_hz, frames_to_seconds

BLOCK = 4096  # ticks of a block of a line over time


def with_halo(df: DataFrame, before: int, after: int, size: int = BLOCK, t: str = "t") -> DataFrame:
    """df with block and own: every row in its block of `size` ticks, and again in each neighbouring block of which it
    is within `before` ticks of the start or `after` ticks of the end."""
    first, last = F.floor((F.col(t) - after) / size), F.floor((F.col(t) + before) / size)
    mine = F.floor(F.col(t) / size)
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", F.col("block") == mine)


def neighborhood(grid: DataFrame, half_f: int = 7, half_t: int = 7) -> DataFrame:
    """Grid with nb_max and nb_min over the box around each point, cut off at the grid's border.

    The grid is dense: a song has the same bins at each of its ticks. One axis is folded after the other.
    """
    across = Window.partitionBy("song_id", "t").orderBy("f").rangeBetween(-half_f, half_f)
    rows = grid.withColumns({"_hi": F.max("db").over(across), "_lo": F.min("db").over(across)})
    along = Window.partitionBy("song_id", "f", "block").orderBy("t").rangeBetween(-half_t, half_t)
    rows = with_halo(rows, half_t, half_t).withColumns({"nb_max": F.max("_hi").over(along), "nb_min": F.min("_lo").over(along)})
    return rows.filter("own").drop("_hi", "_lo", "block", "own")


def frequency_floor(db: Column, f: Column, cfg: FingerprintConfig) -> Column:
    """bins below the least frequency are minus infinity, and count as that in the neighbourhood's minimum."""
    least = math.ceil(cfg.min_freq_hz * cfg.n_fft / cfg.sample_rate)
    return F.when(f < least, F.lit(float("-inf"))).otherwise(db) if least > 0 else db


def is_peak(db: Column, nb_max: Column, nb_min: Column, loudest: Column, range_db: float) -> Column:
    """F5."""
    return (db == nb_max) & (db > nb_min) & (db >= loudest - range_db)


def density_cap(peaks: DataFrame, per_block: int = 15, block_frames: int = 43) -> DataFrame:
    """The per_block strongest of each block of frames; ties go to the lower bin, then the earlier frame."""
    order = Window.partitionBy("song_id", F.floor(F.col("t") / block_frames)).orderBy(F.col("amp").desc(), "f", "t")
    return peaks.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= per_block).drop("_nth")


def find_peaks(grid: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """M2 on a long grid: (song_id, t, f, amp). Songs whose loudest point is under the silence floor have no peaks."""
    floored = grid.select("song_id", "t", "f", frequency_floor(F.col("db"), F.col("f"), cfg).alias("db"))
    loudest = floored.groupBy("song_id").agg(F.max("db").alias("loudest")).filter(F.col("loudest") >= cfg.silence_floor_db)
    boxed = neighborhood(floored, cfg.peak_neighborhood_freq // 2, cfg.peak_neighborhood_time // 2)
    picked = boxed.filter((F.col("db") == F.col("nb_max")) & (F.col("db") > F.col("nb_min"))).join(loudest, "song_id")
    picked = picked.filter(is_peak(F.col("db"), F.col("nb_max"), F.col("nb_min"), F.col("loudest"), cfg.peak_dynamic_range_db))
    return density_cap(picked.select("song_id", "t", "f", F.col("db").alias("amp")), cfg.peaks_per_second, cfg.block_frames)


def local_maxima(ticks: DataFrame, floor: float = -90.0, lo_bin: int | None = None, hi_bin: int | None = None, top: int = 3) -> DataFrame:
    """Of (series, tick, bin, value) the top local maxima of each tick: values above floor and no less than both
    neighbouring rows by bin, inside lo_bin to hi_bin where given; ties go to the lower bin. The first and the last
    row of a tick have only one neighbour and are no maxima."""
    line = Window.partitionBy("series", "tick").orderBy("bin")
    rows = ticks.filter((F.lit(True) if lo_bin is None else F.col("bin") >= lo_bin) & (F.lit(True) if hi_bin is None else F.col("bin") < hi_bin))
    rows = rows.withColumns({"_l": F.lag("value").over(line), "_r": F.lead("value").over(line)})
    rows = rows.filter((F.col("value") > floor) & (F.col("value") >= F.col("_l")) & (F.col("value") >= F.col("_r")))
    best = Window.partitionBy("series", "tick").orderBy(F.col("value").desc(), "bin")
    return rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top).drop("_l", "_r")


def peak_density(peaks: DataFrame, block_frames: int = 43) -> DataFrame:
    """Peaks of each block of frames."""
    return peaks.groupBy("song_id", F.floor(F.col("t") / block_frames).alias("block")).agg(F.count(F.lit(1)).alias("n_peaks"))


def shown_peaks(peaks: DataFrame, cfg: FingerprintConfig = FingerprintConfig(), limit: int = Limits.shown_peaks) -> DataFrame:
    """(song_id, peaks) with every max(1, n // limit)-th peak by (t, f), in seconds and hertz."""
    order = Window.partitionBy("song_id").orderBy("t", "f")
    sizes = peaks.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    rows = peaks.join(sizes, "song_id").withColumn("nth", F.row_number().over(order) - 1)
    rows = rows.filter(F.pmod("nth", F.greatest(F.lit(1), F.floor(F.col("n") / limit))) == 0)
    point = F.struct("nth", F.bround(frames_to_seconds(F.col("t"), cfg), 3).alias("time_s"), F.bround(bin_to_hz(F.col("f"), cfg), 1).alias("freq_hz"))
    shown = rows.groupBy("song_id").agg(F.array_sort(F.collect_list(point)).alias("ps"))
    return shown.select("song_id", F.transform("ps", lambda p: F.struct(p["time_s"].alias("time_s"), p["freq_hz"].alias("freq_hz"))).alias("peaks"))
