"""Landmark hashes: each peak is paired with the first peaks of its target zone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.functions.scalars import pack_hash

ZONES = 8  # target zones in a block of time
AT_ONCE = 200_000  # rows that are paired at once, but for a block that has more


def generate_hashes(peaks: DataFrame, cfg: FingerprintConfig = FingerprintConfig(), key: str = "song_id") -> DataFrame:
    """M3 (J3, E4, P1): (key, hash, anchor_time) of peaks (key, t, f).

    An anchor's targets are the peaks of dt_min to dt_max frames later and at most df_max bins apart, the first
    fan_out by (t, f); repeated peaks each act as an anchor and as a target. Peaks without t or f are none.

    One shuffle goes by key and a block of a few zones, which also sees the dt_max frames after it, so that one long song is the
    work of many tasks. Repeated peaks are folded before it and after it. Then one pass over sorted rows pairs them: all
    anchors look one row ahead at a time, and leave when they have their targets or their zone ends, so that no zone is held.
    """
    kind = peaks.schema[key].dataType.simpleString()
    rows = peaks.select(F.col(key).alias("key"), F.col("t").cast("int").alias("t"), F.col("f").cast("int").alias("f")).dropna(subset=["t", "f"])
    spread = rows.mapInArrow(_blocks(cfg.target_dt_max), f"key {kind}, block long, t int, f int, n long")
    ordered = spread.repartition("key", "block").sortWithinPartitions("key", "block", "t", "f")
    pairs = ordered.mapInArrow(_pairs(cfg), f"key {kind}, anchor_time int, f1 int, f2 int, dt int, n long")
    packed = pack_hash(F.col("f1"), F.col("f2"), F.col("dt"), cfg)
    return pairs.select(F.col("key").alias(key), packed.alias("hash"), "anchor_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_")).drop("_")


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each different value of a column, null among them."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def _folded(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first row of each run of equal rows, sums of n over the run) of sorted rows."""
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return first, np.add.reduceat(n, first) if len(n) else n


def _blocks(ahead: int):
    """Peaks with their numbers, in their block and in the one before if they are within `ahead` frames of its end."""
    size = ZONES * ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, t, f = _codes(batch.column(0)), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            order = np.lexsort((f, t, key))
            first, n = _folded([key[order], t[order], f[order]], np.ones(len(order), np.int64))
            at = order[first]
            own = t[at] // size
            again = np.flatnonzero((t[at] - ahead) // size < own)
            place = np.concatenate([at, at[again]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(np.concatenate([own, own[again] - 1])), pa.array(t[place].astype(np.int32)),
                                              pa.array(f[place]), pa.array(np.concatenate([n, n[again]]))], ["key", "block", "t", "f", "n"])
    return run


def paired(group: np.ndarray, own: np.ndarray, t: np.ndarray, f: np.ndarray, n: np.ndarray, cfg: FingerprintConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, target, times) as places in rows sorted by group, t and f, which are n peaks each; own ones are anchors."""
    base, width = t.min(initial=0), int(t.max(initial=0) - t.min(initial=0)) + cfg.target_dt_max + 2
    when = group * width + (t - base)
    anchor = np.flatnonzero(own)
    ahead = np.searchsorted(when, when[anchor] + cfg.target_dt_min)
    end = np.searchsorted(when, when[anchor] + cfg.target_dt_max, "right")
    left = np.full(len(anchor), cfg.fan_out, np.int64)
    found: list = []
    while True:
        still = (ahead < end) & (left > 0)
        anchor, ahead, end, left = anchor[still], ahead[still], end[still], left[still]
        if not len(anchor):
            break
        near = np.abs(f[ahead] - f[anchor]) <= cfg.target_df_max
        times = np.minimum(n[ahead[near]], left[near])
        found.append((anchor[near], ahead[near], times))
        left[near] -= times
        ahead = ahead + 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    anchor, target, times = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(anchor, kind="stable")  # a key's rows stay together
    return anchor[order], target[order], times[order]


def _pairs(cfg: FingerprintConfig):
    size = ZONES * cfg.target_dt_max

    def pair(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, block, t, f = _codes(rows.column(0)), rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy().astype(np.int64)
        at, n = _folded([key, block, t, f], rows.column(4).to_numpy())
        key, block, t, f = key[at], block[at], t[at], f[at]
        group = np.zeros(len(at), np.int64)
        group[1:] = np.cumsum((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        a, z, times = paired(group, t // size == block, t, f, n, cfg)
        columns = [t[a], f[a], f[z], t[z] - t[a]]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at[a])), *(pa.array(c.astype(np.int32)) for c in columns), pa.array(times * n[a])],
                                          ["key", "anchor_time", "f1", "f2", "dt", "n"])

    def whole(table: pa.Table) -> pa.RecordBatch:
        return pair(table.combine_chunks().to_batches()[0]) if len(table) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= AT_ONCE:
                table = pa.Table.from_batches(held)
                key, block = _codes(table.column(0).combine_chunks()), table.column(1).to_numpy()
                new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
                if len(new):  # the last block may go on in the next batch
                    yield whole(table.slice(0, int(new[-1])))
                    rest = table.slice(int(new[-1])).combine_chunks()
                    held, size = rest.to_batches(), len(rest)
        if size:
            yield whole(pa.Table.from_batches(held))
    return run


def check_bins(peaks: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """peaks, with an error at run time for a bin that would not fit in a hash."""
    held = cfg.layout.values("f1")
    ok = F.col("f").between(held[0], held[-1])
    return peaks.withColumn("f", F.when(ok, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("bin out of range: "), F.col("f").cast("string"))).cast("int")))
