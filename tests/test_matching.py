import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.functions import scalars as S
from tracemark.operators import matching as M
from tracemark.operators.hashing import check_bins, generate_hashes
from tracemark.operators.peaks import BLOCK


def test_config():
    assert FingerprintConfig().version() == "fc1931cb812b"
    assert FingerprintConfig().block_frames == 43
    for bad in (dict(n_fft=2048), dict(target_dt_max=300), dict(target_dt_min=0), dict(freq_bits=12, dt_bits=8), dict(peak_neighborhood_freq=14)):
        with pytest.raises(ValueError):
            FingerprintConfig(**bad)


def test_pack_unpack(spark):
    bins, steps = (0, 1, 2, 170, 255, 256, 341, 510, 511), (0, 1, 85, 128, 254, 255)
    want = [(a, b, c) for a in bins for b in bins for c in steps]
    df = spark.createDataFrame(want, "f1 int, f2 int, dt int").withColumn("h", S.pack_hash(F.col("f1"), F.col("f2"), F.col("dt")))
    assert df.agg(F.max("h"), F.min("h"), F.count_distinct("h")).first()[:] == (67_108_863, 0, len(want))
    assert rows(df.select(*S.unpack_hash(F.col("h")))) == sorted(want, key=str)


ZONE = [(1, 10, 40), (1, 11, 44), (1, 13, 30), (1, 13, 300), (1, 17, 61), (1, 19, 41), (1, 40, 40)]
ZONE_CFG = FingerprintConfig(fan_out=2, target_dt_max=8, target_df_max=25)


def test_target_zone(spark):
    # anchor, bins and steps, by hand: the third target is one too many, others are too far in bins or in time
    want = [(10, 40, 44, 1), (10, 40, 30, 3), (11, 44, 30, 2), (11, 44, 61, 6), (13, 30, 41, 6), (17, 61, 41, 2)]
    got = generate_hashes(spark.createDataFrame(ZONE, "song_id long, t int, f int"), ZONE_CFG)
    assert rows(got.select("anchor_time", "hash")) == sorted(((t, (a * 512 + b) * 256 + d) for t, a, b, d in want), key=str)


def test_hashes_move_with_time_and_blocks(spark):
    peaks = [(1, i * i % 487, i * 37 % 512) for i in range(180)]
    one = generate_hashes(spark.createDataFrame(peaks, "song_id long, t int, f int"))
    for shift in (BLOCK - 250, 3 * BLOCK + 5, -77):  # over the border of a block, and to negative times
        other = generate_hashes(spark.createDataFrame([(s, t + shift, f) for s, t, f in peaks], "song_id long, t int, f int"))
        assert rows(one.select("hash", F.col("anchor_time") + shift)) == rows(other.select("hash", "anchor_time"))
    assert generate_hashes(spark.createDataFrame([(1, 5, 10)], "song_id long, t int, f int")).isEmpty()


def test_hashes_against_a_loop(spark):
    rng = np.random.default_rng(5)
    peaks = [(int(s), int(t), int(f)) for s, t, f in zip(rng.integers(0, 3, 300), rng.integers(0, 9000, 300), rng.integers(0, 512, 300))]
    want = []
    for s, t, f in peaks:
        zone = sorted((u, g) for q, u, g in peaks if q == s and 1 <= u - t <= 63 and abs(g - f) <= 127)[:5]
        want += [(s, f << 17 | g << 8 | u - t, t) for u, g in zone]
    assert rows(generate_hashes(spark.createDataFrame(peaks, "song_id long, t int, f int"))) == sorted(want, key=str)


def test_bins_are_checked(spark):
    with pytest.raises(Exception, match="bin out of range"):
        check_bins(spark.createDataFrame([(1, 0, 512)], "song_id long, t int, f int")).collect()


def test_offsets_and_tolerance(spark):
    q = spark.createDataFrame([(3, 50, 2), (3, 50, 6), (3, 80, 1)], "clip_id long, hash int, anchor_time int")
    i = spark.createDataFrame([(50, 4, 11), (80, 5, 40), (70, 6, 1)], "hash int, song_id long, anchor_time int")
    assert rows(M.join_offsets(q, i)) == [(3, 4, 5), (3, 4, 9), (3, 5, 39)]
    assert rows(M.lookup(i, q)) == [(50, 4, 11), (80, 5, 40)]
    offsets = spark.createDataFrame([(2, 8, 40)] * 2 + [(2, 8, 41)] * 4 + [(2, 8, 43)] + [(2, 9, -6)] * 5, "clip_id long, song_id long, offset int")
    hist = M.offset_histogram(offsets)
    assert rows(M.rank_candidates(M.best_bins(M.tolerant_bins(hist, 1)))) == [(2, 8, 40, 6, 1), (2, 9, -6, 5, 2)]
    assert rows(M.rank_candidates(M.best_bins(M.tolerant_bins(hist, 0)))) == [(2, 8, 41, 4, 2), (2, 9, -6, 5, 1)]


def test_ties(spark):
    hist = spark.createDataFrame([(1, 5, 30, 4), (1, 5, 10, 4), (1, 3, 7, 4)], "clip_id long, song_id long, offset int, n long")
    assert rows(M.rank_candidates(M.best_bins(M.tolerant_bins(hist, 1)))) == [(1, 3, 7, 4, 1), (1, 5, 10, 4, 2)]


def test_confidence_and_decision(spark):
    from tracemark.config import MatchConfig

    df = spark.createDataFrame([(0, 0), (100, 0), (9, 9), (6, 2), (24, 2)], "b long, r long")
    c = [r[0] for r in df.select(S.confidence_score(F.col("b"), F.col("r"), MatchConfig(confidence_saturation=20))).collect()]
    assert c[:3] == [0, 1, 0] and 0 < c[3] < c[4]


def test_clips_without_hashes_get_a_row(spark):
    clips = spark.createDataFrame([(1,), (2,)], "clip_id long")
    q = spark.createDataFrame([(1, 7, 3)] * 6, "clip_id long, hash int, anchor_time int")
    i = spark.createDataFrame([(7, 4, 1), (7, 4, 1)], "hash int, song_id long, anchor_time int")
    got = {r["clip_id"]: r for r in M.match_fingerprints(clips, q, i).collect()}
    assert (got[2]["is_match"], got[2]["query_hashes"], got[2]["db_hits"], got[2]["candidates"], got[2]["confidence"]) == (False, 0, 0, [], 0.0)
    assert (got[1]["is_match"], got[1]["song_id"], got[1]["offset_frames"], got[1]["aligned_matches"], got[1]["query_hashes"], got[1]["db_hits"]) == (True, 4, -2, 12, 6, 2)
    songs = spark.createDataFrame([(4, "t", "a", None, 3.14159)], "id long, title string, artist string, album string, duration_s double")
    shown = {r["clip_id"]: r for r in M.enrich(M.match_fingerprints(clips, q, i), songs).collect()}
    assert shown[1]["match"] and shown[1]["offset_s"] == 0 and shown[1]["duration_s"] == 3.14 and not shown[2]["match"]
    assert not M.enrich(M.match_fingerprints(clips, q, i), songs.filter("id = 0")).filter("match").count()


def test_queries_and_entry_are_well_formed():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "identify_events" in q
    json.dumps(o)


def test_zone_that_is_full_and_batches_that_cut_blocks(monkeypatch):
    """Each anchor of a full grid has its first targets, from rows that come in small batches."""
    import pyarrow as pa

    from tracemark.operators import hashing as H

    cfg = FingerprintConfig(target_dt_max=6, target_df_max=4, fan_out=3)
    peaks = [(s, t, f) for s in ("a", None, "b") for t in range(-20, 120, 1 if s == "a" else 5) for f in range(0, 40, 3)] + [("a", 3, 6)] * 4
    monkeypatch.setattr(H, "AT_ONCE", 70)
    table = pa.table({"key": [p[0] for p in peaks], "t": pa.array([p[1] for p in peaks], pa.int32()), "f": pa.array([p[2] for p in peaks], pa.int32())})
    spread = pa.Table.from_batches(H._blocks(6)(iter(table.to_batches(max_chunksize=50)))).sort_by([("key", "ascending"), ("block", "ascending"), ("t", "ascending"), ("f", "ascending")])
    got = [(k, t, f, g, d) for b in H._pairs(cfg)(iter(spread.to_batches(max_chunksize=33))) for k, t, f, g, d, n in zip(*b.to_pydict().values()) for _ in range(n)]
    want = []
    for s, t, f in peaks:
        zone = sorted((u, g) for q, u, g in peaks if q == s and 1 <= u - t <= 6 and abs(g - f) <= 4)[:3]
        want += [(s, t, f, g, u - t) for u, g in zone]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_hash_of_a_third_of_all_rows_on_both_sides(spark):
    """The join spreads it: no task has more than five times the median of pairs, and the result is the plain one."""
    index = spark.range(15_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500 + 10).cast("int").alias("hash"), (F.col("id") % 40).alias("song_id"), (F.col("id") % 3000).cast("int").alias("anchor_time"))
    queries = spark.range(600).select((F.col("id") % 9).alias("clip_id"), F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") % 500 + 10).cast("int").alias("hash"), (F.col("id") % 50).cast("int").alias("anchor_time"))
    cells = M.join_cells(queries, index, cell_rows=300, cell_share=100, cell_pairs=8000)
    assert [(r["hash"], r["q_cells"] >= 1, r["i_cells"] > 15) for r in cells.collect()] == [(7, True, True)]
    want = rows(M.counted_offsets(queries, index))
    assert rows(M.counted_offsets(queries, index, cells)) == want and rows(M.offset_histogram(M.join_offsets(queries, index, cells)).select("clip_id", "song_id", "offset", "n")) == sorted((tuple(r[:4]) for r in map(tuple, M.counted_offsets(queries, index).collect())), key=str)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(saved, ("false", "8", "-1")):
            spark.conf.set(k, v)
        def tasks(cells):
            return sorted(r["n"] for r in M.join_offsets(queries, index, cells).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert tasks(cells)[-1] <= 5 * tasks(cells)[len(tasks(cells)) // 2] < tasks(None)[-1]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_no_frequent_hashes(spark):
    q, i = spark.createDataFrame([(1, 5, 0)], "clip_id long, hash int, anchor_time int"), spark.createDataFrame([], "hash int, song_id long, anchor_time int")
    assert M.join_cells(q, i) is None and M.counted_offsets(q, i).isEmpty()


def test_a_grid_of_clips_and_songs_gives_the_plain_candidates(spark, monkeypatch):
    """Repeats, null songs, ties, songs that are cut into parts, and clips that share a group; no pair of equal hashes is shuffled."""
    from tracemark.operators import meeting

    draw = np.random.default_rng(3)
    q = spark.createDataFrame([(int(c), int(h), int(t)) for c, h, t in zip(draw.integers(0, 9, 900), draw.integers(0, 40, 900), draw.integers(0, 12, 900))] + [(77, 999, 5)], "clip_id long, hash int, anchor_time int")
    i = spark.createDataFrame([(int(h), int(s) if s else None, int(t)) for h, s, t in zip(draw.integers(0, 50, 4000), draw.integers(0, 30, 4000), draw.integers(-30, 30, 4000))], "hash int, song_id long, anchor_time int")
    clips = spark.range(12).withColumnRenamed("id", "clip_id")
    want = rows(M.match_fingerprints(clips, q, i).withColumn("candidates", F.col("candidates").cast("string")))
    assert rows(M.match_fingerprints(clips, q, i, groups=2).withColumn("candidates", F.col("candidates").cast("string"))) == want
    assert rows(M.match_fingerprints(clips, q, i.limit(0), groups=2)) == rows(M.match_fingerprints(clips, q, i.limit(0)))
    # in one task, with small bounds: songs in parts, candidates that are kept again and again
    for name, n in (("PAIRS", 500), ("AT_ONCE", 150)):
        monkeypatch.setattr(meeting, name, n)
    import pyarrow as pa

    def packed(df, key):
        t = pa.table({"id": pa.array([r[key] for r in df], pa.int64()), "hash": pa.array([r["hash"] for r in df], pa.int32()), "t": pa.array([r["anchor_time"] for r in df], pa.int32())})
        return sorted((r for b in meeting._pack(iter(t.to_batches(max_chunksize=700))) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda r: (r[0] is not None, r[0] or 0))
    cell = [(0, 0, 0, *r) for r in packed(q.collect(), "clip_id")] + [(0, 0, 1, *r) for r in packed(i.collect(), "song_id")]
    table = pa.table({n: [r[k] for r in cell] for k, n in enumerate(("clips", "songs", "side", "id", "rows"))})
    got = [r for b in meeting._meet(5, 1)(iter(table.to_batches(max_chunksize=9))) for r in b.to_pylist() if r["aligned_matches"] is not None]
    for c in M.match_fingerprints(clips, q, i).collect():
        assert [tuple(x) for x in c["candidates"]] == [(r["song_id"], r["offset_frames"], r["aligned_matches"]) for r in got if r["clip_id"] == c["clip_id"]]


def test_a_group_of_clips_is_held_in_few_bytes(monkeypatch):
    import tracemalloc

    from tracemark.operators import meeting

    monkeypatch.setattr(meeting, "CHUNK", 1 << 14, raising=False)
    draw = np.random.default_rng(4)
    n_clips, n = 2_000, 300
    rows_ = [meeting.pack(np.sort(draw.integers(0, 1 << 18, n)), draw.integers(0, 300, n), np.ones(n, np.int64)) for _ in range(n_clips)]
    tracemalloc.start()
    held = meeting.Clips(list(range(n_clips)), rows_, 5, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held.sent.tolist() == [n] * n_clips and peak < 32 * n_clips * n


def test_held_clips_in_whole_numbers_and_in_columns(monkeypatch):
    """Few repeats, many repeats, and numbers of more than 63 bits, against all pairs."""
    from collections import Counter

    from tracemark.operators import meeting

    for chunk in (1 << 20, 3):
        monkeypatch.setattr(meeting, "CHUNK", chunk)
        for case, (hash_step, t_step, most) in {"whole": (1, 1, 2), "repeats": (1, 1, 9), "wide": (1 << 25, 1 << 25, 2)}.items():
            draw = np.random.default_rng(5)
            ids = [9, 7, 7, 1 << 40, -3]  # a clip comes in two parts

            def row(size):
                at = sorted({(int(h) * hash_step - hash_step, int(t) * t_step) for h, t in zip(draw.integers(0, 40, size), draw.integers(-9, 30, size))})
                return np.array([h for h, _ in at]), np.array([t for _, t in at]), draw.integers(1, most, len(at))
            clips, songs = [(c, row(60)) for c in ids], [(s, row(90)) for s in range(7)]
            held = meeting.Clips([c for c, _ in clips], [meeting.pack(*r) for _, r in clips], 3, 0)
            assert (held.whole is not None) == (case == "whole")
            held.meet(np.arange(7), np.repeat(np.arange(7), [len(r[0]) for _, r in songs]), *(np.concatenate([r[k] for _, r in songs]) for k in range(3)))
            got = [r for b in held.result(True) for r in b.to_pylist()]
            sent, hits, found = Counter(), Counter(), Counter()
            for c, (h, t, n) in clips:
                sent[c] += int(n.sum())
            for c in set(ids):
                asked = {int(h) for k, (hs, _, _) in clips if k == c for h in hs}
                hits[c] = sum(int(n) for _, r in songs for h, _, n in zip(*r) if int(h) in asked)
                for k, r in clips:
                    if k == c:
                        for h, t, n in zip(*r):
                            for s, (hs, ts, ns) in songs:
                                for m in np.flatnonzero(hs == h):
                                    found[c, s, int(ts[m] - t)] += int(n * ns[m])
            assert {r["clip_id"]: (r["sent"], r["hits"]) for r in got if r["song_id"] is None} == {c: (sent[c], hits[c]) for c in set(ids)}
            for c in set(ids):
                best = sorted((-max(n for (k, q, _), n in found.items() if (k, q) == (c, s)), s) for s in range(7) if any(k == c and q == s for k, q, _ in found))[:3]
                want = [(s, min(o for (k, q, o), n in found.items() if (k, q) == (c, s) and n == -worth), -worth) for worth, s in best]
                assert sorted(((r["song_id"], r["offset_frames"], r["aligned_matches"]) for r in got if r["clip_id"] == c and r["song_id"] is not None), key=lambda x: (-x[2], x[0])) == want
