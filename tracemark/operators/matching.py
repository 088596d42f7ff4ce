"""Identification of many clips at once: hash join, offset histogram, best bins, candidates and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig, MatchConfig
from tracemark.functions.scalars import confidence_score, frames_to_seconds, is_match, shown_offset
from tracemark.operators.meeting import best_songs


SKETCHED = 1000  # hashes of a side that the sketch names; each more frequent than one row in so many is among them
CELL_ROWS = 1 << 16  # rows of a hash in one cell, at least
CELL_SHARE = 200  # a hash with more than one row in so many of its side is spread over cells
CELL_PAIRS = 1 << 24  # pairs of a hash in one cell, at most


def lookup(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of the index whose hash is among the distinct ones of hashes."""
    return index.join(hashes.select("hash").distinct(), "hash", "left_semi")


def join_cells(queries: DataFrame, index: DataFrame, cell_rows: int = CELL_ROWS, cell_share: int = CELL_SHARE, cell_pairs: int = CELL_PAIRS) -> DataFrame | None:
    """(hash, q_cells, i_cells) of hashes that are too frequent for one task on either side; None if there are none.

    A mergeable sketch of frequent items names the candidates of each side, at most SKETCHED; those that it holds for frequent are
    counted exactly. Rows of a side are dealt over so many cells that none has more than its share, and more where the pairs in
    a cell would be too many. Both tables are read by their hashes alone, so written ones are cheap to ask.
    """
    sides = {"q": queries.select("hash"), "i": index.select("hash")}
    sketch = F.expr(f"approx_top_k(hash, {SKETCHED}, {10 * SKETCHED})").alias("top")
    found = reduce(DataFrame.unionByName, [df.agg(sketch, F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s)) for s, df in sides.items()]).collect()
    most = {r["side"]: max(cell_rows, r["n"] // cell_share) for r in found}
    likely = sorted({t["item"] for r in found for t in r["top"] or [] if 2 * t["count"] > most[r["side"]]})
    if not likely:
        return None
    counts = {s: dict(map(tuple, df.filter(F.col("hash").isin(likely)).groupBy("hash").count().collect())) for s, df in sides.items()}
    cells = []
    for h in likely:
        n = {s: counts[s].get(h, 0) for s in sides}
        q, i = (-(-n[s] // most[s]) for s in sides)
        i *= max(1, -(-n["q"] * n["i"] // (max(1, q * i) * cell_pairs)))
        if max(q, i) > 1 and min(q, i) > 0:
            cells.append((h, q, i))
    return queries.sparkSession.createDataFrame(cells, "hash int, q_cells int, i_cells int") if cells else None


def in_cells(rows: DataFrame, cells: DataFrame, own: str, other: str) -> DataFrame:
    """rows with (q_cell, i_cell): a row of a hash with cells lies in one of its own side's, and in all of the other side's."""
    known = rows.join(F.broadcast(cells), "hash", "left")
    place = F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c != "hash"]), F.col(f"{own}_cells")), F.lit(0).cast("long"))
    last = F.coalesce(F.col(f"{other}_cells") - 1, F.lit(0))
    return known.withColumn(f"{own}_cell", place).withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0), last))).withColumn(f"{other}_cell", F.col(f"{other}_cell").cast("long")).drop("q_cells", "i_cells")


def hash_pairs(queries: DataFrame, index: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """queries joined with index on the hash. With cells, rows of a hash that is frequent on both sides meet in a grid of
    tasks, each pair once, however many there are."""
    if cells is None:
        return queries.join(index, "hash")
    return in_cells(queries, cells, "q", "i").join(in_cells(index, cells, "i", "q"), ["hash", "q_cell", "i_cell"]).drop("q_cell", "i_cell")


def join_offsets(queries: DataFrame, index: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(clip_id, song_id, offset) of each pair of equal hashes, repeated hashes on both sides counted in full."""
    q = queries.select("clip_id", "hash", F.col("anchor_time").alias("q_t"))
    i = index.select("hash", "song_id", F.col("anchor_time").alias("db_t"))
    return hash_pairs(q, i, cells).select("clip_id", "song_id", (F.col("db_t") - F.col("q_t")).cast("int").alias("offset"))


def offset_histogram(offsets: DataFrame) -> DataFrame:
    """A1."""
    return offsets.groupBy("clip_id", "song_id", "offset").agg(F.count(F.lit(1)).alias("n"))


def counted_offsets(queries: DataFrame, index: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """J1, J2 and A1 in one pass over the index: the histogram of join_offsets, with hits, the index rows counted once for
    each hash of a clip whatever its repeats there. Summed over a clip, n are its pairs and hits its db_hits."""
    times = queries.groupBy("clip_id", "hash", F.col("anchor_time").alias("q_t")).agg(F.count(F.lit(1)).alias("times"))
    sent = times.withColumn("first", (F.col("q_t") == F.min("q_t").over(Window.partitionBy("clip_id", "hash"))).cast("long"))
    pairs = hash_pairs(sent, index.select("hash", "song_id", F.col("anchor_time").alias("db_t")), cells)
    return pairs.groupBy("clip_id", "song_id", (F.col("db_t") - F.col("q_t")).cast("int").alias("offset")).agg(F.sum("times").alias("n"), F.sum("first").alias("hits"))


def tolerant_bins(histogram: DataFrame, tolerance: int = 1) -> DataFrame:
    """E5: each bin with score, the sum of the bins within the tolerance."""
    near = Window.partitionBy("clip_id", "song_id").orderBy("offset").rangeBetween(-tolerance, tolerance)
    return histogram.withColumn("score", F.sum("n").over(near))


def best_bins(bins: DataFrame) -> DataFrame:
    """A2: the best bin of each clip and song; ties go to the smallest offset. A column hits of the bins is summed."""
    best = F.min_by(F.struct("offset", "score"), F.struct(-F.col("score"), F.col("offset")))
    sums = [F.sum("hits").alias("hits")] if "hits" in bins.columns else []
    return bins.groupBy("clip_id", "song_id").agg(best.alias("b"), *sums).select(
        "clip_id", "song_id", F.col("b.offset").alias("offset_frames"), F.col("b.score").alias("aligned_matches"), *(["hits"] if sums else []))


def rank_candidates(best: DataFrame, k: int = 5) -> DataFrame:
    """The k best songs of each clip with their rank; ties go to the smallest song id."""
    order = Window.partitionBy("clip_id").orderBy(F.col("aligned_matches").desc(), "song_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_stats(clips: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """A4: query_hashes (with repeats) and db_hits (index rows of the clip's distinct hashes) of all clips, 0 where none."""
    sent = queries.groupBy("clip_id").agg(F.count(F.lit(1)).alias("query_hashes"))
    # index rows are counted by hash first, so that the join has one row for each hash of a clip
    per_hash = lookup(index, queries).groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    hits = queries.select("clip_id", "hash").distinct().join(per_hash, "hash").groupBy("clip_id").agg(F.sum("rows").alias("db_hits"))
    return clips.select("clip_id").distinct().join(sent, "clip_id", "left").join(hits, "clip_id", "left").fillna(0, ["query_hashes", "db_hits"])


def _ranked_by_shuffle(queries: DataFrame, index: DataFrame, cfg: MatchConfig, cells: DataFrame | None) -> DataFrame:
    """The scores and candidates of each clip with hashes, by a shuffle of the pairs of equal hashes: for few clips."""
    bins = tolerant_bins(counted_offsets(queries, index, cells), cfg.offset_tolerance_frames)
    # the hits of a clip are summed beside the ranking: a second branch would read the index again
    songs = best_bins(bins).withColumn("db_hits", F.sum("hits").over(Window.partitionBy("clip_id")))
    ranked = rank_candidates(songs, max(2, cfg.top_candidates))
    top = F.struct("rank", "song_id", "offset_frames", "aligned_matches")
    per_clip = ranked.groupBy("clip_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("song_id"))).alias("best_song_id"),
        F.max(F.when(F.col("rank") == 1, F.col("offset_frames"))).alias("offset_frames"),
        F.max(F.when(F.col("rank") == 1, F.col("aligned_matches"))).alias("aligned_matches"),
        F.max(F.when(F.col("rank") == 2, F.col("aligned_matches"))).alias("runner_up_matches"), F.max("db_hits").alias("db_hits"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= cfg.top_candidates, top))).alias("c"))
    sent = queries.groupBy("clip_id").agg(F.count(F.lit(1)).alias("query_hashes"))
    return sent.join(per_clip, "clip_id", "left")


def match_fingerprints(clips: DataFrame, queries: DataFrame, index: DataFrame, cfg: MatchConfig = MatchConfig(),
                       fp: FingerprintConfig = FingerprintConfig(), cells: DataFrame | None = None, groups: int | None = None) -> DataFrame:
    """M5 (J1, J2, A1, E5, A2, E6, A3, A4, P4, P5): one row for each clip of clips, with or without hashes.

    queries: (clip_id, hash, anchor_time); index: (hash, song_id, anchor_time). Without candidates the scores are 0
    and nothing matches. Offsets may be negative. cells: what join_cells finds in written queries and index.
    groups: how many groups of clips meet the songs in a grid of tasks (meeting.clip_groups), for many clips and songs: then only candidates
    leave a task, and not the pairs of equal hashes, which grow with clips times songs.
    """
    names = "array<struct<song_id:bigint,offset_frames:int,aligned_matches:bigint>>"
    if groups is None:
        per_clip = _ranked_by_shuffle(queries, index, cfg, cells)
    else:
        found = best_songs(queries, index, groups, max(2, cfg.top_candidates), cfg.offset_tolerance_frames)
        per_clip = found.select(
            "clip_id", "query_hashes", "db_hits", F.get("best", F.lit(0))["song_id"].alias("best_song_id"), F.get("best", F.lit(0))["offset_frames"].alias("offset_frames"),
            (-F.get("best", F.lit(0))["worth"]).alias("aligned_matches"), (-F.get("best", F.lit(1))["worth"]).alias("runner_up_matches"),
            F.transform(F.slice("best", 1, cfg.top_candidates), lambda b: F.struct(b["song_id"].alias("song_id"), b["offset_frames"].alias("offset_frames"), (-b["worth"]).alias("aligned_matches"))).alias("c"))
    rows = clips.select("clip_id").distinct().join(per_clip, "clip_id", "left")
    rows = rows.fillna(0, ["query_hashes", "db_hits", "aligned_matches", "runner_up_matches"])
    rows = rows.withColumn("confidence", confidence_score(F.col("aligned_matches"), F.col("runner_up_matches"), cfg))
    matched = F.col("best_song_id").isNotNull() & is_match(F.col("aligned_matches"), F.col("confidence"), cfg)
    rows = rows.withColumns({"is_match": matched, "song_id": F.when(matched, F.col("best_song_id"))})
    candidates = F.transform("c", lambda c: F.struct(c["song_id"].alias("song_id"), c["offset_frames"].alias("offset_frames"), c["aligned_matches"].alias("aligned_matches")))
    return rows.select(
        "clip_id", "is_match", "song_id", "best_song_id", "offset_frames", frames_to_seconds(F.col("offset_frames"), fp).alias("offset_s"),
        "confidence", "aligned_matches", "runner_up_matches", "query_hashes", "db_hits", F.coalesce(candidates.cast(names), F.array().cast(names)).alias("candidates"))


def enrich(matches: DataFrame, songs: DataFrame) -> DataFrame:
    """Matches with the matched song's row; a match needs its song to be there still."""
    shown = songs.select(F.col("id").alias("song_id"), "title", "artist", "album", F.bround("duration_s", 2).alias("duration_s"))
    rows = matches.join(shown.withColumn("_there", F.lit(True)), "song_id", "left")
    found = F.col("is_match") & F.col("_there").isNotNull()
    return rows.withColumns({"match": found, "offset_s": shown_offset(F.col("offset_s")), "confidence": F.bround("confidence", 3)}).drop("_there")
