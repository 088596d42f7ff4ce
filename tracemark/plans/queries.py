"""The registered queries of the library, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.functions import scalars as S
from tracemark.operators import audio, evaluation, hashing, library, matching, meeting, peaks
from tracemark.plans import analogs as A
from tracemark.plans.library import latest_status, outcome_counts, plan_stale
from tracemark.scratch import materialise
from tracemark.sources.files import mark_first, with_content_hash

SMALL = FingerprintConfig(n_fft=16, hop_length=8)


def _events(spark, d):
    return A.event_peaks(A.table(spark, d, "events"))


def _lines(spark, d):
    return A.line_peaks(A.table(spark, d, "lineitem"))


def _songs(spark, d):
    return A.part_songs(A.table(spark, d, "part"))


def _clip_hashes(rows: DataFrame, remainder: int = 0) -> DataFrame:
    return hashing.generate_hashes(A.clip_peaks(rows, remainder), key="clip_id")


def _match(clips: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """The clips' hashes are written once, and counted; both sides then meet in a grid of tasks."""
    queries = materialise(queries, "queries")
    found = matching.match_fingerprints(clips, queries, index, groups=meeting.clip_groups(queries.count()))
    return found.select("clip_id", "is_match", "song_id", "best_song_id", "offset_frames", F.round("offset_s", 6).alias("offset_s"), F.round("confidence", 6).alias("confidence"),
                        "aligned_matches", "runner_up_matches", "query_hashes", "db_hits", F.size("candidates").cast("long").alias("n_candidates"))


def identify_events(spark: SparkSession, d: str) -> DataFrame:
    """M5: clips of every twentieth user, in all stretches, against the index of all users."""
    rows = _events(spark, d)
    return _match(A.clip_ids(rows), _clip_hashes(rows), hashing.generate_hashes(rows))


def identify_lineitem(spark, d):
    rows = _lines(spark, d)
    return _match(A.clip_ids(rows), _clip_hashes(rows), hashing.generate_hashes(rows))


def identify_noisy(spark, d):
    """Clips that lost every third event."""
    rows = _events(spark, d)
    lossy = rows.filter(F.pmod("pid", F.lit(A.NOISE_DROP)) != 0)
    return _match(A.clip_ids(rows), _clip_hashes(lossy), hashing.generate_hashes(rows))


def identify_unknown(spark, d):
    """Clips of users that are not in the index."""
    rows = _events(spark, d)
    return _match(A.clip_ids(rows, 3), _clip_hashes(rows, 3), hashing.generate_hashes(rows.filter(F.pmod("song_id", F.lit(A.EVERY)) != 3)))


def landmark_hashes(spark, d):
    return hashing.generate_hashes(_lines(spark, d))


def pack_unpack(spark, d):
    h = hashing.generate_hashes(_events(spark, d)).select("hash").distinct()
    f1, f2, dt = S.unpack_hash(F.col("hash"))
    return h.select("hash", f1.alias("f1"), f2.alias("f2"), dt.alias("dt"), S.pack_hash(f1, f2, dt).alias("packed"))


def index_lookup(spark, d):
    rows = _events(spark, d)
    return matching.lookup(hashing.generate_hashes(rows), _clip_hashes(rows)).select("hash", "song_id", "anchor_time")


def offset_join(spark, d):
    rows = _events(spark, d)
    return matching.join_offsets(_clip_hashes(rows), hashing.generate_hashes(rows))


def _histogram(spark, d):
    return matching.offset_histogram(offset_join(spark, d))


def tolerant_bins(spark, d):
    return matching.tolerant_bins(_histogram(spark, d))


def best_bins(spark, d):
    return matching.best_bins(tolerant_bins(spark, d))


def top_candidates(spark, d):
    return matching.rank_candidates(best_bins(spark, d))


def query_stats(spark, d):
    rows = _events(spark, d)
    return matching.query_stats(A.clip_ids(rows), _clip_hashes(rows), hashing.generate_hashes(rows))


def matches_enriched(spark, d):
    songs = A.part_songs(A.table(spark, d, "part"))
    rows = matching.enrich(identify_events(spark, d), songs)
    return rows.select("clip_id", "match", "song_id", "title", "artist", "album", "duration_s", "offset_s", "confidence")


def _grid(spark, d):
    """A dense grid: the sums of prices by supplier, fifth part of a year and bin, 0 where there are none."""
    rows = _lines(spark, d).groupBy("song_id", F.floor(F.col("t") / 73).cast("int").alias("t"), F.pmod("f", F.lit(32)).alias("f"))
    sums = rows.agg(F.sum(F.round(F.col("amp") * 100).cast("long")).alias("cents"))
    spans = sums.groupBy("song_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cells = spans.select("song_id", F.explode(F.sequence("lo", "hi")).alias("t")).select("song_id", "t", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("f"))
    return cells.join(sums, ["song_id", "t", "f"], "left").select("song_id", "t", "f", (F.coalesce("cents", F.lit(0)) / 100000.0).cast("double").alias("db"))


def neighborhood_max(spark, d):
    return peaks.neighborhood(_grid(spark, d))


def grid_peaks(spark, d):
    return peaks.find_peaks(_grid(spark, d))


def sparse_peaks(spark, d):
    return peaks.density_cap(_events(spark, d).select("song_id", "t", "f", "amp").groupBy("song_id", "t", "f").agg(F.max("amp").alias("amp")), 5)


def peak_density(spark, d):
    return peaks.peak_density(_events(spark, d))


def shown_peaks(spark, d):
    rows = peaks.shown_peaks(_events(spark, d).select("song_id", "t", "f").distinct(), limit=20)
    return rows.select("song_id", F.explode("peaks").alias("p")).select("song_id", "p.time_s", "p.freq_hz")


def local_maxima(spark, d):
    rows = A.table(spark, d, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("tick"), F.posexplode("embedding").alias("bin", "value"))
    return peaks.local_maxima(rows).select("series", "tick", "bin", F.round(F.col("value").cast("double"), 6).alias("value"), "nth")


def library_search(spark, d):
    return library.list_songs(_songs(spark, d), "Brand#1", "album", True, 50, 20).select("id", "title", "artist", "album")


def library_pages(spark, d):
    return library.public_songs(library.list_songs(_songs(spark, d), "ring", "title", False, 60, 0)).drop("created_at")


def library_count(spark, d):
    return library.count_songs(_songs(spark, d), "Widget")


def point_lookup(spark, d):
    songs = _songs(spark, d)
    wanted = library.by_id(songs, 7).select("id", "title", F.lit("id").alias("by"))
    return wanted.unionByName(library.by_content_hash(songs, "4e07408562bedb8b60ce05c1decfe3ad16b72230967de01f640b7e4729b49fce").select("id", "title", F.lit("content").alias("by")))


def multi_get(spark, d):
    ids = A.table(spark, d, "lineitem").filter("l_quantity >= 49").select((F.col("l_partkey") * 2).alias("id"))
    return library.get_songs(_songs(spark, d), ids).select("id", "title", "artist")


def random_song(spark, d):
    return library.random_song(_songs(spark, d), 1).select("id", "title")


def sample_songs(spark, d):
    return library.sample_songs(_songs(spark, d), 50, 3).select("id", "title")


def song_labels(spark, d):
    c = A.table(spark, d, "customer")
    shown = F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return c.select("c_custkey", S.title_label(shown).alias("title"), S.artist_label(F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment"))).alias("artist"),
                    S.human_bytes(F.pow(F.lit(10.0), F.pmod("c_custkey", F.lit(12)).cast("double"))).alias("bytes"),
                    S.source_tag(F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_custkey")), F.pmod("c_custkey", F.lit(9)) == 0).alias("source"),
                    S.track_path(F.col("c_custkey")).alias("track_path"), S.track_id_from_path(S.track_path(F.col("c_custkey"))).alias("track_id"),
                    S.title_or_stem(F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit("")).otherwise(F.col("c_name")), F.concat(F.lit("/a.b/"), F.col("c_name"), F.lit(".v1.mp3"))).alias("stem"))


def time_labels(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", S.position_label(F.col("value")).alias("label"), S.position_label(-F.col("value")).alias("negative"))


def confidence_labels(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("best"), (F.pmod("l_partkey", F.lit(50))).alias("ru"))
    c = F.round(S.confidence_score(F.col("best"), F.col("ru")), 6)
    return rows.select("l_orderkey", "l_linenumber", "best", c.alias("confidence"), S.confidence_label(c).alias("label"), S.is_match(F.col("best"), c).alias("is_match"))


def content_dedupe(spark, d):
    """Documents as files; the first of each content stays, in the order of paths."""
    docs = with_content_hash(A.table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "content_hash")
    marked = mark_first(docs, "doc_id")
    return marked.select("doc_id", "content_hash", F.when(F.col("first"), "ingested").otherwise("skipped").alias("outcome"))


def _plan_inputs(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    files = docs.select("content_hash").distinct()
    songs = docs.filter(F.pmod("doc_id", F.lit(4)) != 0).groupBy("content_hash").agg(F.min("doc_id").alias("id"))
    labels = A.table(spark, d, "labels")
    marks = songs.select(F.col("id").alias("song_id")).join(labels.select(F.col("doc_id").alias("song_id"), "quality").distinct(), "song_id").select(
        "song_id", F.lit("fingerprint").alias("index_name"), F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("version"))
    return files, songs, marks


def plan_stale_items(spark, d):
    files, songs, marks = _plan_inputs(spark, d)
    wanted = spark.createDataFrame([("fingerprint", "v2"), ("rms", "v1")], "index_name string, version string")
    return plan_stale(files, songs, marks, wanted)


def outcomes(spark, d):
    return outcome_counts(content_dedupe(spark, d))


def status_latest(spark, d):
    """Orders as markers of customers' indexes."""
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("song_id"), F.col("o_orderpriority").alias("index_name"), F.col("o_orderstatus").alias("version"),
                                           F.col("o_orderkey").alias("item_count"), F.col("o_orderdate").alias("indexed_at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("batch_id"))
    return latest_status(o).select("song_id", "index_name", "version", "item_count", "batch_id")


def cascade_delete(spark, d):
    songs = A.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("song_id"), "l_orderkey", "l_linenumber")
    return library.cascade(rows, songs).groupBy("song_id").agg(F.count(F.lit(1)).alias("n_rows"))


def index_stats(spark, d):
    songs = A.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return evaluation.index_size(hashing.generate_hashes(_events(spark, d)), songs).withColumn("rows_per_song", F.round("rows_per_song", 6))


def item_counts(spark, d):
    """Rows of every song's index, 0 where there are none: customers are the songs, and not all of them are users."""
    counts = hashing.generate_hashes(_events(spark, d)).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("song_id")).join(counts, "song_id", "left").select("song_id", F.coalesce("n", F.lit(0)).alias("item_count"))


def round_robin(spark, d):
    return library.round_robin(A.table(spark, d, "part"), "p_brand", "p_partkey", 7).select("p_partkey", "genre", "turn", "place")


def genre_counts(spark, d):
    """A19."""
    return library.genre_counts(_songs(spark, d), "album")


def _holdout(spark, d):
    docs = A.table(spark, d, "documents").select(F.format_string("%06d.mp3", F.col("doc_id")).alias("path"), "doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    return evaluation.split_holdout(docs)


def calib_split(spark, d):
    return _holdout(spark, d).select("doc_id", "split")


def holdout_guard(spark, d):
    known = A.table(spark, d, "documents").filter("lang = 'de'").select(F.sha2(F.col("text"), 256).alias("content_hash"))
    rest, _ = evaluation.guard_holdout(_holdout(spark, d), known)
    toxic = A.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("track_id"), F.lit("audited").alias("reason")).distinct()
    kept, _ = evaluation.exclude(rest, toxic)
    return kept.select("doc_id", "split", "track_id")


def query_grid(spark, d):
    sources = _songs(spark, d).select(F.col("id").alias("song_id"), (F.col("duration_s") / 20).alias("duration_s"))
    return evaluation.query_grid(sources).select("song_id", "clip_s", F.round("start_s", 6).alias("start_s"))


def _records(spark, d):
    return A.line_records(A.table(spark, d, "lineitem"))


def _judged(spark, d):
    rows = _records(spark, d)
    return evaluation.judged(rows, evaluation.calibrate(rows))


def accuracy_pivot(spark, d):
    rows = evaluation.accuracy(_judged(spark, d), (5, 10))
    return rows.select("condition", *[F.round(F.col(f"{n}_{m}"), 6).alias(f"{m}_{n}s") for n in (5, 10) for m in ("top1", "raw_top1")])


def false_positive_rate(spark, d):
    return evaluation.false_positives(_judged(spark, d)).select("condition", "clip_s", "n", "n_wrong", F.round("rate", 6).alias("rate"))


def calibrate(spark, d):
    return evaluation.calibrate(_records(spark, d))


def threshold_sweep(spark, d):
    rows = _records(spark, d)
    return evaluation.threshold_sweep(rows, evaluation.calibrate(rows)).select("t", "chosen", F.round("accuracy", 6).alias("accuracy"), F.round("fpr", 6).alias("fpr"))


def offset_error(spark, d):
    rows = evaluation.judged(_records(spark, d), spark.range(1).select(F.lit(0.25).alias("threshold")))
    return evaluation.offset_error(rows).select(*[F.round(c, 6).alias(c) for c in ("median_s", "p95_s", "within_100ms")], "n")


def latency_percentiles(spark, d):
    rows = evaluation.latency(_records(spark, d))
    return rows.select("clip_s", *[F.round(c, 4).alias(c) for c in rows.columns if c != "clip_s"])


def framing(spark, d):
    rows = audio.frames(A.table(spark, d, "embeddings"), "vec_id", "embedding", 16, 8)
    return rows.select("vec_id", "t", F.round(F.get("frame", F.lit(0)), 6).alias("first"), F.round(F.get("frame", F.lit(15)), 6).alias("last"))


def frame_rms(spark, d):
    rows = audio.frames(A.table(spark, d, "embeddings"), "vec_id", "embedding", 16, 8)
    return rows.select("vec_id", "t", F.round(audio.rms(F.col("frame")), 5).alias("rms"))


def spectrogram(spark, d):
    """M1 on vectors as 64 samples, frames of 16."""
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("embedding").alias("samples"))
    return audio.spectrogram(rows, SMALL).select("song_id", "t", "f", F.round(F.pow(F.lit(10.0), F.col("db").cast("double") / 20), 4).alias("magnitude"))


def audio_fingerprints(spark, d):
    """M4 on vectors as samples: fused spectrogram, peaks and hashes. Samples are floats: a float times an integer is a double here."""
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.transform("embedding", lambda x: (x * 100).cast("float")).alias("samples"))
    return audio.fingerprint(rows, FingerprintConfig(n_fft=16, hop_length=2, peak_neighborhood_freq=3, peak_neighborhood_time=3))


# ---- SQL ----

EVENT_SQL = """SELECT event_id AS pid, user_id AS song_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS t,
 CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 100 WHEN 'error' THEN 200 WHEN 'signup' THEN 300 ELSE 400 END + least(floor(value), 99) AS INTEGER) AS f, value AS amp FROM events"""
LINE_SQL = """SELECT row_number() OVER () AS pid, l_suppkey AS song_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS t,
 CAST(l_partkey % 512 AS INTEGER) AS f, l_extendedprice AS amp FROM lineitem"""
SONG_SQL = """SELECT p_partkey AS id, 'file' AS source, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS album,
 p_size * 10.0::DOUBLE AS duration_s, sha256(CAST(p_partkey AS VARCHAR)) AS content_hash FROM part"""
RECORD_SQL = """SELECT CASE WHEN k % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind, CASE WHEN k % 4 = 1 THEN 'calibration' ELSE 'test' END AS split, l_returnflag AS condition,
 CASE WHEN l_linestatus = 'O' THEN 5 ELSE 10 END AS clip_s, CASE WHEN k % 2 = 0 THEN l_suppkey END AS true_song_id, l_quantity * 0.1::DOUBLE AS true_start_s,
 CASE WHEN k % 11 <> 0 THEN l_suppkey + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END END AS best_song_id, CAST(l_quantity AS BIGINT) AS aligned, l_discount * l_quantity / 10.0::DOUBLE AS confidence,
 l_quantity * 0.1::DOUBLE + l_tax AS offset_s, l_partkey AS query_hashes, l_orderkey AS db_hits, l_tax * 100.0::DOUBLE AS t_fingerprint_ms, l_discount * 100.0::DOUBLE AS t_lookup_ms, 1.0::DOUBLE AS t_score_ms
 FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)"""


def _hash_sql(source: str, key: str = "song_id") -> str:
    return f"""SELECT {key}, CAST((f1 << 17) | (f2 << 8) | dt AS INTEGER) AS hash, t1 AS anchor_time FROM (
 SELECT a.{key}, a.t AS t1, a.f AS f1, b.f AS f2, b.t - a.t AS dt, row_number() OVER (PARTITION BY a.pid ORDER BY b.t, b.f) AS nth
 FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND b.t - a.t BETWEEN 1 AND 63 AND abs(b.f - a.f) <= 127) WHERE nth <= 5"""


CLIP_ID = f"CAST(song_id * 1000 + floor(t / {A.LENGTH}.0) + 100 AS BIGINT)"


def _match_ctes(rows: str, remainder: int = 0, query_filter: str = "true", index_filter: str = "true") -> str:
    return f"""WITH p AS ({rows}), ip AS (SELECT * FROM p WHERE {index_filter}), c AS (SELECT pid, {CLIP_ID} AS clip_id, CAST(t - floor(t / {A.LENGTH}.0) * {A.LENGTH} AS INTEGER) AS t, f FROM p
   WHERE song_id % {A.EVERY} = {remainder} AND {query_filter}),
 i AS ({_hash_sql('ip')}), q AS ({_hash_sql('c', 'clip_id')}),
 o AS (SELECT q.clip_id, i.song_id, CAST(i.anchor_time - q.anchor_time AS INTEGER) AS "offset" FROM q JOIN i ON q.hash = i.hash),
 h AS (SELECT clip_id, song_id, "offset", CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL),
 s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY clip_id, song_id ORDER BY "offset" RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS score FROM h),
 b AS (SELECT clip_id, song_id, "offset" AS offset_frames, score AS aligned_matches FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, song_id ORDER BY score DESC, "offset") AS r FROM s) WHERE r = 1),
 k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY aligned_matches DESC, song_id) AS INTEGER) AS rank FROM b) WHERE rank <= 5),
 st AS (SELECT p.clip_id, coalesce(a.n, 0) AS query_hashes, coalesce(z.n, 0) AS db_hits FROM (SELECT DISTINCT {CLIP_ID} AS clip_id FROM p WHERE song_id % {A.EVERY} = {remainder}) p
   LEFT JOIN (SELECT clip_id, count(*) AS n FROM q GROUP BY 1) a ON a.clip_id = p.clip_id
   LEFT JOIN (SELECT d.clip_id, count(*) AS n FROM (SELECT DISTINCT clip_id, hash FROM q) d JOIN i ON i.hash = d.hash GROUP BY 1) z ON z.clip_id = p.clip_id),
 m AS (SELECT st.clip_id, st.query_hashes, st.db_hits, x.song_id AS best_song_id, x.offset_frames, coalesce(x.aligned_matches, 0) AS best, coalesce(y.aligned_matches, 0) AS ru,
   (SELECT count(*) FROM k WHERE k.clip_id = st.clip_id) AS n_candidates FROM st LEFT JOIN k x ON x.clip_id = st.clip_id AND x.rank = 1 LEFT JOIN k y ON y.clip_id = st.clip_id AND y.rank = 2),
 mc AS (SELECT *, CASE WHEN best <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ru::DOUBLE / best) * least(1.0::DOUBLE, best / 25.0::DOUBLE) END AS conf FROM m)"""


MATCH_SELECT = """ SELECT clip_id, best_song_id IS NOT NULL AND best >= 5 AND conf >= 0.25 AS is_match, CASE WHEN best >= 5 AND conf >= 0.25 THEN best_song_id END AS song_id, best_song_id, offset_frames,
 round(offset_frames * 256.0::DOUBLE / 11025.0::DOUBLE, 6) AS offset_s, round(conf, 6) AS confidence, best AS aligned_matches, ru AS runner_up_matches, query_hashes, db_hits, n_candidates FROM mc"""
EVENT_MATCH = _match_ctes(EVENT_SQL)
LINE_SUMS_SQL = f"""SELECT song_id, CAST(floor(t / 73.0) AS INTEGER) AS t, f % 32 AS f, CAST(sum(CAST(round(amp * 100) AS BIGINT)) AS BIGINT) AS cents FROM ({LINE_SQL}) GROUP BY ALL"""
NEIGHBOR_SQL = f"""WITH u AS ({LINE_SUMS_SQL}), sp AS (SELECT song_id, min(t) AS lo, max(t) AS hi FROM u GROUP BY 1), ce AS (SELECT song_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS t FROM sp),
 cf AS (SELECT song_id, t, CAST(f AS INTEGER) AS f FROM ce, range(0, 32) x(f)), g AS (SELECT cf.song_id, cf.t, cf.f, coalesce(cents, 0) / 100000.0::DOUBLE AS db FROM cf LEFT JOIN u ON u.song_id = cf.song_id AND u.t = cf.t AND u.f = cf.f), n AS (SELECT a.song_id, a.t, a.f, any_value(a.db) AS db, max(b.db) AS nb_max, min(b.db) AS nb_min FROM g a JOIN g b ON a.song_id = b.song_id
 AND b.t BETWEEN a.t - 7 AND a.t + 7 AND b.f BETWEEN a.f - 7 AND a.f + 7 GROUP BY 1, 2, 3)"""
FRAMES_SQL = """SELECT vec_id, CAST(t AS INTEGER) AS t, list_transform(embedding[t * 8 + 1 : t * 8 + 16], lambda x: CAST(x AS DOUBLE)) AS frame FROM embeddings, range(0, 7) r(t)"""
# M1, M2, M3 and so M4: frames of 16 samples two apart, the transform by its definition, boxes of 3 x 3, the cap, the hashes
PRINTS_SQL = f"""WITH fr AS (SELECT vec_id, CAST(t AS INTEGER) AS t, list_transform(embedding[t * 2 + 1 : t * 2 + 16], lambda x: CAST(CAST(x * 100 AS FLOAT) AS DOUBLE)) AS frame FROM embeddings, range(0, 25) r(t)),
 s AS (SELECT vec_id, t, unnest(range(0, 16)) AS n, unnest(frame) AS x FROM fr), w AS (SELECT vec_id, t, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS x FROM s),
 g AS (SELECT vec_id AS song_id, t, CAST(f AS INTEGER) AS f, CAST(20 * log10(sqrt(pow(sum(x * cos(2 * pi() * f * n / 16)), 2) + pow(sum(x * sin(2 * pi() * f * n / 16)), 2)) + 1e-10) AS FLOAT) AS db FROM w, range(0, 8) r(f) GROUP BY 1, 2, 3),
 n AS (SELECT a.song_id, a.t, a.f, any_value(a.db) AS db, max(b.db) AS hi, min(b.db) AS lo FROM g a JOIN g b ON a.song_id = b.song_id AND abs(a.t - b.t) <= 1 AND abs(a.f - b.f) <= 1 GROUP BY 1, 2, 3),
 l AS (SELECT song_id, max(db) AS loudest FROM g GROUP BY 1 HAVING max(db) >= -60),
 k AS (SELECT n.*, row_number() OVER (PARTITION BY n.song_id, t // 5512 ORDER BY db DESC, f, t) AS r FROM n JOIN l USING (song_id) WHERE db = hi AND db > lo AND db >= loudest - 60),
 p AS (SELECT row_number() OVER () AS pid, song_id, t, f FROM k WHERE r <= 15) {_hash_sql('p')}"""
JUDGED_SQL = f"""WITH r AS ({RECORD_SQL}), mx AS (SELECT max(confidence) AS top FROM r WHERE kind = 'negative' AND split = 'calibration' AND best_song_id IS NOT NULL AND aligned >= 5),
 th AS (SELECT CASE WHEN top IS NULL THEN 0.0::DOUBLE ELSE coalesce((SELECT min(round(g / 100.0::DOUBLE, 2)) FROM range(0, 101) x(g) WHERE round(g / 100.0::DOUBLE, 2) > top), 1.0::DOUBLE) END AS threshold FROM mx),
 j AS (SELECT r.*, threshold, best_song_id IS NOT NULL AND aligned >= 5 AND confidence >= threshold AS is_match, coalesce(best_song_id = true_song_id, false) AS raw FROM r, th)"""
DOC_SQL = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
DEDUPE_SQL = f"SELECT doc_id, content_hash, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1 THEN 'ingested' ELSE 'skipped' END AS outcome FROM ({DOC_SQL})"
SPLIT_SQL = f"SELECT doc_id, content_hash, CASE WHEN (row_number() OVER (ORDER BY format('{{:06d}}.mp3', doc_id)) - 1) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM ({DOC_SQL})"


def _order_sql(seed, *keys: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys) + ")"


REGISTRY: dict[str, tuple] = {
    "identify_events": (identify_events, EVENT_MATCH + MATCH_SELECT),
    "identify_lineitem": (identify_lineitem, _match_ctes(LINE_SQL) + MATCH_SELECT),
    "identify_noisy": (identify_noisy, _match_ctes(EVENT_SQL, query_filter="pid % 3 <> 0") + MATCH_SELECT),
    "identify_unknown": (identify_unknown, _match_ctes(EVENT_SQL, 3, index_filter="song_id % 20 <> 3") + MATCH_SELECT),
    "landmark_hashes": (landmark_hashes, f"WITH p AS ({LINE_SQL}) {_hash_sql('p')}"),
    "pack_unpack": (pack_unpack, f"WITH p AS ({EVENT_SQL}), h AS (SELECT DISTINCT hash FROM ({_hash_sql('p')})) SELECT hash, hash >> 17 AS f1, (hash >> 8) & 511 AS f2, hash & 255 AS dt, hash AS packed FROM h"),
    "index_lookup": (index_lookup, EVENT_MATCH + " SELECT hash, song_id, anchor_time FROM i WHERE hash IN (SELECT hash FROM q)"),
    "offset_join": (offset_join, EVENT_MATCH + ' SELECT clip_id, song_id, "offset" FROM o'),
    "offset_histogram": (_histogram, EVENT_MATCH + ' SELECT clip_id, song_id, "offset", n FROM h'),
    "tolerant_bins": (tolerant_bins, EVENT_MATCH + ' SELECT clip_id, song_id, "offset", n, score FROM s'),
    "best_bins": (best_bins, EVENT_MATCH + " SELECT clip_id, song_id, offset_frames, aligned_matches FROM b"),
    "top_candidates": (top_candidates, EVENT_MATCH + " SELECT clip_id, song_id, offset_frames, aligned_matches, rank FROM k"),
    "query_stats": (query_stats, EVENT_MATCH + " SELECT clip_id, query_hashes, db_hits FROM st"),
    "matches_enriched": (matches_enriched, EVENT_MATCH + f""", so AS ({SONG_SQL}), x AS (SELECT *, best_song_id IS NOT NULL AND best >= 5 AND conf >= 0.25 AS is_match FROM mc)
 SELECT clip_id, is_match AND so.id IS NOT NULL AS match, CASE WHEN is_match THEN best_song_id END AS song_id, title, artist, album, round(duration_s, 2) AS duration_s,
 round(greatest(0.0::DOUBLE, round(offset_frames * 256.0::DOUBLE / 11025.0::DOUBLE, 6)), 3) AS offset_s, round(round(conf, 6), 3) AS confidence FROM x LEFT JOIN so ON is_match AND so.id = best_song_id"""),
    "neighborhood_max": (neighborhood_max, NEIGHBOR_SQL + " SELECT * FROM n"),
    "grid_peaks": (grid_peaks, NEIGHBOR_SQL + """, l AS (SELECT song_id, max(db) AS loudest FROM g GROUP BY 1 HAVING max(db) >= -60),
 k AS (SELECT n.song_id, t, f, db AS amp FROM n JOIN l USING (song_id) WHERE db = nb_max AND db > nb_min AND db >= loudest - 60)
 SELECT song_id, t, f, amp FROM (SELECT *, row_number() OVER (PARTITION BY song_id, t // 43 ORDER BY amp DESC, f, t) AS r FROM k) WHERE r <= 15"""),
    "sparse_peaks": (sparse_peaks, f"WITH p AS (SELECT song_id, t, f, max(amp) AS amp FROM ({EVENT_SQL}) GROUP BY 1, 2, 3) SELECT song_id, t, f, amp FROM (SELECT *, row_number() OVER (PARTITION BY song_id, t // 43 ORDER BY amp DESC, f, t) AS r FROM p) WHERE r <= 5"),
    "peak_density": (peak_density, f"SELECT song_id, CAST(t // 43 AS BIGINT) AS block, count(*) AS n_peaks FROM ({EVENT_SQL}) GROUP BY 1, 2"),
    "shown_peaks": (shown_peaks, f"""WITH p AS (SELECT DISTINCT song_id, t, f FROM ({EVENT_SQL})), n AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t, f) - 1 AS nth, count(*) OVER (PARTITION BY song_id) AS c FROM p)
 SELECT song_id, round_even(t * 256.0::DOUBLE / 11025.0::DOUBLE, 3) AS time_s, round_even(f * (11025 / 1024.0::DOUBLE), 1) AS freq_hz FROM n WHERE nth % greatest(1, c // 20) = 0"""),
    "local_maxima": (local_maxima, """WITH e AS (SELECT label AS series, vec_id AS tick, CAST(b AS INTEGER) AS bin, embedding[b + 1] AS value FROM embeddings, range(0, 64) r(b)),
 n AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM e WINDOW w AS (PARTITION BY series, tick ORDER BY bin)),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY series, tick ORDER BY value DESC, bin) AS INTEGER) AS nth FROM n WHERE value > -90 AND value >= l AND value >= r)
 SELECT series, tick, bin, round(CAST(value AS DOUBLE), 6) AS value, nth FROM k WHERE nth <= 3"""),
    "library_search": (library_search, f"SELECT id, title, artist, album FROM ({SONG_SQL}) WHERE contains(lower(title), 'brand#1') OR contains(lower(artist), 'brand#1') ORDER BY lower(album) DESC NULLS LAST, id LIMIT 50 OFFSET 20"),
    "library_pages": (library_pages, f"SELECT id, source, source_id, title, artist, album, duration_s, '/songs/' || id || '/audio' AS audio_url FROM ({SONG_SQL}) WHERE contains(lower(title), 'ring') OR contains(lower(artist), 'ring') ORDER BY lower(title) NULLS LAST, id LIMIT 60"),
    "library_count": (library_count, f"SELECT count(*) AS total FROM ({SONG_SQL}) WHERE contains(lower(title), 'widget') OR contains(lower(artist), 'widget')"),
    "point_lookup": (point_lookup, f"SELECT id, title, 'id' AS by FROM ({SONG_SQL}) WHERE id = 7 UNION ALL SELECT id, title, 'content' FROM ({SONG_SQL}) WHERE content_hash = '4e07408562bedb8b60ce05c1decfe3ad16b72230967de01f640b7e4729b49fce'"),
    "multi_get": (multi_get, f"SELECT id, title, artist FROM ({SONG_SQL}) WHERE id IN (SELECT l_partkey * 2 FROM lineitem WHERE l_quantity >= 49)"),
    "random_song": (random_song, f"SELECT p_partkey AS id, p_name AS title FROM part ORDER BY {_order_sql(1, 'p_partkey')}, p_partkey LIMIT 1"),
    "sample_songs": (sample_songs, f"SELECT id, title FROM ({SONG_SQL}) ORDER BY {_order_sql(3, 'id')}, id LIMIT 50"),
    "song_labels": (song_labels, """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Untitled' ELSE c_name END AS title, CASE WHEN c_nationkey > 3 THEN c_mktsegment ELSE 'Unknown artist' END AS artist,
 CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1024 ** 2 THEN printf('%.1f KB', b / 1024) WHEN b < 1024 ** 3 THEN printf('%.1f MB', b / 1024 ** 2) ELSE printf('%.1f GB', b / 1024 ** 3) END AS bytes,
 CASE WHEN c_custkey % 9 = 0 THEN 'upload' WHEN c_custkey % 2 = 0 THEN 'fma' ELSE 'file' END AS source, substr(format('{:06d}', c_custkey), 1, 3) || '/' || format('{:06d}', c_custkey) || '.mp3' AS track_path,
 c_custkey AS track_id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '.v1' ELSE c_name END AS stem FROM (SELECT *, pow(10.0::DOUBLE, c_custkey % 12) AS b FROM customer)"""),
    "time_labels": (time_labels, "SELECT event_id, CAST(floor(value / 60) AS BIGINT) || ':' || format('{:02d}', CAST(floor(value % 60) AS BIGINT)) AS label, '0:00' AS negative FROM events"),
    "confidence_labels": (confidence_labels, """SELECT l_orderkey, l_linenumber, best, c AS confidence, CASE WHEN c >= 0.8 THEN 'Very high' WHEN c >= 0.55 THEN 'High' WHEN c >= 0.35 THEN 'Good' ELSE 'Fair' END AS label,
 best >= 5 AND c >= 0.25 AS is_match FROM (SELECT *, round(greatest(0.0::DOUBLE, 1 - ru::DOUBLE / best) * least(1.0::DOUBLE, best / 25.0::DOUBLE), 6) AS c FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS best, l_partkey % 50 AS ru FROM lineitem))"""),
    "content_dedupe": (content_dedupe, DEDUPE_SQL),
    "plan_stale": (plan_stale_items, f"""WITH d AS ({DOC_SQL}), s AS (SELECT content_hash, min(doc_id) AS id FROM d WHERE doc_id % 4 <> 0 GROUP BY 1),
 m AS (SELECT DISTINCT s.content_hash, CASE WHEN quality = 1 THEN 'v2' ELSE 'v1' END AS version FROM s JOIN labels l ON l.doc_id = s.id)
 SELECT f.content_hash, w.index_name, w.version FROM (SELECT DISTINCT content_hash FROM d) f, (VALUES ('fingerprint', 'v2'), ('rms', 'v1')) w(index_name, version)
 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.content_hash = f.content_hash AND w.index_name = 'fingerprint' AND m.version = w.version)"""),
    "outcome_counts": (outcomes, f"SELECT o.outcome, coalesce(c.n, 0) AS n FROM (VALUES ('ingested'), ('updated'), ('skipped'), ('failed')) o(outcome) LEFT JOIN (SELECT outcome, count(*) AS n FROM ({DEDUPE_SQL}) GROUP BY 1) c ON c.outcome = o.outcome"),
    "status_latest": (status_latest, "SELECT o_custkey AS song_id, o_orderpriority AS index_name, o_orderstatus AS version, o_orderkey AS item_count, format('{:012d}', o_orderkey) AS batch_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "cascade_delete": (cascade_delete, "SELECT l_suppkey AS song_id, count(*) AS n_rows FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"),
    "index_stats": (index_stats, f"WITH p AS ({EVENT_SQL}) SELECT s AS songs, r AS rows, round(r::DOUBLE / greatest(1, s), 6) AS rows_per_song FROM (SELECT count(DISTINCT user_id) AS s FROM events), (SELECT count(*) AS r FROM ({_hash_sql('p')}))"),
    "item_counts": (item_counts, f"WITH p AS ({EVENT_SQL}), h AS ({_hash_sql('p')}) SELECT s.song_id, coalesce(c.n, 0) AS item_count FROM (SELECT c_custkey AS song_id FROM customer) s LEFT JOIN (SELECT song_id, count(*) AS n FROM h GROUP BY 1) c USING (song_id)"),
    "round_robin": (round_robin, f"SELECT p_partkey, genre, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (ORDER BY turn, genre) AS INTEGER) AS place FROM (SELECT p_partkey, p_brand AS genre, row_number() OVER (PARTITION BY p_brand ORDER BY {_order_sql(7, 'p_partkey')}, p_partkey) AS turn FROM part)"),
    "genre_counts": (genre_counts, f"SELECT coalesce(album, '?') AS genre, count(*) AS n_tracks FROM ({SONG_SQL}) GROUP BY 1"),
    "calib_split": (calib_split, f"SELECT doc_id, split FROM ({SPLIT_SQL})"),
    "holdout_guard": (holdout_guard, f"SELECT doc_id, split, doc_id AS track_id FROM ({SPLIT_SQL}) WHERE content_hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "query_grid": (query_grid, f"SELECT id AS song_id, CAST(c AS INTEGER) AS clip_s, round(CAST('0x' || substr({_order_sql(0, 'id', 'c')}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (duration_s / 20 - c), 6) AS start_s FROM ({SONG_SQL}), (VALUES (5), (10)) v(c) WHERE duration_s / 20 >= c + 0.5"),
    "accuracy_pivot": (accuracy_pivot, JUDGED_SQL + " SELECT condition, " + ", ".join(f"round(avg(CASE WHEN clip_s = {n} THEN CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END END), 6) AS {m}_{n}s" for n in (5, 10) for m, x in (("top1", "is_match AND raw"), ("raw_top1", "raw"))) + " FROM j WHERE kind = 'positive' GROUP BY 1"),
    "false_positive_rate": (false_positive_rate, JUDGED_SQL + " SELECT condition, clip_s, count(*) AS n, CAST(sum(CASE WHEN is_match THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong, round(avg(CASE WHEN is_match THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM j WHERE kind = 'negative' AND split = 'test' GROUP BY GROUPING SETS ((condition, clip_s), ())"),
    "calibrate": (calibrate, JUDGED_SQL + " SELECT threshold FROM th"),
    "threshold_sweep": (threshold_sweep, JUDGED_SQL + """, ts AS (SELECT DISTINCT t, t = threshold AS chosen FROM (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS t UNION SELECT threshold FROM th), th),
 x AS (SELECT t, chosen, kind, coalesce(best_song_id IS NOT NULL AND aligned >= 5 AND confidence >= t, false) AS hit, raw FROM r2, ts) SELECT t, chosen, round(avg(CASE WHEN kind = 'positive' THEN CASE WHEN hit AND raw THEN 1.0::DOUBLE ELSE 0 END END), 6) AS accuracy,
 round(avg(CASE WHEN kind = 'negative' THEN CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END END), 6) AS fpr FROM x GROUP BY 1, 2""".replace("r2", "j")),
    "offset_error": (offset_error, f"""WITH r AS ({RECORD_SQL}), e AS (SELECT abs(offset_s - true_start_s) AS e FROM r WHERE kind = 'positive' AND best_song_id = true_song_id AND aligned >= 5 AND confidence >= 0.25)
 SELECT round(quantile_cont(e, 0.5), 6) AS median_s, round(quantile_cont(e, 0.95), 6) AS p95_s, round(avg(CASE WHEN e <= 0.1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_100ms, count(*) AS n FROM e"""),
    "latency_percentiles": (latency_percentiles, f"""WITH r AS (SELECT *, t_fingerprint_ms + t_lookup_ms + t_score_ms AS total FROM ({RECORD_SQL})) SELECT clip_s, round(avg(total), 4) AS mean_ms, round(quantile_cont(total, 0.5), 4) AS p50_ms, round(quantile_cont(total, 0.95), 4) AS p95_ms,
 round(avg(t_fingerprint_ms), 4) AS t_fingerprint_ms, round(avg(t_lookup_ms), 4) AS t_lookup_ms, round(avg(t_score_ms), 4) AS t_score_ms, round(avg(query_hashes), 4) AS query_hashes, round(avg(db_hits), 4) AS db_hits FROM r GROUP BY 1"""),
    "framing": (framing, f"SELECT vec_id, t, round(frame[1], 6) AS first, round(frame[16], 6) AS last FROM ({FRAMES_SQL})"),
    "frame_rms": (frame_rms, f"SELECT vec_id, t, round(sqrt(list_sum(list_transform(frame, lambda x: x * x)) / 16), 5) AS rms FROM ({FRAMES_SQL})"),
    "spectrogram": (spectrogram, f"""WITH s AS (SELECT vec_id, t, unnest(range(0, 16)) AS n, unnest(frame) AS x FROM ({FRAMES_SQL})), w AS (SELECT vec_id, t, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS x FROM s)
 SELECT vec_id AS song_id, t, CAST(f AS INTEGER) AS f, round(pow(10.0::DOUBLE, CAST(CAST(20 * log10(sqrt(pow(sum(x * cos(2 * pi() * f * n / 16)), 2) + pow(sum(x * sin(2 * pi() * f * n / 16)), 2)) + 1e-10) AS FLOAT) AS DOUBLE) / 20), 4) AS magnitude FROM w, range(0, 8) r(f) GROUP BY 1, 2, 3"""),
    "audio_fingerprints": (audio_fingerprints, PRINTS_SQL),
}


def _all() -> dict[str, tuple]:
    from tracemark.plans import library_queries  # which takes SQL from here

    return REGISTRY | library_queries.REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
