"""More registered queries, above all of the library's life: limits, sources, new songs, ingest and re-index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.functions import scalars as S
from tracemark.operators import audio, degrade, evaluation, peaks
from tracemark.operators.hashing import generate_hashes
from tracemark.plans import analogs as A
from tracemark.plans import queries as Q
from tracemark.plans.indexers import FingerprintIndexer, RmsIndexer
from tracemark.plans.library import Library, add_songs, by_shuffle
from tracemark.scratch import materialise, scratch_path
from tracemark.sources import files as X
from tracemark.streaming.pieces import gather_pieces

RATE = 8000
FLOOR_CFG = FingerprintConfig(min_freq_hz=50.0)  # the first five bins


def _vectors(spark, d, rate):
    """Vectors as clips of 64 samples at a rate."""
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), rate.alias("sample_rate"), F.col("embedding").alias("samples"))


def clip_limits(spark, d):
    """Clips cut to the longest query, or rejected as too short."""
    taken, rejected = audio.accept_clips(_vectors(spark, d, (2 + F.pmod("vec_id", F.lit(100))).cast("int")))
    length = F.round(audio.duration_s(F.col("samples"), F.col("sample_rate")), 6)
    kept = taken.select("clip_id", F.size("samples").cast("long").alias("n_samples"), length.alias("duration_s"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(rejected, allowMissingColumns=True)


CLIP_LIMITS_SQL = """
WITH c AS (SELECT vec_id AS clip_id, 2 + vec_id % 100 AS rate, CAST(least(len(embedding), 20 * (2 + vec_id % 100)) AS BIGINT) AS n FROM embeddings)
SELECT clip_id, CASE WHEN n >= rate THEN n END AS n_samples, CASE WHEN n >= rate THEN round(n::DOUBLE / rate, 6) END AS duration_s,
       CASE WHEN n < rate THEN 'too short' END AS reason FROM c
"""


def seek_window(spark, d):
    """A second and more from a start on, at 16 samples a second."""
    rows = _vectors(spark, d, F.lit(16)).withColumn("start_s", F.pmod("clip_id", F.lit(5)) * 0.7)
    cut = audio.slice_seconds(F.col("samples"), F.col("sample_rate"), F.col("start_s"), F.lit(1.3))
    rows = rows.withColumn("cut", cut)
    return rows.select("clip_id", F.size("cut").cast("long").alias("n"), F.round(F.get("cut", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("cut", F.lit(20)).cast("double"), 6).alias("last"))


SEEK_SQL = """
WITH c AS (SELECT vec_id AS clip_id, embedding, CAST(round_even(vec_id % 5 * 0.7::DOUBLE * 16, 0) AS BIGINT) AS a FROM embeddings),
     s AS (SELECT clip_id, embedding[a + 1 : a + 21] AS cut FROM c)
SELECT clip_id, CAST(len(cut) AS BIGINT) AS n, round(CAST(cut[1] AS DOUBLE), 6) AS first, round(CAST(cut[21] AS DOUBLE), 6) AS last FROM s
"""


def floored_peaks(spark, d):
    """F3 with M2: peaks above a least frequency."""
    return peaks.find_peaks(Q._grid(spark, d), FLOOR_CFG)


FLOORED_SQL = Q.NEIGHBOR_SQL.replace("coalesce(cents, 0) / 100000.0::DOUBLE AS db", "CASE WHEN cf.f < 5 THEN '-inf'::DOUBLE ELSE coalesce(cents, 0) / 100000.0::DOUBLE END AS db") + """,
l AS (SELECT song_id, max(db) AS loudest FROM g GROUP BY 1 HAVING max(db) >= -60),
k AS (SELECT n.song_id, t, f, db AS amp FROM n JOIN l USING (song_id) WHERE db = nb_max AND db > nb_min AND db >= loudest - 60)
SELECT song_id, t, f, amp FROM (SELECT *, row_number() OVER (PARTITION BY song_id, t // 43 ORDER BY amp DESC, f, t) AS r FROM k) WHERE r <= 15
"""


def upload_limits(spark, d):
    """F8: why a document would not be taken as an upload of 2,000 characters."""
    return A.table(spark, d, "documents").select("doc_id", S.reject_upload(F.col("text"), 2000).alias("reason"))


UPLOAD_SQL = """
SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) > 2000 THEN 'too large' END AS reason FROM documents
"""


def not_present(spark, d):
    """Documents without labels."""
    return X.not_present(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels"), "doc_id")


def small_subset(spark, d):
    """Files of customers with the metadata of their tracks, of which only the small subset is wanted."""
    subset = F.when(F.pmod("p_size", F.lit(3)) == 0, "small").when(F.pmod("p_size", F.lit(3)) == 1, "medium")
    tracks = A.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"), subset.alias("subset"))
    files = A.table(spark, d, "customer").select(F.format_string("/m/%03d/%06d.mp3", F.pmod("c_custkey", F.lit(7)), "c_custkey").alias("path"))
    return X.with_tracks(files, X.small_tracks(tracks)).select("path", "track_id", "title")


SUBSET_SQL = """
SELECT '/m/' || format('{:03d}', c_custkey % 7) || '/' || format('{:06d}', c_custkey) || '.mp3' AS path, c_custkey AS track_id, p_name AS title
FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size % 3 = 0
"""


def exclusion_lines(spark, d):
    """A written list of exclusions, read back; comments and blank lines are no part of it."""
    path = scratch_path(spark, "exclusions")
    labels = A.table(spark, d, "labels").filter("toxic = 1").select("doc_id", "quality").distinct()
    line = F.format_string("  %d fma_%d quality is %d", "doc_id", F.pmod("doc_id", F.lit(10)), F.col("quality").cast("int"))
    labels.select(F.explode(F.array(line, F.lit("# a comment"), F.lit(" "))).alias("value")).write.text(path)
    return X.load_exclusions(spark, path)


EXCLUSION_SQL = """
SELECT DISTINCT doc_id AS track_id, 'fma_' || doc_id % 10 AS library_id, 'quality is ' || quality AS reason FROM labels WHERE toxic = 1
"""


def clip_lengths(spark, d):
    """L6."""
    return evaluation.clip_lengths(Q._records(spark, d))


def condition_grid(spark, d):
    """Every query under every condition."""
    return degrade.with_conditions(Q.query_grid(spark, d).select("song_id", "clip_s"))


CONDITION_SQL = Q.REGISTRY["query_grid"][1]


def query_sources(spark, d):
    """Songs of the library as positive sources, files outside of it as negative ones."""
    songs = A.part_songs(A.table(spark, d, "part")).select(F.col("id").cast("long").alias("song_id"), "duration_s")
    holdout = evaluation.split_holdout(A.table(spark, d, "documents").select(F.format_string("%06d.mp3", "doc_id").alias("path"), F.lit(30.0).alias("duration_s")))
    return evaluation.query_sources(songs, holdout)


SOURCES_SQL = """
SELECT 'positive' AS kind, 'test' AS split, CAST(p_partkey AS BIGINT) AS song_id, NULL AS path, p_size * 10.0::DOUBLE AS duration_s FROM part
UNION ALL SELECT 'negative', CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 2 = 0 THEN 'calibration' ELSE 'test' END, NULL, path, 30.0::DOUBLE
FROM (SELECT format('{:06d}.mp3', doc_id) AS path FROM documents)
"""


def new_songs(spark, d):
    """Ids for contents that the library does not have, one for each content."""
    songs = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("content_hash"))
    new = A.table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"))
    return add_songs(songs, new).select("id", "content_hash")


NEW_SONGS_SQL = """
WITH n AS (SELECT DISTINCT sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part))
SELECT CAST((SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY content_hash) AS BIGINT) AS id, content_hash FROM n
"""


def ingest_vectors(spark, d):
    """Vectors as WAV files through the whole ingest, and again
    for a newer version of the index, whose rows are then read."""
    @F.pandas_udf("binary")
    def as_wav(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: X.encode_wav(np.asarray(x, np.float64), RATE))

    vectors = A.table(spark, d, "embeddings")
    vectors = vectors.withColumn("copy", F.explode(F.when(F.pmod("vec_id", F.lit(5)) == 0, F.array(F.lit("v"), F.lit("w"))).otherwise(F.array(F.lit("v")))))
    files = vectors.select(F.format_string("%s/%06d.wav", "copy", "vec_id").alias("path"), as_wav("embedding").alias("content"))
    files = materialise(files, "files")
    library = Library(spark, scratch_path(spark, "library"), buckets=8)
    first = library.ingest(files, [RmsIndexer("v1", RATE)]).select("path", "song_id", F.col("outcome").alias("first"))
    newer = RmsIndexer("v2", RATE)
    second = library.ingest(files, [newer]).select("path", F.col("outcome").alias("second"))
    found = first.join(by_shuffle(second), "path").join(by_shuffle(library.index(newer).select("song_id", "rms")), "song_id", "left")
    return found.join(by_shuffle(library.songs().select(F.col("id").alias("song_id"), "title", F.round("duration_s", 6).alias("duration_s"))), "song_id", "left").select(
        "path", "first", "second", F.round("rms", 6).alias("rms"), "title", "duration_s")


INGEST_SQL = f"""
WITH v AS (SELECT copy || format('/{{:06d}}.wav', vec_id) AS path, format('{{:06d}}', vec_id) AS stem,
             list_transform(embedding, lambda x: CAST(trunc(least(greatest(CAST(x AS DOUBLE), -1), 1) * 32767) AS INTEGER)) AS q
  FROM embeddings JOIN (VALUES ('v'), ('w')) c(copy) ON copy = 'v' OR vec_id % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY path) AS nth, first_value(stem) OVER (PARTITION BY q ORDER BY path) AS title FROM v)
SELECT path, CASE WHEN nth = 1 THEN 'ingested' ELSE 'skipped' END AS first, CASE WHEN nth = 1 THEN 'updated' ELSE 'skipped' END AS second,
       round(sqrt(list_sum(list_transform(q, lambda x: pow(x / 32768.0::DOUBLE, 2))) / len(q)), 6) AS rms, title, round(len(q) / {RATE}.0::DOUBLE, 6) AS duration_s FROM f
"""

def _as_files(spark, d):
    """Vectors as WAV files at RATE."""
    @F.pandas_udf("binary")
    def as_wav(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: X.encode_wav(np.asarray(x, np.float64), RATE))

    return materialise(A.table(spark, d, "embeddings").select(F.format_string("v/%06d.wav", "vec_id").alias("path"), as_wav("embedding").alias("content")), "files")


def delete_compact(spark, d):
    """Vectors are ingested with two indexes, some songs deleted, one index of others dropped, the buckets with dead rows
    written anew and old files removed; then songs, live rows and the library's counts are read."""
    library, ix, other = Library(spark, scratch_path(spark, "library"), buckets=8), RmsIndexer("v1", RATE), RmsIndexer("v1", RATE)
    other.name = "second"
    library.ingest(_as_files(spark, d), [ix, other])
    number = F.regexp_extract("title", "[0-9]+", 0).cast("long")
    songs = materialise(library.songs().select(F.col("id").alias("song_id"), number.alias("vec_id")), "songs")
    library.delete_song(songs.filter("vec_id % 3 = 0"))
    library.delete_index(songs.filter("vec_id % 3 = 1 and vec_id % 4 = 0"), other)
    library.compact([ix, other], dead_share=0.1)
    library.manifests.vacuum()
    rows = library.songs().select(F.col("id").alias("song_id"), number.alias("vec_id"))
    found = rows.join(library.index(ix).select("song_id", F.round("rms", 6).alias("rms")), "song_id", "left").join(library.index(other).select("song_id", F.lit(1).alias("has_second")), "song_id", "left")
    counts = library.stats(ix).select("songs", F.col("fingerprints").alias("n_rows"), F.lit(FingerprintConfig().version()).alias("config")).crossJoin(
        library.health().select(F.col("songs").alias("healthy"), "version"))
    return found.crossJoin(F.broadcast(counts)).select("vec_id", "rms", F.coalesce("has_second", F.lit(0)).alias("has_second"), "songs", "n_rows", "healthy", (F.col("version") == F.col("config")).alias("agrees"))


DELETE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(least(greatest(CAST(x AS DOUBLE), -1), 1) * 32767) AS INTEGER)) AS q FROM embeddings),
k AS (SELECT * FROM v WHERE vec_id % 3 <> 0), n AS (SELECT count(*) AS n FROM k)
SELECT vec_id, round(sqrt(list_sum(list_transform(q, lambda x: pow(x / 32768.0::DOUBLE, 2))) / len(q)), 6) AS rms, CASE WHEN vec_id % 3 = 1 AND vec_id % 4 = 0 THEN 0 ELSE 1 END AS has_second,
       n AS songs, n AS n_rows, n AS healthy, true AS agrees FROM k, n
"""


class _EventIndexer(FingerprintIndexer):
    """The landmarks of events in a library: what stands for a song's samples is the song's number."""

    def __init__(self, hashes):
        super().__init__()
        self.sample_rate, self.hashes = RATE, hashes

    def compute(self, samples):
        number = F.round(F.element_at("samples", 1).cast("double") * 32768).cast("long") + 32768 * F.round(F.element_at("samples", 2).cast("double") * 32768).cast("long")
        return self.hashes.join(samples.select("song_id", number.alias("user")), "user").select("song_id", "hash", "anchor_time")


def identify_stored(spark, d):
    """users' landmarks are ingested in a library, and clips are identified against its stored index. The users' files are
    written once: an ingest reads its files several times."""
    @F.pandas_udf("binary")
    def as_wav(users: pd.Series) -> pd.Series:
        return users.map(lambda u: X.encode_wav((np.array([u % 32768, u // 32768]) + 0.5) / 32767, RATE))

    rows = Q._events(spark, d)
    users = rows.select("song_id").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashes = generate_hashes(rows).withColumnRenamed("song_id", "user")
    library = Library(spark, scratch_path(spark, "library"), buckets=8)
    library.ingest(materialise(users.select(F.format_string("%09d.wav", "song_id").alias("path"), as_wav("song_id").alias("content")), "files"), [_EventIndexer(hashes)])
    found = library.identify(A.clip_ids(rows), generate_hashes(A.clip_peaks(rows), key="clip_id"))
    named = library.songs().select("id", F.col("title").cast("long").alias("user"))
    best = found.select("clip_id", "is_match", F.col("best_song_id").alias("id"), "aligned_matches", "runner_up_matches", "query_hashes", "db_hits")
    # ids of the library come from content hashes: where users tie, which of them is best differs, and is not shown
    return best.join(named, "id", "left").select("clip_id", "is_match", F.when(F.col("aligned_matches") > F.col("runner_up_matches"), F.col("user")).alias("user"), "aligned_matches", "runner_up_matches", "query_hashes", "db_hits")


STORED_SQL = Q.EVENT_MATCH + """ SELECT clip_id, best_song_id IS NOT NULL AND best >= 5 AND conf >= 0.25 AS is_match, CASE WHEN best > ru THEN best_song_id END AS "user",
 best AS aligned_matches, ru AS runner_up_matches, query_hashes, db_hits FROM mc"""


def noisy_vectors(spark, d):
    """M6, M9: vectors as clips under white noise at 5 dB, sample for sample."""
    clips = _vectors(spark, d, F.lit(RATE)).withColumn("condition", F.lit("noise_5db"))
    return degrade.degrade(clips, seed=7).select("clip_id", F.posexplode("samples").alias("n", "x")).select("clip_id", "n", F.round(F.col("x").cast("double"), 6).alias("x"))


def _mixed_sql(source: str, keep: str, x: str, name: str) -> str:
    """splitmix64 of a column x of 64 bits, as CTEs name_0 to name_3."""
    def times(a, k):
        return f"((({a})::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""{name}_0 AS (SELECT {keep}, ((({x})::UHUGEINT + {degrade.GAMMA}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM {source}),
{name}_1 AS (SELECT {keep}, {times('xor(z, z >> 30)', degrade.MIX_A)} AS z FROM {name}_0),
{name}_2 AS (SELECT {keep}, {times('xor(z, z >> 27)', degrade.MIX_B)} AS z FROM {name}_1),
{name}_3 AS (SELECT {keep}, xor(z, z >> 31) AS z FROM {name}_2)"""


NOISE_SQL = f"""
WITH v AS (SELECT vec_id, xor({int(degrade.mixed(7))}::UBIGINT, vec_id::UBIGINT) AS x, embedding FROM embeddings),
{_mixed_sql("v", "vec_id", "x", "a")},
{_mixed_sql("a_3", "vec_id", f"xor(z, {list(degrade.CONDITIONS).index('noise_5db')}::UBIGINT)", "b")},
s AS (SELECT b_3.vec_id, n, k, ((z::UHUGEINT + (2 * n + k)::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM b_3, range(64) r(n), range(2) q(k)),
{_mixed_sql("s", "vec_id, n, k", "x", "c")},
u AS (SELECT vec_id, n, max(CASE WHEN k = 0 THEN (z >> 11)::DOUBLE / 9007199254740992 END) AS u, max(CASE WHEN k = 1 THEN (z >> 11)::DOUBLE / 9007199254740992 END) AS v FROM c_3 GROUP BY 1, 2),
p AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]) / len(embedding) * pow(10.0::DOUBLE, -0.5)) AS level FROM embeddings)
SELECT vec_id AS clip_id, CAST(n AS INTEGER) AS n, round(CAST(CAST(CAST(embedding[n + 1] AS DOUBLE) + level * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS FLOAT) AS DOUBLE), 6) AS x
FROM p JOIN u USING (vec_id) WHERE n < len(embedding)
"""

GAP_MS, MOST, DELAY_MS = 36 * 3_600_000, 20, 600_000


def gathered_events(spark, d):
    """The events of a user as pieces of one sample, put together by a stateful stream into clips of 20 samples, or of what comes before
    a day and a half of silence."""
    root = scratch_path(spark, "gathered")
    schema = A.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    pieces = events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("piece_id"), F.col("ts").cast("timestamp").alias("ts"), F.array(F.col("value").cast("float")).alias("samples"))
    clips = gather_pieces(pieces, MOST, GAP_MS, f"{DELAY_MS} milliseconds")
    clips.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/clips").awaitTermination()
    found = spark.read.schema(clips.schema).parquet(f"{root}/clips")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("source_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), F.col("n_pieces").cast("long").alias("n_pieces"), F.round(total, 2).alias("total"))


GATHERED_SQL = f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {GAP_MS}000 THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM g),
r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY us, event_id) - 1) // {MOST} AS part, max(run) OVER (PARTITION BY user_id) AS last_run FROM s),
c AS (SELECT user_id, run, last_run, min(us) AS started, max(us) AS ended, count(*) AS n_pieces, round(sum(x), 2) AS total FROM r GROUP BY user_id, run, last_run, part)
SELECT user_id AS source_id, started, ended, n_pieces, total FROM c
WHERE n_pieces = {MOST} OR run < last_run OR ended // 1000 + {GAP_MS} < (SELECT max(us) // 1000 - {DELAY_MS} FROM e)
"""

REGISTRY: dict[str, tuple] = {
    "delete_compact": (delete_compact, DELETE_SQL),
    "identify_stored": (identify_stored, STORED_SQL),
    "noisy_vectors": (noisy_vectors, NOISE_SQL),
    "gathered_events": (gathered_events, GATHERED_SQL),
    "clip_limits": (clip_limits, CLIP_LIMITS_SQL),
    "seek_window": (seek_window, SEEK_SQL),
    "floored_peaks": (floored_peaks, FLOORED_SQL),
    "upload_limits": (upload_limits, UPLOAD_SQL),
    "not_present": (not_present, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "small_subset": (small_subset, SUBSET_SQL),
    "exclusion_lines": (exclusion_lines, EXCLUSION_SQL),
    "clip_lengths": (clip_lengths, "SELECT DISTINCT CAST(CASE WHEN l_linestatus = 'O' THEN 5 ELSE 10 END AS INTEGER) AS clip_s FROM lineitem"),
    "condition_grid": (condition_grid, f"SELECT song_id, clip_s, condition FROM ({CONDITION_SQL}), (SELECT unnest({list(degrade.CONDITIONS)}) AS condition)"),
    "query_sources": (query_sources, SOURCES_SQL),
    "new_songs": (new_songs, NEW_SONGS_SQL),
    "ingest_vectors": (ingest_vectors, INGEST_SQL),
}
