import numpy as np
import pytest
from conftest import rows, song
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.functions import scalars as S
from tracemark.operators import library as L
from tracemark.plans.indexers import FingerprintIndexer, RmsIndexer, default_indexers
from tracemark.plans.library import Library, add_songs, latest_status, outcome_counts, require_new
from tracemark.plans.manifests import Manifests
from tracemark.sources import files as X
from tracemark.streaming import jobs


@pytest.fixture(scope="module")
def wavs():
    return [(f"/m/{i:06d}.wav", X.encode_wav(song(i, 6.0), 11_025)) for i in range(3)]


def frame(spark, named):
    return spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in named], "path string, content binary")


def outcomes(df):
    return {r["outcome"]: r["n"] for r in outcome_counts(df).collect()}


def test_ingest_workflow(spark, wavs, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    ix = default_indexers()
    bad = ("/m/bad.wav", b"\0" * 1000)
    first = lib.ingest(frame(spark, [*wavs, bad, ("/m/copy.wav", wavs[0][1]), ("/m/none.wav", None)]), ix)
    assert outcomes(first) == {"ingested": 3, "updated": 0, "skipped": 1, "failed": 2}
    assert lib.songs().count() == 3 and first.filter("outcome = 'failed'").filter("error is not null").count() == 2
    n = lib.index(ix[0]).count()
    assert n > 100 and lib.statuses().agg(F.sum("item_count")).first()[0] == n
    again = lib.ingest(frame(spark, wavs), ix)
    assert outcomes(again) == {"ingested": 0, "updated": 0, "skipped": 3, "failed": 0} and lib.index(ix[0]).count() == n
    # other parameters replace the rows of that index only
    other = FingerprintIndexer(FingerprintConfig(fan_out=2))
    third = lib.ingest(frame(spark, wavs[:2]), [other])
    assert outcomes(third)["updated"] == 2 and {tuple(r["indexes"]) for r in third.collect()} == {("fingerprint",)}
    assert 0 < lib.index(other).count() < n and lib.index(ix[0]).select("song_id").distinct().count() == 1
    # a new index is filled in alone
    rms = RmsIndexer(sample_rate=11_025)
    fourth = lib.ingest(frame(spark, wavs), [other, rms])
    assert {(r["path"], tuple(r["indexes"])) for r in fourth.collect()} == {(wavs[0][0], ("rms",)), (wavs[1][0], ("rms",)), (wavs[2][0], ("fingerprint", "rms"))}
    assert lib.index(rms).count() == 3
    lib.compact([other, rms])
    assert lib.index(rms).count() == 3 and lib.index(ix[0]).isEmpty() and lib.songs().count() == 3
    stats = lib.stats(other).first()
    assert stats["songs"] == 3 and stats["fingerprints"] == lib.index(other).count() and stats["database_bytes"] > 0
    assert lib.health().first()["version"] == "fc1931cb812b"
    gone = lib.songs().orderBy("id").limit(1).select(F.col("id").alias("song_id"))
    lib.delete_song(gone)
    assert lib.songs().count() == 2 and lib.index(rms).count() == 2


def test_compaction_writes_the_buckets_that_need_it(spark, wavs, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=4)
    ix, rms = default_indexers()[0], RmsIndexer(sample_rate=11_025)
    lib.ingest(frame(spark, wavs), [ix, rms])
    ids = [r["id"] for r in lib.songs().orderBy("id").collect()]
    before, kept_rms = lib.index(ix), rows(lib.index(rms).filter(F.col("song_id") != ids[0]).select("song_id", "rms"))
    n, of_first = before.count(), before.filter(F.col("song_id") == ids[0]).count()
    assert {r["n_dead"] for r in lib.dead_rows(ix).collect()} == {0} and lib.compact([ix, rms]) == {"fingerprint": [], "rms": []}
    lib.delete_song(spark.createDataFrame([(ids[0],)], "song_id long"))
    want = rows(lib.index(ix).select("song_id", "hash", "anchor_time"))
    dead = {r["bucket"]: r["n_dead"] for r in lib.dead_rows(ix).collect()}
    assert sum(dead.values()) == of_first and lib.dead_rows(rms).filter("n_dead > 0").count() == 1
    # the one bucket of the other index that holds the song is written, no other; a high limit writes none
    assert lib.compact([rms], dead_share=0.999) == {"rms": [ids[0] % 4]} and lib.compact([ix], dead_share=0.99) == {"fingerprint": []}
    assert rows(lib.index(rms).select("song_id", "rms")) == kept_rms
    assert lib.compact([ix]) == {"fingerprint": [0, 1, 2, 3]} and rows(lib.index(ix).select("song_id", "hash", "anchor_time")) == want
    assert lib.dead_rows(ix).agg(F.sum("n_dead"), F.sum("n_rows")).first()[:] == (0, n - of_first)
    # a reader that began before still finds its files, until they are removed
    assert before.count() == n
    assert lib.manifests.vacuum(keep=1) > 0 and lib.manifests.vacuum(keep=1) == 0
    assert rows(lib.index(ix).select("song_id", "hash", "anchor_time")) == want and rows(lib.index(rms).select("song_id", "rms")) == kept_rms
    with pytest.raises(Exception):
        before.count()
    again = lib.ingest(frame(spark, wavs), [ix, rms])
    assert outcomes(again) == {"ingested": 1, "updated": 0, "skipped": 2, "failed": 0} and lib.songs().agg(F.max("id")).first()[0] > max(ids)
    # rows of one index
    one = lib.songs().orderBy("id").limit(1).select(F.col("id").alias("song_id"))
    lib.delete_index(one, ix)
    assert lib.index(ix).select("song_id").distinct().count() == 2 and lib.songs().count() == 3 and lib.songs_without_rows_of(ix).count() == 1
    assert outcomes(lib.ingest(frame(spark, wavs), [ix]))["updated"] == 1 and lib.songs_without_rows_of(ix).isEmpty()


def test_a_batch_is_seen_whole_or_not_at_all(spark, wavs, tmp_path, monkeypatch):
    """A stop after any of the folders that a batch writes, and one in the commit itself, leave the library as it was."""
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    ix = default_indexers()
    lib.ingest(frame(spark, wavs[:1]), ix)
    def state():
        fresh = Library(spark, str(tmp_path / "lib"), buckets=2)
        return fresh.songs().count(), fresh.index(ix[0]).count(), fresh.statuses().count()
    was = state()
    folders = Manifests.new_folder
    for stop in ("songs", "index_fingerprint", "song_indexes"):
        def stopping(self, table, stop=stop):
            if table == stop:
                raise RuntimeError("stopped")
            return folders(self, table)
        with monkeypatch.context() as m:
            m.setattr(Manifests, "new_folder", stopping)
            with pytest.raises(RuntimeError):
                lib.ingest(frame(spark, wavs), ix)
        assert state() == was
    (tmp_path / "lib" / "manifests" / ".half").write_text('{"songs"')  # a list that was not renamed is none
    base, tables = lib.manifests.current()
    assert outcomes(lib.ingest(frame(spark, wavs), ix)) == {"ingested": 2, "updated": 0, "skipped": 1, "failed": 0}
    assert state()[0] == 3
    with pytest.raises(RuntimeError, match="another writer"):
        lib.manifests.commit(base, tables)
    assert lib.manifests.vacuum() >= 3 and state()[0] == 3  # what the stopped batches left


def test_a_lookup_reads_its_buckets(spark, wavs, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=16)
    ix = default_indexers()[0]
    lib.ingest(frame(spark, wavs), [ix])
    hashes = lib.index(ix).select("hash").orderBy("hash").limit(3)
    got = lib.lookup(hashes, ix)
    assert rows(got.select("hash", "song_id", "anchor_time")) == rows(lib.index(ix).join(hashes.distinct(), "hash", "left_semi").select("hash", "song_id", "anchor_time"))
    plan = got._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert lib.lookup(hashes.limit(0), ix).isEmpty()


def test_a_batch_that_stops_leaves_nothing(spark, wavs, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    with pytest.raises(RuntimeError):
        lib.ingest(frame(spark, wavs[:2]), fail_before_commit=True)
    assert lib.songs().isEmpty() and lib.index(FingerprintIndexer()).isEmpty()
    assert outcomes(lib.ingest(frame(spark, wavs[:2])))["ingested"] == 2
    assert lib.songs().count() == 2 and lib.songs().select("content_hash").distinct().count() == 2


def test_identify_against_the_library(spark, wavs, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.ingest(frame(spark, wavs))
    from tracemark.operators.audio import fingerprint

    clips = spark.createDataFrame([(5, song(1, 6.0)[11_025:11_025 * 4].tolist())], "clip_id long, samples array<float>")
    got = lib.identify(clips, fingerprint(clips, key="clip_id")).first()
    assert lib.songs().filter(F.col("id") == got["song_id"]).first()["title"] == "000001" and abs(got["offset_s"] - 1.0) < 0.05
    # an index of other parameters is not asked
    assert not lib.identify(clips, fingerprint(clips, key="clip_id"), FingerprintConfig(fan_out=2)).first()["is_match"]


def test_streams(spark, wavs, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for p, b in wavs[:2]:
        (root / p.rsplit("/", 1)[1]).write_bytes(b)
    (root / "empty.wav").write_bytes(b"")
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    for _ in range(2):
        jobs.ingest_stream(jobs.audio_files(spark, str(root)), lib, str(tmp_path / "cp")).awaitTermination()
    assert lib.songs().count() == 2 and {r["source"] for r in lib.songs().collect()} == {"upload"}
    # the same files under a new checkpoint are a replay and do nothing
    jobs.ingest_stream(jobs.audio_files(spark, str(root)), lib, str(tmp_path / "cp2")).awaitTermination()
    assert lib.songs().count() == 2
    clips = spark.createDataFrame([(1, 11_025, song(0, 6.0)[:44_100].tolist()), (2, 11_025, [0.0] * 100)], "clip_id long, sample_rate int, samples array<float>")
    clips.write.parquet(str(tmp_path / "clips"))
    stream = spark.readStream.schema(clips.schema).parquet(str(tmp_path / "clips"))
    jobs.identify_stream(stream, lambda: lib.index(FingerprintIndexer()), str(tmp_path / "out"), str(tmp_path / "cp3")).awaitTermination()
    got = {r["clip_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1]["is_match"] and got[2]["reject_reason"] == "too short"


def test_decode(spark):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(88_200) / 44_100)
    x = X.decode_wav(X.encode_wav(np.stack([tone, tone], axis=1), 44_100), 11_025)
    assert abs(len(x) - 22_050) <= 50 and 0.65 < x.max() < 0.75 and x.dtype == np.float32
    got = X.decode(spark.createDataFrame([("a", bytearray(b"not audio at all"))], "content_hash string, content binary")).first()
    assert got["samples"] is None and "WAV" in got["error"]
    for data in (b"RIFF....WAVE", b""):
        with pytest.raises(ValueError):
            X.decode_wav(data, 11_025)


def wav(kind, bits, rate, body):
    form = kind.to_bytes(2, "little") + (1).to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * bits // 8).to_bytes(4, "little") + (bits // 8).to_bytes(2, "little") + bits.to_bytes(2, "little")
    chunks = b"fmt " + len(form).to_bytes(4, "little") + form + b"data" + len(body).to_bytes(4, "little") + body
    return b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WAVE" + chunks


def test_forms_and_rates():
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0])
    forms = [(1, 8, (x * 127 + 128).astype(np.uint8).tobytes(), 0.01), (1, 16, (x * 32767).astype("<i2").tobytes(), 1e-4),
             (1, 24, b"".join(int(v * 8_388_607).to_bytes(3, "little", signed=True) for v in x), 1e-6), (1, 32, (x * 2_147_483_647).astype("<i4").tobytes(), 1e-6),
             (3, 32, x.astype("<f4").tobytes(), 1e-7), (3, 64, x.astype("<f8").tobytes(), 1e-7)]
    for kind, bits, body, most in forms:
        assert np.abs(X.decode_wav(wav(kind, bits, 8000, body), 8000) - x).max() <= most, bits
    for rate, to in ((48_000, 11_025), (44_100, 16_000), (8_000, 11_025), (44_100, 11_025)):
        t = np.arange(rate) / rate
        got = X.resample(np.sin(2 * np.pi * 440 * t) + (np.sin(2 * np.pi * 0.47 * rate * t) if rate > 2 * to else 0), rate, to)
        want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / to)
        assert len(got) == to and np.abs(got - want)[200:-200].max() < 0.01, (rate, to)


def test_files_and_metadata(spark, tmp_path):
    for name in ("b.MP3", "a.wav", "c.txt", "sub/d.flac"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(name.encode())
    found = X.discover(spark, str(tmp_path / "r"))
    assert [r["path"].rsplit("/", 1)[1] for r in found.orderBy("path").collect()] == ["a.wav", "b.MP3", "d.flac"]
    assert X.discover(spark, str(tmp_path / "r"), 2).count() == 2
    assert X.holdout_files(spark, str(tmp_path / "r")).isEmpty()
    csv = ',track,track,artist,album,set,track\n,title,genre_top,name,title,subset,duration\ntrack_id,,,,,,\n2, One ,Rock,"A, ""B""",,small,12.5\n2,Two,,X,Y,medium,\n3,"a\nb",Pop,,,small,x\nzz,1,,,,,\n'
    (tmp_path / "tracks.csv").write_text(csv)
    t = X.load_tracks(spark, str(tmp_path / "tracks.csv"))
    assert {tuple(r) for r in t.collect()} == {(2, "Two", "X", "Y", None, "medium", None), (3, "a\nb", None, None, "Pop", "small", None)}
    assert [r["track_id"] for r in X.small_tracks(t).collect()] == [3]
    files = spark.createDataFrame([("/x/000002.mp3",), ("/x/2.mp3",)], "path string")
    assert {(r["path"], r["title"]) for r in X.with_tracks(files, t).collect()} == {("/x/000002.mp3", "Two"), ("/x/2.mp3", None)}
    (tmp_path / "ex.txt").write_text("# c\n\n12 7 same  recording here\n")
    assert rows(X.load_exclusions(spark, str(tmp_path / "ex.txt"))) == [(12, "7", "same  recording here")]
    assert rows(X.not_present(t.select("track_id"), t.filter("track_id = 2"))) == [(3,)]


def test_search_sort_and_pages(spark):
    data = [(i, f"Song {i}", f"Artist {i % 2}", None if i == 3 else "al%b_", 20.0) for i in range(5)]
    songs = spark.createDataFrame(data, "id long, title string, artist string, album string, duration_s double").withColumns({
        "source": F.lit("fma"), "source_id": F.lit("1"), "created_at": F.current_timestamp(), "content_hash": F.lit("h"), "file_path": F.lit("/p")})
    assert L.count_songs(songs).first()[0] == 5 and L.count_songs(songs, "ARTIST 1").first()[0] == 2 and L.count_songs(songs, "%").first()[0] == 0
    assert [r["title"] for r in L.list_songs(songs, None, "title", True).collect()] == [f"Song {i}" for i in range(4, -1, -1)]
    assert [r["id"] for r in L.list_songs(songs, None, "album", True).collect()] == [0, 1, 2, 4, 3]
    assert [r["id"] for r in L.list_songs(songs, None, "album", False, 2, 3).collect()] == [4, 3]
    for bad in (dict(sort="file_path"), dict(limit=10_000), dict(offset=-1), dict(query="x" * 201)):
        with pytest.raises(ValueError):
            L.list_songs(songs, **bad)
    assert L.random_song(songs, 3).count() == 1 and rows(L.sample_songs(songs, 2, 1).select("id")) == rows(L.sample_songs(songs, 2, 1).select("id"))
    assert "file_path" not in L.public_songs(songs).columns and L.public_songs(songs).first()["audio_url"] == "/songs/0/audio"
    assert L.get_songs(songs, spark.createDataFrame([(1,), (1,), (99,)], "id long")).count() == 1
    assert L.by_id(songs, 2).first()["title"] == "Song 2" and L.by_content_hash(songs, "h").count() == 5
    assert L.cascade(spark.createDataFrame([(1,), (77,)], "song_id long"), songs).count() == 1


def test_round_robin(spark):
    tracks = spark.createDataFrame([(i, "ab"[i % 2] if i < 9 else None) for i in range(11)], "id long, genre string")
    place = L.round_robin(tracks, "genre", "id", 1).orderBy("place").collect()
    assert [r["genre"] for r in place][:3] == ["?", "a", "b"] and [r["turn"] for r in place] == sorted(r["turn"] for r in place)
    a = [r["id"] for r in L.choose_tracks(tracks, "genre", "id", 4, 0, 1).collect()]
    b = [r["id"] for r in L.choose_tracks(tracks, "genre", "id", 4, 4, 1).collect()]
    assert a + b == [r["id"] for r in place][:8] and not set(a) & set(b)


def test_songs_are_unique_by_content(spark):
    songs = spark.createDataFrame([(4, "x")], "id long, content_hash string")
    new = spark.createDataFrame([("x",), ("y",), ("y",), ("z",)], "content_hash string")
    assert rows(add_songs(songs, new).select("id", "content_hash")) == [(5, "y"), (6, "z")]
    for bad in (new, new.filter("content_hash = 'x'")):
        with pytest.raises(Exception, match="duplicate content_hash"):
            require_new(songs, bad).collect()
    assert require_new(songs, new.filter("content_hash = 'z'")).count() == 1


def test_status_upsert(spark):
    df = spark.sql("select 1L song_id, 'fp' index_name, v version, n item_count, t indexed_at, b batch_id from values ('v1', 10L, timestamp'2024-01-01', 'a'), ('v2', 20L, timestamp'2024-01-02', 'b') x(v, n, t, b)")
    assert rows(latest_status(df).select("version", "item_count")) == [("v2", 20)]


def test_labels(spark):
    one = spark.range(1)
    def value(c):
        return one.select(c).first()[0]
    assert value(S.position_label(F.lit(83.4))) == "1:23" and value(S.position_label(F.lit(float("nan")))) == "0:00"
    assert value(S.exact_position_label(F.lit(83.46))) == "1:23.5" and value(S.human_bytes(F.lit(1536))) == "1.5 KB"
    assert value(S.track_path(F.lit(2))) == "000/000002.mp3" and value(S.track_id_from_path(F.lit("/a/0000002.mp3"))) is None
    assert value(S.track_id_from_path(F.lit("/a/000012.mp3"))) == 12 and value(S.track_id_from_path(F.lit("000012.MP3"))) is None
    assert value(S.title_or_stem(F.lit(""), F.lit("/a/b.c.mp3"))) == "b.c" and value(S.title_label(F.lit("  "))) == "Untitled"
    assert [value(S.confidence_label(F.lit(x))) for x in (0.8, 0.55, 0.35, 0.1)] == ["Very high", "High", "Good", "Fair"]
    assert [value(S.reject_upload(F.lit(x).cast("binary"), 3)) for x in ("", "abcd", "abc")] == ["empty", "too large", None]
    assert value(S.source_tag(F.lit(1))) == "fma" and value(S.source_tag(F.lit(None), F.lit(True))) == "upload"
    assert abs(value(S.frames_to_seconds(F.lit(43))) - 43 * 256 / 11025) < 1e-12 and value(S.seconds_to_frames(F.lit(256 / 11025))) == 1


def test_an_ingest_sends_no_table_through_the_driver(spark):
    """What grows with the library is joined by shuffle, small or not."""
    from tracemark.plans.library import plan_stale

    songs = spark.createDataFrame([(1, "a")], "id long, content_hash string")
    marks = spark.createDataFrame([(1, "rms", "v1")], "song_id long, index_name string, version string")
    wanted = spark.createDataFrame([("rms", "v1"), ("rms2", "v1")], "index_name string, version string")
    plan = plan_stale(spark.createDataFrame([("a",), ("b",)], "content_hash string"), songs, marks, wanted)
    assert sorted(map(tuple, plan.collect())) == [("a", "rms2", "v1"), ("b", "rms", "v1"), ("b", "rms2", "v1")]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") >= 2


def test_small_files_are_decoded_by_many_tasks(spark, tmp_path, monkeypatch):
    """Forty small files are the work of all shuffle partitions, though their bytes would fit in one."""
    import numpy as np

    from tracemark.plans import library as L
    from tracemark.plans.indexers import RmsIndexer
    from tracemark.sources.files import encode_wav

    seen, plain = [], L.decode
    monkeypatch.setattr(L, "decode", lambda due, rate: (seen.append(due.rdd.getNumPartitions()), plain(due, rate))[1])
    files = spark.createDataFrame([(f"{i:02d}.wav", bytearray(encode_wav(np.array([i / 50.0, 0.1]), 8000))) for i in range(40)], "path string, content binary")
    got = L.Library(spark, str(tmp_path / "lib"), buckets=2).ingest(files, [RmsIndexer("v1", 8000)])
    assert seen == [4] and {r["outcome"] for r in got.collect()} == {"ingested"}
