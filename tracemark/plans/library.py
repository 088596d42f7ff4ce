"""A song library in Parquet: content-addressed, versioned and idempotent ingest, and lookups in its indexes.

A batch writes songs, rows of every index and markers into folders of its own, and then commits one list that names them (see
manifests): it counts as a whole or not at all. A row of an index counts if the latest marker of its song names its version and
batch, so that a newer version replaces the rows of its own index alone. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig, MatchConfig
from tracemark.functions.scalars import title_or_stem
from tracemark.operators.audio import duration_s
from tracemark.operators.matching import match_fingerprints
from tracemark.operators.meeting import clip_groups
from tracemark.plans.indexers import Indexer, default_indexers
from tracemark.plans.manifests import Manifests, Tables
from tracemark.schemas import SONG_INDEXES, SONGS
from tracemark.scratch import materialise, with_rank
from tracemark.sources.files import decode

OUTCOMES = ("ingested", "updated", "skipped", "failed")
BUCKETS = 64


class Library:
    """X5."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifests = Manifests(spark, self.root)
        self.init_schema()

    def init_schema(self) -> None:
        """An empty library where there is none; what is there stays."""
        base, _ = self.manifests.current()
        if not base:
            self.manifests.commit(0, {"songs": {}, "song_indexes": {}})

    def _markers(self) -> DataFrame:
        return self.manifests.read("song_indexes", SONG_INDEXES)

    def statuses(self) -> DataFrame:
        """The latest marker of each song and index."""
        return latest_status(self._markers())

    def songs(self) -> DataFrame:
        """Songs with a marker."""
        songs = self.manifests.read("songs", SONGS)
        return songs.join(by_shuffle(self.statuses().select(F.col("song_id").alias("id")).distinct()), "id", "left_semi")

    def index(self, indexer: Indexer, version: str | None = None) -> DataFrame:
        """Live rows of an index, of one version (by default the indexer's own)."""
        return self._live(self._rows(indexer, version), indexer)

    def _rows(self, indexer: Indexer, version: str | None = None) -> DataFrame:
        """Rows of an index in one version, dead ones too."""
        return self._all_rows(indexer).filter(F.col("version") == (version or indexer.version))

    def _all_rows(self, indexer: Indexer) -> DataFrame:
        return self.manifests.read(f"index_{indexer.name}", f"{indexer.columns}, batch_id string, part string, version string, bucket int")

    def _live(self, rows: DataFrame, indexer: Indexer) -> DataFrame:
        live = self.statuses().filter(F.col("index_name") == indexer.name).select("song_id", "version", "batch_id")
        return rows.join(by_shuffle(live), ["song_id", "version", "batch_id"], "left_semi")

    def lookup(self, hashes: DataFrame, indexer: Indexer) -> DataFrame:
        """J1 on the stored index: live rows with one of the hashes (hash). Only the buckets of the hashes are read, and
        only the rows that have one are held against the markers."""
        wanted = hashes.select("hash").distinct()
        buckets = [r[0] for r in wanted.select(F.pmod("hash", F.lit(self.buckets)).cast("int")).distinct().collect()]  # no more than there are
        return self._live(self._rows(indexer).filter(F.col("bucket").isin(*buckets)).join(wanted, "hash", "left_semi"), indexer)

    def plan(self, files: DataFrame, indexers: list[Indexer]) -> DataFrame:
        """Work items (content_hash, index_name, version, sample_rate) of indexes that are missing or outdated."""
        wanted = self.spark.createDataFrame([(x.name, x.version, x.sample_rate) for x in indexers], "index_name string, version string, sample_rate int")
        return plan_stale(files, self.songs(), self.statuses(), wanted)

    def ingest(self, files: DataFrame, indexers: list[Indexer] | None = None, fail_before_commit: bool = False) -> DataFrame:
        """Files (path, content, and optionally title, artist, album, source, source_id)
        to songs and indexes; (path, content_hash, song_id, outcome, error, indexes) of every file.

        A file whose content is known and current is skipped before it is decoded; a copy in the batch is skipped too;
        one that cannot be decoded fails, is not recorded, and does not stop the others. Null content fails.
        fail_before_commit stops before the markers, for tests of recovery.
        """
        indexers = indexers if indexers is not None else default_indexers()
        batch = uuid.uuid4().hex
        base, tables = self.manifests.current()
        for name in ("title", "artist", "album", "source", "source_id"):
            if name not in files.columns:
                files = files.withColumn(name, F.lit("file" if name == "source" else None).cast("string"))
        hashed = files.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256))
        # a number of parts that stays: files are decoded one by one, and by their bytes alone small ones would be the work of a task or two
        hashed = hashed.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "content_hash")
        first = Window.partitionBy("content_hash").orderBy("path")
        ranked = hashed.withColumn("nth", F.row_number().over(first))
        # written, not cached: what was planned and found must not change with the tables that the batch appends to
        todo = self._keep(self.plan(hashed.select("content_hash").distinct(), indexers), f"staging/{batch}/todo")
        work = ranked.filter("nth = 1").join(by_shuffle(todo.select("content_hash").distinct()), "content_hash", "left_semi")
        decoded = []
        for rate in sorted({x.sample_rate for x in indexers}):  # W2: decoded once for each rate
            due = work.join(by_shuffle(todo.filter(F.col("sample_rate") == rate).select("content_hash").distinct()), "content_hash", "left_semi")
            decode(due, rate).write.mode("overwrite").parquet(f"{self.root}/staging/{batch}/rate={rate}")
            decoded.append(self.spark.read.schema("content_hash string, sample_rate int, samples array<float>, error string").parquet(f"{self.root}/staging/{batch}/rate={rate}").withColumn("rate_no", F.lit(len(decoded))))
        got = reduce(DataFrame.unionByName, decoded)
        per_file = got.groupBy("content_hash").agg(F.max("error").alias("error"), F.max_by(duration_s(F.col("samples"), F.col("sample_rate")), "rate_no").alias("duration_s"))
        good = per_file.filter("error is null").select("content_hash", "duration_s")

        known = self.songs().select("id", "content_hash")
        # no id is given twice, not even that of a deleted song
        top = self.manifests.read("songs", SONGS).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        fresh = work.join(by_shuffle(good), "content_hash").join(by_shuffle(known), "content_hash", "left_anti")
        # ids of new songs only: one narrow row each
        ids = with_rank(fresh.select("content_hash"), ["content_hash"], "nth").crossJoin(F.broadcast(top)).select("content_hash", (F.col("top") + F.col("nth")).cast("long").alias("id"))
        rows = fresh.join(by_shuffle(ids), "content_hash").select(
            "id", F.coalesce("source", F.lit("file")).alias("source"), "source_id", title_or_stem(F.col("title"), F.col("path")).alias("title"), "artist", "album",
            F.col("duration_s").cast("double").alias("duration_s"), F.col("path").alias("file_path"), "content_hash", F.current_timestamp().alias("created_at"))
        written = self._write(tables, "songs", rows)
        named = written.unionByName(known.join(by_shuffle(good), "content_hash", "left_semi"), allowMissingColumns=True).select("content_hash", F.col("id").alias("song_id"))
        markers = []
        for x in indexers:
            due = named.join(by_shuffle(todo.filter(F.col("index_name") == x.name).select("content_hash")), "content_hash", "left_semi")
            samples = got.filter(F.col("sample_rate") == x.sample_rate).join(by_shuffle(due), "content_hash").select("song_id", "sample_rate", "samples")
            stored = self._append(tables, x, x.compute(samples), batch)
            counts = stored.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))  # of this batch's folder alone
            markers.append(due.join(by_shuffle(counts), "song_id", "left").select(  # A21
                "song_id", F.lit(x.name).alias("index_name"), F.lit(x.version).alias("version"), F.coalesce("n", F.lit(0)).cast("long").alias("item_count"),
                F.current_timestamp().alias("indexed_at"), F.lit(batch).alias("batch_id")))
        result = self._keep(self._outcomes(ranked, todo, per_file, known, named), f"results/batch={batch}")
        self._write(tables, "song_indexes", reduce(DataFrame.unionByName, markers))
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self.manifests.commit(base, tables)
        self._delete(f"staging/{batch}")
        return result

    def _write(self, tables: Tables, table: str, rows: DataFrame) -> DataFrame:
        """rows in a new folder of a table, which is added to the list of tables, and read back."""
        folder = self.manifests.new_folder(table)
        rows.write.parquet(f"{self.root}/{folder}")
        tables.setdefault(table, {})[folder] = []
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, name: str) -> None:
        fs, path = self.manifests.fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def _append(self, tables: Tables, indexer: Indexer, rows: DataFrame, batch: str) -> DataFrame:
        """A batch's rows in a new folder, by version and bucket of the hash (else the song), sorted inside their files."""
        key = "hash" if "hash" in rows.columns else "song_id"
        out = rows.withColumns({"batch_id": F.lit(batch), "version": F.lit(indexer.version), "bucket": F.pmod(F.col(key), F.lit(self.buckets)).cast("int")})
        return self._write_index(tables, indexer, out)

    def _write_index(self, tables: Tables, indexer: Indexer, rows: DataFrame) -> DataFrame:
        table, key = f"index_{indexer.name}", "hash" if "hash" in rows.columns else "song_id"
        folder = self.manifests.new_folder(table)
        rows.repartition("version", "bucket").sortWithinPartitions("version", "bucket", key).write.partitionBy("version", "bucket").parquet(f"{self.root}/{folder}")
        tables.setdefault(table, {})[folder] = []
        return self.spark.read.schema(f"{indexer.columns}, batch_id string, version string, bucket int").parquet(f"{self.root}/{folder}")

    @staticmethod
    def _outcomes(ranked, todo, per_file, known, named) -> DataFrame:
        items = todo.groupBy("content_hash").agg(F.sort_array(F.collect_set("index_name")).alias("due"))
        was = known.select(F.col("content_hash").alias("content_hash"), F.col("id").alias("old_id"))
        rows = (ranked.select("path", "content_hash", "nth").join(by_shuffle(items), "content_hash", "left").join(by_shuffle(per_file.select("content_hash", "error")), "content_hash", "left")
                .join(by_shuffle(was), "content_hash", "left").join(by_shuffle(named), "content_hash", "left"))
        outcome = (F.when((F.col("nth") > 1) & F.col("error").isNull(), "skipped").when(F.col("due").isNull(), "skipped").when(F.col("error").isNotNull(), "failed")
                   .when(F.col("old_id").isNotNull(), "updated").otherwise("ingested"))
        none = F.array().cast("array<string>")
        return rows.select("path", "content_hash", F.coalesce("song_id", "old_id").alias("song_id"), outcome.alias("outcome"), "error",
                           F.when(outcome.isin("ingested", "updated"), F.col("due")).otherwise(none).alias("indexes"))

    def stats(self, indexer: Indexer) -> DataFrame:
        """Songs, fingerprints, and bytes of their tables as the store counts them. Rows lie in buckets of their hash
        and are sorted by it: they are the index, which has no bytes of its own."""
        rows, meta = self.manifests.size(f"index_{indexer.name}"), self.manifests.size("songs", "song_indexes")
        counts = self.songs().agg(F.count(F.lit(1)).alias("songs")).crossJoin(self.index(indexer).agg(F.count(F.lit(1)).alias("fingerprints")))
        sizes = {"fingerprints_table_bytes": rows, "fingerprints_index_bytes": 0, "metadata_bytes": meta, "database_bytes": rows + meta}
        return counts.select("*", *[F.lit(n).cast("long").alias(c) for c, n in sizes.items()])

    def health(self, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
        """W8."""
        return self.songs().agg(F.count(F.lit(1)).alias("songs")).withColumn("version", F.lit(cfg.version()))

    def identify(self, clips: DataFrame, queries: DataFrame, fp: FingerprintConfig = FingerprintConfig(), cfg: MatchConfig = MatchConfig()) -> DataFrame:
        """M5 against the index of the same version. The queries are written once: they are counted, and tell which buckets to read."""
        from tracemark.plans.indexers import FingerprintIndexer

        queries = materialise(queries, "queries")
        met = self.lookup(queries, FingerprintIndexer(fp))
        return match_fingerprints(clips, queries, met, cfg, fp, groups=clip_groups(queries.count()))

    def delete_song(self, song_ids: DataFrame) -> None:
        """Songs and all their rows go: the markers are written anew without theirs. compact() removes what lies there still."""
        base, tables = self.manifests.current()
        live = self._markers().join(song_ids.select("song_id"), "song_id", "left_anti")
        tables["song_indexes"] = {}
        self._write(tables, "song_indexes", live)
        self.manifests.commit(base, tables)

    def delete_index(self, song_ids: DataFrame, indexer: Indexer) -> None:
        """W5 for one index: its rows of these songs go, and a later ingest makes them anew; songs and other indexes stay.
        The songs get a marker of no version, which no row has."""
        base, tables = self.manifests.current()
        gone = self.statuses().filter(F.col("index_name") == indexer.name).join(song_ids.select("song_id"), "song_id", "left_semi")
        none = {"version": F.lit(""), "item_count": F.lit(0).cast("long"), "indexed_at": F.current_timestamp(), "batch_id": F.lit(uuid.uuid4().hex)}
        self._write(tables, "song_indexes", gone.withColumns(none).select(*self._markers().columns))
        self.manifests.commit(base, tables)

    def songs_without_rows_of(self, indexer: Indexer) -> DataFrame:
        """Ids of songs whose latest marker names no current rows of an index."""
        current = self.statuses().filter((F.col("index_name") == indexer.name) & (F.col("version") == indexer.version)).select(F.col("song_id").alias("id"))
        return self.songs().select("id").join(current, "id", "left_anti")

    def dead_rows(self, indexer: Indexer) -> DataFrame:
        """(bucket, n_rows, n_dead) of an index, over all versions; a dead row is one that no latest marker names."""
        rows = self._all_rows(indexer).select("song_id", "version", "batch_id", "bucket")
        per_song = rows.groupBy("song_id", "version", "batch_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
        live = self.statuses().filter(F.col("index_name") == indexer.name).select("song_id", "version", "batch_id", F.lit(True).alias("live"))
        marked = per_song.join(live, ["song_id", "version", "batch_id"], "left")
        return marked.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("live").isNull(), F.col("n"))), F.lit(0)).alias("n_dead"))

    def compact(self, indexers: list[Indexer], dead_share: float = 0.0) -> dict[str, list[int]]:
        """Write the buckets of each index anew whose share of dead rows is above dead_share, and songs and markers without dead ones;
        the other buckets' files stay as they are. One commit; readers of the list before it go on until vacuum().
        Returns the buckets that were written for each index, at most as many as there are."""
        base, tables = self.manifests.current()
        done = {}
        for x in indexers:
            name = f"index_{x.name}"
            held = tables.get(name, {})
            done[x.name] = sorted(r["bucket"] for r in self.dead_rows(x).filter(F.col("n_dead") > dead_share * F.col("n_rows")).select("bucket").collect())
            if done[x.name]:
                live = self._live(self._all_rows(x).filter(F.col("bucket").isin(done[x.name])), x).drop("part")
                tables[name] = {f: sorted({*gone, *done[x.name]}) for f, gone in held.items() if len({*gone, *done[x.name]}) < self.buckets}
                self._write_index(tables, x, live)
        songs, markers = self.songs(), self.statuses().select(*self._markers().columns)
        tables["songs"], tables["song_indexes"] = {}, {}
        self._write(tables, "songs", songs)
        self._write(tables, "song_indexes", markers)
        self.manifests.commit(base, tables)
        return done


def by_shuffle(rows: DataFrame) -> DataFrame:
    """rows for a join that sends neither side through the driver: songs, files and markers grow with the library, and as long as each
    is small enough to broadcast, a batch's many joins would send them there again and again."""
    return rows.hint("merge")


def latest_status(markers: DataFrame) -> DataFrame:
    """The newest row of each (song_id, index_name); of equal times the greater batch id."""
    best = F.max_by(F.struct("version", "item_count", "indexed_at", "batch_id"), F.struct("indexed_at", "batch_id"))
    return markers.groupBy("song_id", "index_name").agg(best.alias("s")).select("song_id", "index_name", "s.*")


def plan_stale(files: DataFrame, songs: DataFrame, statuses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content_hash, index_name, version, ...) of wanted indexes that a file's song does not have in that version."""
    current = songs.select(F.col("id").alias("song_id"), "content_hash").join(by_shuffle(statuses.select("song_id", "index_name", "version")), "song_id").select("content_hash", "index_name", "version")
    return files.select("content_hash").crossJoin(F.broadcast(wanted)).join(by_shuffle(current), ["content_hash", "index_name", "version"], "left_anti")


def outcome_counts(results: DataFrame) -> DataFrame:
    """All four outcomes, 0 where there is none."""
    counts = results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    every = results.sparkSession.createDataFrame([(x,) for x in OUTCOMES], "outcome string")
    return every.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def add_songs(songs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: new (content_hash, ...) that are not there, one of each content, with ids after the greatest."""
    top = songs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = new.dropDuplicates(["content_hash"]).join(songs.select("content_hash"), "content_hash", "left_anti")
    return with_rank(fresh, ["content_hash"], "_nth").crossJoin(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_nth")).cast("long")).drop("_top", "_nth")


def require_new(songs: DataFrame, new: DataFrame) -> DataFrame:
    """S8, strict: new as it is, with an error at run time if a content is there already or comes twice."""
    seen = new.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n"))
    known = songs.select("content_hash").distinct().withColumn("_known", F.lit(True))
    rows = new.join(seen, "content_hash").join(known, "content_hash", "left")
    bad = F.col("_known").isNotNull() | (F.col("_n") > 1)
    return rows.withColumn("content_hash", F.when(bad, F.raise_error(F.concat(F.lit("duplicate content_hash "), F.col("content_hash"))).cast("string")).otherwise(F.col("content_hash"))).drop("_n", "_known")
