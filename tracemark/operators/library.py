"""Queries on the song library: search, order, pages, counts, lookups, samples and public rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.config import Limits
from tracemark.functions.scalars import seeded_order
from tracemark.scratch import join_hot, with_rank

SORT_FIELDS = ("id", "title", "artist", "album", "duration_s", "created_at")
TEXT_FIELDS = ("title", "artist", "album")


def matches_query(query: str | None, title: Column, artist: Column) -> Column:
    """a literal part of title or artist, whatever the case; no query takes all, nulls match nothing."""
    if not query:
        return F.lit(True)
    if len(query) > Limits.query_chars:
        raise ValueError(f"a query has at most {Limits.query_chars} characters")
    def holds(c):
        return F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return holds(title) | holds(artist)


def search(songs: DataFrame, query: str | None = None) -> DataFrame:
    return songs.filter(matches_query(query, F.col("title"), F.col("artist")))


def list_songs(songs: DataFrame, query: str | None = None, sort: str = "title", descending: bool = False, limit: int = 60, offset: int = 0) -> DataFrame:
    """L1, L2: one page; texts order without case, nulls come last both ways, ties go by id upwards."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"sort is one of {', '.join(SORT_FIELDS)}")
    if not 1 <= limit <= Limits.page_size or offset < 0:
        raise ValueError(f"limit is 1 to {Limits.page_size}, offset 0 or more")
    key = F.lower(F.col(sort)) if sort in TEXT_FIELDS else F.col(sort)
    return search(songs, query).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id").offset(offset).limit(limit)


def count_songs(songs: DataFrame, query: str | None = None) -> DataFrame:
    """A5."""
    return search(songs, query).agg(F.count(F.lit(1)).alias("total"))


def by_id(songs: DataFrame, song_id: int) -> DataFrame:
    """F2."""
    return songs.filter(F.col("id") == song_id)


def by_content_hash(songs: DataFrame, content_hash: str) -> DataFrame:
    return songs.filter(F.col("content_hash") == content_hash)


def get_songs(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """The songs of a column of ids; absent ids give no row."""
    return songs.join(ids.select(F.col("id")).distinct(), "id", "left_semi")


def random_song(songs: DataFrame, seed: int | None = None) -> DataFrame:
    """L3: any song; with a seed always the same, however the songs are stored."""
    return songs.orderBy(F.rand() if seed is None else seeded_order(seed, F.col("id")), "id").limit(1)


def sample_songs(songs: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """L4: n songs without repetition, the same for one seed."""
    return songs.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def round_robin(tracks: DataFrame, genre: str, key: str, seed: int = 0) -> DataFrame:
    """Tracks with genre (null is ?), turn and place: the first of each genre in name order, then the second ones.

    The order inside a genre is a fixed shuffle. A genre may hold most tracks: turns are ranks over all tracks less those
    of the genres before, so that no task sees a genre whole. Runs when this is called.
    """
    named = with_rank(_shuffled(tracks, genre, key, seed), ["genre", "_order", key], "_rank")
    first = named.groupBy("genre").agg(F.min("_rank").alias("_first"))
    turns = join_hot(named, first, ["genre"]).withColumn("turn", (F.col("_rank") - F.col("_first") + 1).cast("int"))
    return with_rank(turns, ["turn", "genre"], "place").withColumn("place", F.col("place").cast("int")).select(*tracks.columns, *[c for c in ("genre",) if c not in tracks.columns], "turn", "place")


def _shuffled(tracks: DataFrame, genre: str, key: str, seed: int) -> DataFrame:
    return tracks.withColumns({"genre": F.coalesce(F.col(genre), F.lit("?")), "_order": seeded_order(seed, F.col(key))})


def choose_tracks(tracks: DataFrame, genre: str, key: str, limit: int, skip: int = 0, seed: int = 0) -> DataFrame:
    """A slice of the round robin; slices of one seed with other skips share no track. Only skip + limit turns of a
    genre are ranked, and ranked against other genres."""
    turn = F.row_number().over(Window.partitionBy("genre").orderBy("_order", key))  # Spark keeps skip + limit of a genre on the map side
    turns = _shuffled(tracks, genre, key, seed).withColumn("turn", turn).filter(F.col("turn") <= skip + limit).drop("_order")
    return turns.orderBy("turn", "genre").offset(skip).limit(limit)


def genre_counts(tracks: DataFrame, genre: str = "genre") -> DataFrame:
    """Tracks of each genre; null is ?."""
    return tracks.groupBy(F.coalesce(F.col(genre), F.lit("?")).alias("genre")).agg(F.count(F.lit(1)).alias("n_tracks"))


def public_songs(songs: DataFrame) -> DataFrame:
    """Without path and content hash, with the address of the audio."""
    return songs.select("id", "source", "source_id", "title", "artist", "album", "duration_s", "created_at", F.format_string("/songs/%d/audio", F.col("id")).alias("audio_url"))


def cascade(rows: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows whose song is there still."""
    return rows.join(songs.select(F.col("id").alias("song_id")), "song_id", "left_semi")
