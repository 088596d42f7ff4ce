import random

from pyspark.sql import functions as F

from tracemark.operators.library import choose_tracks, random_song, round_robin
from tracemark.scratch import join_hot, with_rank


def test_ranks_without_a_global_window(spark):
    rng = random.Random(2)
    values = [(rng.randrange(60), i) for i in range(2000)] + [(None, 1), (None, 2)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_rank(df, [F.col("a").desc(), "b"]).collect()
        want = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 2003))
        # nearly all rows have one key
        hot = with_rank(df.select(F.lit(1).alias("a"), "b"), ["a", "b"], "b")
        assert sorted(r["b"] for r in hot.collect()) == list(range(1, 2003))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_rank(df.limit(0), ["a"]).isEmpty()


def test_joins_of_hot_keys(spark):
    big = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(6000)], "k int, v int")
    small = spark.createDataFrame([(0, "x"), (7, "y"), (9, "z")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = join_hot(big, small, ["k"], how, share=10), big.join(small, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how


def test_a_large_genre(spark):
    tracks = spark.createDataFrame([(i, "big" if i % 10 else ("a", "b", None)[i // 10 % 3]) for i in range(900)], "id int, g string")
    got = sorted(round_robin(tracks, "g", "id", 3).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 901)) and [r["genre"] for r in got[:8]] == ["?", "a", "b", "big"] * 2
    for genre in ("?", "a", "b", "big"):
        turns = [r["turn"] for r in got if r["genre"] == genre]
        assert turns == list(range(1, len(turns) + 1))
    assert [r["id"] for r in got[2:9]] == [r["id"] for r in choose_tracks(tracks, "g", "id", 7, 2, 3).collect()]
    songs = tracks.withColumn("title", F.lit("t"))
    assert random_song(songs, 5).first()["id"] == random_song(songs.repartition(5), 5).first()["id"] and random_song(songs).count() == 1
