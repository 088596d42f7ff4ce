import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemark.llm import exact_dedup as X
from tracemark.llm import jaccard_join as J
from tracemark.llm.shingles import shingle_set

DOCS = "doc_id long, text string"


def brute_components(rows, words, num, den):
    """Components by comparing all pairs of sets of word tuples."""
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(ws[i:i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200]))]
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab).upper(), "x"]]) or ["y"]
            rows.append((len(rows) * 7 % 1009, " ".join(text) if rng.random() < 0.5 else "\t".join(text)))
    return rows


@pytest.mark.parametrize("words,num,seed,block", [(3, 90, 1, 150_000), (5, 80, 2, 150_000), (3, 80, 3, 300), (1, 50, 4, 200), (3, 90, 5, 100)])
def test_components_are_exact(spark, words, num, seed, block):
    rows = corpus(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS), words=words, threshold=(num, 100), block_tokens=block)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, words, num, 100)


def test_hot_near_copies_in_many_blocks(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(120)] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    for num in (80, 90):
        got = J.jaccard_components(spark.createDataFrame(rows, DOCS), words=3, threshold=(num, 100), block_tokens=700)
        assert {tuple(r) for r in got.collect()} == brute_components(rows, 3, num, 100)


def test_join_edge_cases(spark):
    long = "word " * 20_000
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "À b c"), (8, "à b c"), (None, "a"), (9, long), (10, long), (11, "a\x1cb c d")]
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash")), words=3, threshold=(90, 100)).collect()
    by = {r["id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == 12
    # only A-Z is lower-cased; without words no link; a null id links with nothing
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == by[5] == (1, 4) and by[6] == (1, 6)
    assert by[7][1] == 7 and by[8][1] == 8 and by[None] == (1, None) and by[10] == by[9] == (1, 9) and by[11] == (1, 11)
    empty = spark.createDataFrame([], DOCS)
    assert J.jaccard_components(empty).isEmpty() and J.jaccard_dedup(empty).isEmpty()
    kept = J.jaccard_dedup(spark.createDataFrame([(2, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", "k"), (3, None, "k")], "doc_id long, text string, __x string"))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "None"] and kept.columns == ["doc_id", "text", "__x"]


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(5, "a b c d"), (5, "x y z q"), (7, "x y z q"), (3, "a b c d")]
    got = {(r["id"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, DOCS), words=3, threshold=(90, 100)).collect()}
    assert got == {(5, 3), (7, 3), (3, 3)}


def test_shingle_hashes():
    assert len(shingle_set("a b a b a b", 3)) == 2 and len(shingle_set("ab", 3)) == 1 and len(shingle_set("\x0b\x0c", 3)) == 0
    assert np.array_equal(shingle_set("x  Y\tz", 3), shingle_set("X y\nZ", 3)) and not np.array_equal(shingle_set("xy z w", 3), shingle_set("x yz w", 3))


def test_components_of_chains(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300) if i % 60 != 59] + [(1000, i) for i in range(2000, 2100)]
    rng.shuffle(links)
    got = dict(map(tuple, J.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == i // 60 * 60 for i in range(300) if i % 60) and all(got[i] == 1000 for i in range(2000, 2100))


def test_exact_groups(spark):
    rng = random.Random(3)
    texts = ["", "a", "A", "a ", "é", "é", "x" * 50_000, "x" * 49_999 + "y", "p" * 64 + "1", "p" * 64 + "2"]
    rows = [(i, rng.choice(texts), "k") for i in range(150)] + [(900, None, "k"), (901, None, "k")] + [(1000 + i, "hot", "k") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    for keep, best, most in (("max", max, None), ("min", min, 10**6), ("max", max, 1), ("min", min, 7)):  # from no text split to all of them
        found = X.exact_dedup(df, keep=keep, partition_rows=most)
        got = {r["doc_id"]: r for r in found.collect()}
        assert len(got) == len(rows) == found.count() and found.columns == ["doc_id", "text", *X.OWN]
        assert all(got[i]["text"] == t for i, t, _ in rows)
        for i, t, _ in rows:
            same = [j for j, u, _ in rows if (u or "") == (t or "")]
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best(same), len(same), i == best(same), hashlib.sha256((t or "").encode()).hexdigest())


def test_equal_texts_across_partitions(spark):
    """Copies that come from many partitions, of texts around every border of the range: all equal ones meet."""
    rows = [(n * 100 + i, f"{'same head ' * 10}{i:03d}" if i % 2 else f"{i:03d}") for i in range(100) for n in range(12)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (None, 5):
            found = X.exact_dedup(df, keep="max", partition_rows=most)
            got = found.withColumn("_p", F.spark_partition_id()).collect()
            assert all(r["keep_id"] == 1100 + r["doc_id"] % 100 and r["group_size"] == 12 for r in got) and len(got) == 1200 and len({r["_p"] for r in got}) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_edge_cases(spark):
    df = spark.createDataFrame([(1, " a  b "), (2, "a b"), (2, "a b"), (None, "a b"), (None, "c")], DOCS)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in X.exact_dedup(df, how="space").collect())
    assert got == [("1", "1", 4, True), ("2", "1", 4, False), ("2", "1", 4, False), ("None", "1", 4, False), ("None", "None", 1, True)]
    assert X.exact_dedup(spark.createDataFrame([], DOCS)).isEmpty()
    with pytest.raises(ValueError):
        X.exact_dedup(df, keep="first")
