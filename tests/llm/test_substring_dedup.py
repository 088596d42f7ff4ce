import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemark.llm import substring_dedup as S

DOCS = "doc_id long, text string"
LAST = float("inf")


def brute(rows, window):
    """{doc_id: set of (n_words, spans, kept)} by a dictionary of word tuples."""
    docs = [(LAST if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for order, _, ws in docs:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            first[key] = min(first.get(key, LAST), order)
    out = set()
    for order, i, ws in docs:
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k:k + window])] < order:
                gone |= set(range(k, k + window))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.add((i, len(ws), tuple(map(tuple, spans)), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    passages = [[f"p{j}w{k}" if rng.random() < 0.9 else "the" for k in range(rng.choice([3, 8, 13, 14, 60]))] for j in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 3, 6])):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(30)}" for _ in range(rng.choice([1, 5, 20]))]
        rows.append((rng.choice([i * 37 % 1009, i * 37 % 1009, -i]), rng.choice([" ", "\t", " \n\x0b", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("window,seed,block", [(13, 1, None), (13, 2, 200), (3, 3, 1), (1, 4, 500), (5, 5, 3000)])
def test_against_brute_force(spark, window, seed, block):
    rows = corpus(seed) + [(None, None), (5000, None), (5001, ""), (5002, " \t "), (5003, "a b  c \x1cd")]
    rows += [rows[3], rows[4], (None, rows[5][1]), (None, rows[5][1] + " x")]  # repeated rows, and rows without an id
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"n_words": F.lit("clash"), "id": F.lit("clash"), "removed": F.lit(1)})
    got = S.remove_repeats(df, window=window, block_bytes=block).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_words"], tuple((s["start"], s["end"]) for s in r["removed"]), r["kept"]) for r in got} == brute(rows, window)


def test_hot_passage_long_text_and_digest(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{passage} own{i}" if i % 3 == 0 else " ".join(f"x{i}y{k}" for k in range(20))) for i in range(3000)]
    rows.append((-5, "long " * 200_000 + passage))
    got = {r["doc_id"]: r for r in S.op12(spark.createDataFrame(rows, DOCS).repartition(6)).collect()}
    assert got[-5]["n_removed"] == 0 and got[-5]["n_words"] == 200_060
    for i in range(3000):
        kept = f"own{i}" if i % 3 == 0 else rows[i][1]
        assert got[i]["n_removed"] == (60 if i % 3 == 0 else 0) and got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_a_hot_window_is_one_entry_of_a_block(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    rows = spark.createDataFrame([(i, passage) for i in range(5000)], DOCS).coalesce(1)
    packed = rows.select(F.col("doc_id").alias("id"), "text").mapInArrow(S._blocks(13, 6, 1 << 20), S.PACKED)
    assert packed.filter("not known").select(F.sum(F.length("hashes") / S.HASH_BYTES)).first()[0] == 1


def test_empty(spark):
    assert S.op12(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        S.remove_repeats(spark.createDataFrame([], DOCS), window=0)
