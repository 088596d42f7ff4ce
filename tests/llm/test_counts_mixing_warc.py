import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemark.llm import mixing as M
from tracemark.llm import token_counts as T

DOCS = "doc_id long, source string, text string"


# ---- mixing ----

def docs(spark, sizes, words=10):
    return spark.createDataFrame([(n * 10_000 + i, s, " ".join(["w"] * (1 + (i * 7) % (2 * words)))) for n, (s, k) in enumerate(sizes.items()) for i in range(k)], DOCS)


def test_words(spark):
    texts = [None, "", "  ", "a", " a\tb\n c ", "é ü", "a b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(M.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3, 2, 1]


def test_weights(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("z", 0)], "source string, tokens long")
    def run(**how):
        return {r["source"]: (r["alpha"], r["weight"]) for r in M.temperature_weights(totals, **how).collect()}
    def entropy(w):
        return -sum(x * math.log(x) for x in w if x > 0)
    got = run(target_entropy=0.8)
    w = [got[s][1] for s in "abc"]
    assert abs(entropy(w) - 0.8 * math.log(3)) < 1e-6 and abs(sum(w) - 1) < 1e-9 and got["z"][1] == 0
    assert abs(got["a"][1] / got["b"][1] - 10 ** got["a"][0]) < 1e-6
    got = run(max_repeats=4.0)
    assert abs(got["c"][1] / 0.01 - 4) < 1e-6
    assert run(target_entropy=0.1)["a"][0] == 1.0  # as they are is enough
    both = run(target_entropy=0.99, max_repeats=2.0)
    assert both["c"][1] / 0.01 <= 2 + 1e-6
    assert run(max_repeats=0.5)["a"][0] == 1.0
    with pytest.raises(ValueError):
        M.temperature_weights(totals)


def brute_mixture(rows, weights, seed="mix"):
    """(doc_id, epoch) of the mixture in order: a walk over each source's blocks, then a merge of the walks."""
    def number(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)
    everything, out = sum(n for _, _, n in rows), []
    for s in {s for _, s, _ in rows}:
        mine = [(i, n) for i, t, n in rows if t == s]
        total, due = sum(n for _, n in mine), math.floor(weights[s] * everything)
        n_blocks = math.ceil(math.sqrt(len(mine)))
        blocks = {}
        for i, n in mine:
            blocks.setdefault(number(seed, "block", s, i) % n_blocks, []).append((number(seed, "row", s, i), str(i), n, i))
        at = epoch = 0
        while epoch == 0 or (total and at < due):
            for turn, block in sorted((number(seed, "epoch", epoch, s, b), b) for b in blocks):
                for nth, key, n, i in sorted(blocks[block]):
                    if at + n <= due:
                        out.append(((at / due if due else 0.0), s, epoch, turn, block, nth, key, n, i))
                    at += n
            epoch += 1
    return [(r[-1], r[2]) for r in sorted(out)]


def test_mixture_against_brute_force(spark):
    df = docs(spark, {"big": 400, "mid": 60, "small": 8}).unionByName(spark.createDataFrame([(99_001, None, "x y"), (99_002, "mid", None), (99_003, "mid", ""), (99_004, "none", ""), (99_005, "long", "w " * 3000)], DOCS)).withColumn("Place", F.lit(1))
    out = M.mixture(df)
    assert out.columns == ["doc_id", "source", "text", "n_tokens", "block", "weight", "epoch", "place"]
    got = sorted(out.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))
    rows = [(r["doc_id"], r["source"] or "", len((r["text"] or "").split())) for r in df.collect()]
    totals = spark.createDataFrame([(s, sum(n for _, t, n in rows if t == s)) for s in {s for _, s, _ in rows}], "source string, tokens long")
    weights = {r["source"]: r["weight"] for r in M.temperature_weights(totals, 1.0, 0.9, 4.0).collect()}
    assert [(r["doc_id"], r["epoch"]) for r in got] == brute_mixture(rows, weights)
    everything = sum(n for _, _, n in rows)
    for s, w in weights.items():
        used = sum(r["n_tokens"] for r in got if (r["source"] or "") == s)
        size = max([n for _, t, n in rows if t == s])
        assert w * everything - size - 1 <= used <= w * everything  # documents are whole, and fit
        assert used <= 4 * sum(n for _, t, n in rows if t == s) + 1
    # every stretch has the target weights
    half = got[:len(got) // 2]
    assert abs(sum(r["n_tokens"] for r in half if r["source"] == "big") / sum(r["n_tokens"] for r in half if r["source"] != "long") - weights["big"] / (1 - weights["long"])) < 0.05
    assert sorted(map(str, M.mixture(df.repartition(7)).collect())) == sorted(map(str, got))
    assert M.mixture(df.limit(0)).isEmpty()


def test_mixture_of_repeated_rows(spark):
    rows = [(1, "s", "a b"), (1, "s", "a b"), (1, "s", "c"), (None, None, None), (2, "t", "x " * 50)]
    got = M.mixture(spark.createDataFrame(rows, DOCS), target_entropy=None, max_repeats=2.0).collect()
    assert sorted(r["place"] for r in got) == list(range(1, len(got) + 1)) and sum(r["doc_id"] == 1 for r in got) >= 3 and sum(r["doc_id"] is None for r in got) == 1


# ---- token counts ----

def changes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq int, op string, source string, lang string, text string")


def totals(roll):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in roll.totals().collect()}


def test_rollup(spark, tmp_path):
    roll, by = T.Rollup(spark, str(tmp_path / "r")), {"words-1": M.words}
    assert totals(roll) == {}
    assert roll.apply("a", changes(spark, [(1, 0, "insert", "s", "en", "a b c"), (2, 0, "insert", "s", "en", "d"), (3, 0, "insert", None, None, None), (2, 1, "revise", "s", "de", "d e"), (None, 0, "insert", "s", "en", "z")]), by)
    want = {("s", "en", "words-1"): (2, 4, 6), ("s", "de", "words-1"): (1, 2, 3), ("", "", "words-1"): (1, 0, 0)}
    assert totals(roll) == want
    assert not roll.apply("a", changes(spark, [(9, 0, "insert", "s", "en", "never")]), by) and totals(roll) == want
    roll.apply("b", changes(spark, [(1, 0, "delete", None, None, None), (77, 0, "delete", "s", "en", "x"), (2, 0, "insert", "t", "de", "d e f"), (5, 0, "revise", "s", "en", "new")]), by)
    assert totals(roll) == {("s", "en", "words-1"): (2, 2, 4), ("t", "de", "words-1"): (1, 3, 5), ("", "", "words-1"): (1, 0, 0)}
    # a batch that failed before its commit is written anew
    T.counted(changes(spark, [(5, 0, "delete", None, None, None)]), by).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{roll.root}/states/token=c")
    assert totals(roll)[("s", "en", "words-1")] == (2, 2, 4)
    roll.apply("c", changes(spark, [(5, 0, "revise", "s", "en", "x y")]), by)
    assert totals(roll)[("s", "en", "words-1")] == (2, 3, 4)
    roll.apply("empty", changes(spark, []), by)
    assert len(roll.commits()) == 4
    # equal seq: not a delete, then the greater source
    roll.apply("ties", changes(spark, [(8, 3, "delete", None, None, None), (8, 3, "insert", "p", "en", "one"), (8, 3, "insert", "q", "en", "one two")]).withColumn("tokens", F.lit("clash")).withColumn("live", F.lit("clash")), by)
    assert totals(roll)[("q", "en", "words-1")] == (1, 2, 7) and ("p", "en", "words-1") not in totals(roll)
    roll.apply("long", changes(spark, [(9, 0, "insert", "q", "en", "w " * 300_000)]), by)
    assert totals(roll)[("q", "en", "words-1")] == (2, 300_002, 600_007)


def test_batches_against_brute_force(spark, tmp_path):
    """Random batches with compactions between them; a stop at any point of a compaction changes nothing."""
    rng, by = random.Random(6), {"words-1": M.words}
    roll, held = T.Rollup(spark, str(tmp_path / "r"), buckets=4, compact_after=3), {}
    for b in range(7):
        rows = {}
        for _ in range(12):
            i = rng.choice([None, *range(15)])
            rows[i] = (i, 0, rng.choice(("insert", "revise", "delete")), rng.choice("st"), rng.choice(("en", None)), rng.choice((None, "", "a b", "c d e")))
        assert roll.apply(f"b/{b}", changes(spark, list(rows.values())), by) and not roll.apply(f"b/{b}", changes(spark, list(rows.values())), by)
        for i, _, op, s, lang, text in rows.values():
            held.pop(i, None)
            if op != "delete":
                held[i] = (s, lang or "", len((text or "").split()), len(text or ""))
        want = {}
        for s, lang, n, c in held.values():
            old = want.get((s, lang, "words-1"), (0, 0, 0))
            want[s, lang, "words-1"] = (old[0] + 1, old[1] + n, old[2] + c)
        assert totals(roll) == want
    assert roll.base() and len(roll._since()[2]) == 1 and len(roll.commits()) == 7
    # a base without its commits is none
    (tmp_path / "r" / "bases" / "000000000099-x" / "states").mkdir(parents=True)
    assert totals(roll) == want and "99-x" not in roll.base()


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    roll, by = T.Rollup(spark, str(tmp_path / "r"), buckets=8), {"words-1": M.words}
    roll.apply("all", changes(spark, [(i, 0, "insert", "s", "en", "a") for i in range(100)]), by)
    plan = roll.states([3])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*isnotnull\(token#\d+\), isnotnull\(bucket#\d+\)", plan) and {r["bucket"] for r in roll.states([3]).collect()} == {3}


def test_bpe_counts(spark, tmp_path):
    # a made vocabulary: all bytes, and two merges
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "v.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(ranks)))
    count = T.bpe_counter(spark, str(path))
    got = spark.createDataFrame([(0, "abc ab"), (1, None), (2, ""), (3, "é"), (4, "abcabc")], "i int, t string").orderBy("i").select(count(F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 0, 0, 2, 2]


def test_op10_by_brute_force(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    rows = [(i, "ab"[i % 2], "en" if i % 3 else None, "x " * (i % 5)) for i in range(40)]
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in T.op10(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), str(path)).collect()}
    want = {}
    for i, s, lang, t in rows:
        if i % 10 != 3:
            t = f"{t}\n{t}" if i % 10 == 7 else t
            for name, n in (("byte_bpe_50k-1", len(t.encode())), ("words-1", len(t.split()))):
                k = (s, lang or "", name)
                old = want.get(k, (0, 0, 0))
                want[k] = (old[0] + 1, old[1] + n, old[2] + len(t))
    assert got == want
