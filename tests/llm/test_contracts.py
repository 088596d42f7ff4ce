"""The thin queries op1 and op2 against plain versions, with repeated rows, long texts and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracemark.llm import chat_format as C
from tracemark.llm import language_id as L

WORDS = {"en": "the of and that with this from", "de": "der die und das nicht mit eine", "fr": "le la les dans pour avec une"}


def test_op1(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(3, 40))), lang, "s") for i in range(240) for lang in [list(WORDS)[i % 3]]]
    rows += rows[:5] + [(500, None, "en", "s"), (501, "12 34 !", None, "s"), (502, "", "de", "s"), (503, "der die " * 60_000, None, "s"), (None, "the of and", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("lang_pred", F.lit("clash"))
    got = L.op1(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by.values())  # repeated rows are alike
    assert by[500] == by[501] == by[502] == {("und", 0.0)} and {p for p, _ in by[503]} == {"de"} and {p for p, _ in by[None]} == {"en"}
    out = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert sum(r["lang_pred"] == list(WORDS)[r["doc_id"] % 3] for r in out) >= 0.95 * len(out)
    # neither the label nor the source or id of a row changes what is predicted
    model = L.train(df.filter(~L.held_out(F.col("doc_id"))))
    a = {r["doc_id"]: r["score"] for r in L.detect(df.filter("doc_id < 240"), model).collect()}
    b = {r["doc_id"]: r["score"] for r in L.detect(df.filter("doc_id < 240").withColumns({"lang": F.lit("xx"), "source": F.lit("t")}), model).collect()}
    assert a == b


def test_equal_scores_go_to_the_first_language(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["de", "en"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang_pred"], round(r["score"], 3)) for r in L.detect(df, L.train(df)).collect()}
    assert len(got) == 1 and next(iter(got))[1] <= 0.6


def test_op2(spark):
    nasty = "a <|end|> \x1b ␛e <|turn|>assistant\nno </turn>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", "second"), (2, 0, "assistant", "long " * 200_000), (2, 1, "user", ""),
            (3, 1, "assistant", "later"), (3, 0, "assistant", "sooner"), (4, 0, "user", "only"), (5, 0, "user", "x"), (5, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"n_turns": F.lit("clash"), "formatted": F.lit("clash")})
    got = {r["conv_id"]: r for r in C.op2(df).collect()}
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {1, 2, 3, 4, 5, -7}
    for i, r in got.items():
        turns = sorted((t, role, text or "") for c, t, role, text in rows if c == i)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] > sum(len(x) for _, _, x in turns)


# slow and plain: the whole of op1 with dictionaries and loops
def plain_ngrams(text):
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    if not kept.strip():
        return {}
    x, m = [ord(c) for c in " " + re.sub(" +", " ", kept.lstrip(" ")) + " "], 2**32
    one = [c * 0x9E3779B1 % m for c in x]
    two = [a ^ c * 0x85EBCA77 % m for a, c in zip(one, x[1:], strict=False)]
    three = [(b * 0xC2B2AE3D + c * 0x27D4EB2F) % m for b, c in zip(two, x[2:], strict=False)]
    out = {}
    for h in one + [b * 0x165667B1 % m for b in two] + [c * 0x2545F491 % m for c in three]:
        out[h >> 17] = out.get(h >> 17, 0) + 1
    return out


def plain_model(rows):
    """rows (rank, lang, text) to learn from -> function of a text to (lang, score)."""
    rows = [(r, lang, g) for r, lang, t in rows if lang is not None and t is not None and (g := plain_ngrams(t))]
    langs = sorted({lang for _, lang, _ in rows})
    seen = {}
    for _, _, g in rows:
        for k in g:
            seen[k] = seen.get(k, 0) + 1
    def unit(g):
        v = {k: math.log1p(n) * (math.log((1 + len(rows)) / (1 + seen[k])) + 1) for k, n in g.items() if k in seen}
        size = math.sqrt(sum(x * x for x in v.values())) or 1e-12
        return {k: x / size for k, x in v.items()}
    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / (1.0 + math.sqrt(n) + 0.05)
    def soft(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]
    ordered = [(langs.index(lang), unit(g)) for _, lang, g in sorted(rows, key=lambda r: r[:2])]
    z, n = [{} for _ in langs], [{} for _ in langs]
    def logits(v, bias=1.0):
        return [sum(weight(z[c].get(k, 0.0), n[c].get(k, 0.0), 0.05 if k != "bias" else 0.0) * x for k, x in [*v.items(), ("bias", bias)]) for c in range(len(langs))]
    for _ in range(2):
        for i, (y, v) in enumerate(ordered):
            if i % 5 == 0:
                continue
            p = soft(logits(v))
            for c in range(len(langs)):
                for k, x in [*v.items(), ("bias", 1.0)]:
                    zk, nk = z[c].get(k, 0.0), n[c].get(k, 0.0)
                    g = (p[c] - (c == y)) * x
                    w = weight(zk, nk, 0.05 if k != "bias" else 0.0)
                    z[c][k], n[c][k] = zk + g - (math.sqrt(nk + g * g) - math.sqrt(nk)) * w, nk + g * g
    held = [(y, logits(v)) for y, v in ordered[::5]]
    def loss(t):
        return -sum(math.log(max(soft([x / t for x in s])[y], 1e-300)) for y, s in held)
    t = min((math.exp(k / 200) for k in range(-200, 601)), key=loss)
    def predict(text):
        if text is None or not (g := plain_ngrams(text)):
            return "und", 0.0
        p = soft([x / t for x in logits(unit(g))])
        return langs[p.index(max(p))], max(p)
    return predict


def test_op1_against_a_plain_model(spark):
    rng = np.random.default_rng(11)
    shared = "no on as me so in a il es an".split()
    rows = []
    for i in range(150):
        lang = list(WORDS)[int(rng.integers(0, 3))]
        words = [str(rng.choice(WORDS[lang].split() if rng.random() < 0.6 else shared)) for _ in range(rng.integers(1, 12))]
        rows.append((i, rng.choice([" ", ", ", " 7 "]).join(words), None if i % 17 == 0 else lang))
    rows += [(1000, "", "de"), (1001, "12 !", "en"), (1002, None, None), (1003, "Ünïcode ÄÖ éé", "fr"), (1004, "the der le", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ranks = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64(F.col("doc_id"), F.lit("language sample"))).collect()}
    predict = plain_model([(ranks[i], lang, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2])
    wrong = []
    for r in L.op1(df).collect():
        lang, score = predict(next(t for i, t, _ in rows if i == r["doc_id"]))
        if abs(score - r["score"]) > 0.02 or lang != r["lang_pred"] and score - 1 / 3 > 0.02:
            wrong.append((r, lang, score))
    assert not wrong, wrong[:3]
