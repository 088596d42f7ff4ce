"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Whole texts are lower-cased, what is no letter becomes one space, and n-grams of 1 to 3 characters are hashed to
buckets. Document frequencies are summed over all rows to learn from. The weights are fitted with
follow-the-regularised-leader and elastic-net penalties on a sample of at most `per_lang` documents a language (by
default 1500; one fifth of it is held back), and a temperature fitted on what was held back calibrates the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import without

BUCKETS = 1 << 15
PER_LANG = 1500
MAX_LANGS = 1000
MIN_SCORE = 0.3
UND = "und"
_letters: list = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a text's n-grams; None if it has no letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[x]
    if not is_letter.any():
        return None
    x = np.where(is_letter, x, np.uint32(32))
    before = np.empty(len(x), bool)
    before[0], before[1:] = True, ~is_letter[:-1]
    x = np.concatenate([np.array([32], np.uint32), x[is_letter | ~before], np.array([32], np.uint32)])
    with np.errstate(over="ignore"):
        a = x * np.uint32(0x9E3779B1)
        b = a[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))
        c = b[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
        h = np.concatenate([a, b * np.uint32(0x165667B1), c * np.uint32(0x2545F491)]) >> np.uint32(17)
    counts = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf[at]
        return v @ self.weights[at] / max(float(np.sqrt(v @ v)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = ngram_counts(text)
        if got is None or not self.langs:
            return UND, 0.0
        p = softmax(self.logits(*got) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 2, alpha: float = 1.0,
             beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket x class, sparse by l1) and bias from rows (class, buckets, unit vector), by FTRL-proximal."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(zs, ns, penal):
        return np.where(np.abs(zs) <= penal, 0.0, -(zs - np.sign(zs) * penal) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for y, at, v in rows:
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            penal = np.full(len(at), l1)
            penal[-1] = 0.0  # the bias is not penalised to zero
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns, penal)
            err = softmax(w @ v)
            err[y] -= 1.0
            g = err[:, None] * v
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[:, at] = ns + g * g
    penal = np.append(np.full(BUCKETS, l1), 0.0)
    w = weights(z, n, penal)
    return w[:, :-1].T.copy(), w[:, -1].copy()


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm, -1 to 3."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = -1.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches):
    """Of each bucket the number of texts that have it; bucket -1 counts the texts."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            got = ngram_counts(text)
            if got is not None:
                df[got[0]] += 1
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def _features(batches):
    for batch in batches:
        rank, lang, texts = [c.to_pylist() for c in batch.columns]
        got = [ngram_counts(t) for t in texts]
        keep = [i for i, x in enumerate(got) if x is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rank[i] for i in keep], pa.int64()), pa.array([lang[i] for i in keep], pa.string()),
             pa.array([got[i][0].astype(np.int32).tobytes() for i in keep], pa.binary()),
             pa.array([got[i][1].astype(np.int32).tobytes() for i in keep], pa.binary())], ["rank", "lang", "at", "counts"])


def _fit(idf: np.ndarray, langs: list[str]):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in sample.sort_values(["rank", "lang"], kind="stable").itertuples(index=False):
            at, counts = np.frombuffer(r.at, np.int32), np.frombuffer(r.counts, np.int32)
            v = np.log1p(counts) * idf[at]
            rows.append((langs.index(r.lang), at, v / max(float(np.sqrt(v @ v)), 1e-12)))
        fit, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
        weights, bias = fit_ftrl(fit, len(langs))
        logits = np.array([v @ weights[at] + bias for _, at, v in held]).reshape(-1, len(langs))
        t = fit_temperature(logits, np.array([y for y, _, _ in held], int))
        at = np.flatnonzero(np.abs(weights).sum(axis=1))
        return pd.DataFrame({"bucket": [*at.tolist(), -1, -2], "w": [*weights[at].tolist(), bias.tolist(), [t]]})
    return run


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on the rows of df whose label is not null and whose text has a letter.

    The document frequencies cover all of them. The sample holds, of each language, the per_lang rows of least hash.
    With no such row the model knows no language and answers und. More than MAX_LANGS labels raise an error.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(id_col), F.lit("language sample")).alias("rank"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels")
    langs = sorted(sizes)
    idf, weights, bias, t = np.zeros(BUCKETS), np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)), 1.0
    if not langs:
        return Model([], idf, weights, bias, t)
    counted = dict(rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False))
    total = counted.pop(-1, 0)
    if not total:
        return Model([], idf, weights, bias, t)
    at = np.array(list(counted), int)
    idf[at] = np.log((1 + total) / (1 + np.array(list(counted.values())))) + 1
    # a little more than per_lang by a bound on the hash, and of these per_lang at most
    bound = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 1.2 * per_lang / v))])
    sample = rows.filter(F.pmod("rank", F.lit(1 << 31)) < F.element_at(bound, F.col("lang")) * (1 << 31))
    sample = sample.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.xxhash64("text")))).filter(F.col("nth") <= per_lang)
    features = sample.select("rank", "lang", "text").mapInArrow(_features, "rank long, lang string, at binary, counts binary")
    for r in features.groupBy(F.lit(0).alias("one")).applyInPandas(_fit(idf, langs), "bucket long, w array<double>").toLocalIterator():
        if r["bucket"] >= 0:
            weights[r["bucket"]] = r["w"]
        elif r["bucket"] == -1:
            bias = np.array(r["w"])
        else:
            t = r["w"][0]
    return Model(langs, idf.astype(np.float32), weights.astype(np.float32), bias, t)


def detect(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1) of every whole text: und and 0 where it is null or has no letter.

    Equal scores go to the first language by name. An empty table gives an empty table; columns of these names in df
    are replaced.
    """
    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    out = without(df, "lang_pred", "score").withColumn("_got", predict(F.col(text_col).cast("string")))
    return out.withColumns({"lang_pred": F.col("_got.lang"), "score": F.col("_got.score")}).drop("_got")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of docs whose language is identified: neither und nor below min_score."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    names = docs.columns
    return detect(docs, model).filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select(*names)


def op1(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return detect(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
