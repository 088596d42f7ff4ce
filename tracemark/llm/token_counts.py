"""Token counts with delta-maintained rollups.

A batch of inserts, deletes and revised texts is counted, compared with what the documents counted before, and folded
to signed sums by source, language and tokenizer version; totals are the sums of all committed batches. A batch writes
its document states and its sums into folders of its own and its commit last: what is not committed is not read, a
batch that failed writes new folders, and one that is committed already does nothing. States lie in buckets of the
document's id, so that a batch reads those buckets only that it touches; every few batches, all states and sums are
folded into a base, which counts from when its list of commits is written.

Layout below root: states/token=T/bucket=B and sums/token=T (T is drawn for each attempt of a batch), commits/batch=ID
(batch_id, batch_no, token), and bases/NO-T with states/bucket=B, sums and commits.
"""

from __future__ import annotations

import base64
import uuid
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm.common import scratch_path
from tracemark.llm.mixing import words

# fixed value: the pre-tokenisation pattern of the byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_SETTING = "tracemark.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # of the registered query, where the setting is absent
BUCKETS, COMPACT_AFTER = 256, 32
MAX_VOCABULARY = 64 << 20
STATE = "doc_id long, live boolean, source string, lang string, n_chars long, tokens array<struct<tokenizer:string,n:bigint>>"
COMMIT = "batch_id string, batch_no long, token string"
_encodings: dict = {}


def _encoding(name: str, data: bytes):
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def vocabulary_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, which the driver reads (by Spark, where the path names a store); its size is checked."""
    if "://" in path:
        data = spark.read.format("binaryFile").load(path).select(F.when(F.col("length") <= MAX_VOCABULARY, F.col("content")).alias("content")).first()["content"]
    else:
        with open(path, "rb") as file:
            data = file.read(MAX_VOCABULARY + 1)
    if data is None or len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    return bytes(data)


def bpe_counter(spark: SparkSession, vocabulary: str):
    """A counter of tokens of a byte-level vocabulary file, which is sent to the executors."""
    held = spark.sparkContext.broadcast(vocabulary_bytes(spark, vocabulary))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary, held.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return lambda text: count(F.coalesce(text.cast("string"), F.lit("")))


def counted(changes: DataFrame, counters: dict) -> DataFrame:
    """One state for each doc_id of changes (doc_id, seq, op, source, lang, text): that of the greatest seq."""
    tokens = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.coalesce(f(F.col("text")), F.lit(0)).cast("long").alias("n")) for v, f in counters.items()])
    rows = changes.select("doc_id", "seq", F.coalesce(F.lower("op") != "delete", F.lit(True)).alias("live"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                          F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), tokens.alias("tokens"))
    best = rows.groupBy("doc_id").agg(F.max(F.struct("seq", "live", "source", "lang", "n_chars", "tokens")).alias("s"))
    return best.select("doc_id", "s.live", "s.source", "s.lang", "s.n_chars", "s.tokens")


class Rollup:
    """Totals of tokens by source, language and tokenizer version, kept up to date by batches.

    An insert of a known document revises it; a revision of an unknown one inserts it; a delete of an unknown one does
    nothing. Of several changes of one document in a batch that of the greatest seq holds (ties: not a delete, then
    the greater source, language and length). Null texts count 0 tokens, null sources and languages are "", a null
    doc_id is a document like others; an empty batch commits and changes nothing; other columns are not read. One writer
    at a time. The number of buckets belongs to root and must not change.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.buckets, self.compact_after = spark, root.rstrip("/"), buckets, compact_after

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _exists(self, path: str) -> bool:
        fs, hadoop_path = self._fs(path)
        return fs.exists(hadoop_path)

    def _delete(self, path: str) -> None:
        fs, hadoop_path = self._fs(path)
        fs.delete(hadoop_path, True)

    def _names(self, path: str) -> list[str]:
        fs, hadoop_path = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []

    def base(self) -> str | None:
        """The folder of the last base that is whole."""
        whole = [n for n in self._names(f"{self.root}/bases") if self._exists(f"{self.root}/bases/{n}/commits/_SUCCESS")]
        return f"{self.root}/bases/{whole[-1]}" if whole else None

    def commits(self) -> dict[str, tuple[int, str]]:
        """(batch_no, token) of every committed batch."""
        paths = [p for p in (f"{self.root}/commits", f"{self.base()}/commits") if self._exists(p)]
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(*paths).collect() if paths else []
        return {r["batch_id"]: (r["batch_no"], r["token"]) for r in rows}

    def _since(self) -> tuple[str | None, int, dict[str, int]]:
        """The base, the number of its last batch, and the batch_no of each later batch by token."""
        base = self.base()
        last = int(base.rsplit("/", 1)[1].split("-")[0]) if base else 0
        return base, last, {token: no for no, token in self.commits().values() if no > last}

    def _read(self, kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the base and of the batches since, with batch_no; of the given buckets."""
        base, last, tokens = self._since()
        found = []
        if base:
            found.append(self.spark.read.schema(schema).parquet(f"{base}/{kind}").withColumn("batch_no", F.lit(last).cast("long")))
        if tokens and self._exists(f"{self.root}/{kind}"):
            # both are columns of the folders: what is not asked for is not read
            rows = self.spark.read.schema(f"{schema}, token string").parquet(f"{self.root}/{kind}").filter(F.col("token").isin(*tokens))
            number = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
            found.append(rows.withColumn("batch_no", number[F.col("token")].cast("long")).drop("token"))
        if not found:
            return self.spark.createDataFrame([], f"{schema}, batch_no long")
        return reduce(DataFrame.unionByName, [x.filter(F.col("bucket").isin(*buckets)) if buckets is not None else x for x in found])

    def states(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest state of every document that any batch names (of the given buckets), but for those deleted before the base."""
        rows = self._read("states", f"{STATE}, bucket int", buckets)
        names = [c for c in rows.columns if c not in ("doc_id", "batch_no")]
        best = rows.groupBy("doc_id").agg(F.max_by(F.struct(*names), "batch_no").alias("s"))
        return best.select("doc_id", *[F.col(f"s.{n}").alias(n) for n in names])

    def apply(self, batch_id: str, changes: DataFrame, counters: dict) -> bool:
        """Commit a batch; False if it is committed already. Runs when it is called."""
        done = self.commits()
        if batch_id in done:
            return False
        token = uuid.uuid4().hex
        states = f"{self.root}/states/token={token}"
        rows = counted(changes, counters).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(states)
        new = self.spark.read.schema(f"{STATE}, bucket int").parquet(states)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        was = self.states(touched).withColumnRenamed("doc_id", "known")
        before = new.select("doc_id").join(was, F.col("doc_id").eqNullSafe(F.col("known"))).drop("known")
        signed = new.filter("live").withColumn("sign", F.lit(1)).unionByName(before.filter("live").withColumn("sign", F.lit(-1)))
        each = signed.select("source", "lang", "sign", "n_chars", F.explode("tokens").alias("t"))
        sums = each.groupBy("source", "lang", F.col("t.tokenizer").alias("tokenizer")).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("t.n")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"))
        sums.write.parquet(f"{self.root}/sums/token={token}")
        number = max((no for no, _ in done.values()), default=0) + 1
        self.spark.createDataFrame([(batch_id, number, token)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={quote(batch_id, safe='')}")
        if len(self._since()[2]) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold the base and the batches since into a new base, and delete what is in it. A stop on the way leaves the
        old base in force, or the new one and files that are not read."""
        done, base = self.commits(), self.base()
        path = f"{self.root}/bases/{max((no for no, _ in done.values()), default=0):012d}-{uuid.uuid4().hex}"
        self.states().filter("live").repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{path}/states")
        self.totals().write.parquet(f"{path}/sums")
        self.spark.createDataFrame([(b, no, t) for b, (no, t) in done.items()], COMMIT).coalesce(1).write.parquet(f"{path}/commits")
        for kind in ("commits", "sums", "states"):
            self._delete(f"{self.root}/{kind}")
        if base:
            self._delete(base)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars); groups without documents are left out."""
        rows = self._read("sums", "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        return rows.groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).filter("n_docs <> 0")


def counters_for(spark: SparkSession, vocabulary: str) -> dict:
    return {"byte_bpe_50k-1": bpe_counter(spark, vocabulary), "words-1": words}


def op10(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Three batches over all documents: all of them inserted; then every tenth deleted and every tenth revised (its
    text twice); and the second once more, as after a lost answer. The totals after it. The vocabulary's path is the
    parameter, else that of the session's setting."""
    spark = docs.sparkSession
    vocabulary = vocabulary or spark.conf.get(VOCABULARY_SETTING, VOCABULARY)
    roll, counters = Rollup(spark, scratch_path(spark, "rollup")), counters_for(spark, vocabulary)
    rows = docs.select("doc_id", F.lit(0).alias("seq"), F.lit("insert").alias("op"), "source", "lang", "text")
    digit = F.pmod("doc_id", F.lit(10))
    second = rows.filter(digit.isin(3, 7)).withColumns({
        "op": F.when(digit == 3, "delete").otherwise("revise"), "text": F.when(digit == 7, F.concat("text", F.lit("\n"), "text"))})
    roll.apply("first", rows, counters)
    roll.apply("second", second, counters)
    roll.apply("second", second, counters)
    return roll.totals()
