"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts by a bounded prefix and the content's hash, so that the splitters
that reach the driver stay short, texts with a common beginning spread, and equal texts meet in one partition. An
external sort places equal texts side by side, and comparing each with its neighbour in full decides what is equal.
A text that is counted to have more rows than a partition should hold is dealt over several; their runs, one row of
each partition, are sorted and compared in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import materialise, without

PREFIX = 64
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def normalise(text: Column, how: str = "none") -> Column:
    """Null counts as the empty text. how: none, or "space" (runs of white space become one space, trimmed)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if how == "none":
        return text
    if how == "space":
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    raise ValueError(f"unknown normalisation {how!r}")


def _runs(rows: DataFrame, best, *salt: str) -> DataFrame:
    """rows (_head, _hash, _body, _id and others) in sorted runs of equal bodies, with _run, _first (whether a row begins
    a run), and of the run _keep, _n and _sha."""
    place = ["_head", "_hash", *salt]
    # these hold the range keys, so that the windows need no further shuffle
    ranged = rows.repartitionByRange(*place).sortWithinPartitions(*place, "_body", "_id")
    in_order = Window.partitionBy(*place).orderBy("_body", "_id")
    before = F.lag("_body").over(in_order)
    told = ranged.withColumn("_first", before.isNull() | (before != F.col("_body")))
    told = told.withColumns({"_run": F.sum(F.col("_first").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
                             "_own": F.when(F.col("_first"), F.sha2("_body", 256))})
    run = Window.partitionBy(*place, "_run")
    return told.withColumns({"_keep": best("_id").over(run), "_n": F.count(F.lit(1)).over(run), "_sha": F.max("_own").over(run)}).drop("_own")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "none",
                keep: str = "min", partition_rows: int | None = None) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256 (of the normalised text) for every row.

    keep: min or max, of the ids. A row is kept if its id is the survivor's. Rows that repeat an id with one text are all
    kept; null text counts as empty; null ids count in group_size, and a null id is never kept beside a row that has one.
    A text with more than partition_rows rows (by default, the rows by the number of shuffle partitions) is split by the
    ids of its rows. An empty table gives an empty table. Columns of df with the names of the new ones give way to
    them. The count of rows by content runs when this is called, and so does the sort of such texts where there are any.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    best = F.min if keep == "min" else F.max
    df = without(df, *OWN, "_id", "_body", "_null", "_head", "_hash", "_salt", "_parts", "_first", "_run", "_keep", "_n", "_sha")
    names = df.columns
    body = normalise(F.col(text_col), how)
    rows = df.withColumns({"_id": F.col(id_col), "_body": body, "_head": F.substring(body, 1, PREFIX), "_hash": F.xxhash64(body)})
    back = F.col(text_col)
    if how == "none" and df.schema[text_col].dataType.typeName() == "string":  # one copy of the text is enough
        rows = rows.withColumn("_null", F.col(text_col).isNull()).drop(text_col)
        back = F.when(~F.col("_null"), F.col("_body"))
    counts = materialise(df.select(F.xxhash64(body).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")), "content-counts")
    fair = partition_rows or max(1, (counts.agg(F.sum("_rows")).first()[0] or 0) // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # fewer than there are partitions
    hot = counts.filter(F.col("_rows") > fair).select("_hash", F.ceil(F.col("_rows") / fair).alias("_parts"))

    def shown(runs: DataFrame, keep_id: str, size: str, sha: str) -> DataFrame:
        own = [F.col(keep_id).alias("keep_id"), F.col(size).alias("group_size"), F.col("_id").eqNullSafe(F.col(keep_id)).alias("kept"), F.col(sha).alias("text_sha256")]
        return runs.select(*[back.alias(c) if c == text_col else F.col(c) for c in names], *own)

    if hot.isEmpty():
        return shown(_runs(rows, best), "_keep", "_n", "_sha")
    some = F.broadcast(hot)
    cold = shown(_runs(rows.join(some, "_hash", "left_anti"), best), "_keep", "_n", "_sha")
    dealt = rows.join(some, "_hash").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")
    dealt = materialise(_runs(dealt, best, "_salt"), "dealt")
    # a row of each run: about as many as there are partitions
    tops = dealt.filter("_first").select("_head", "_hash", "_body", F.col("_keep").alias("_id"), F.struct("_salt", "_run").alias("_of"), F.col("_n").alias("_rows"))
    whole = _runs(tops, best)
    whole = whole.withColumn("_total", F.sum("_rows").over(Window.partitionBy("_head", "_hash", "_run")))
    whole = whole.select(F.col("_hash").alias("_h"), F.col("_of._salt").alias("_s"), F.col("_of._run").alias("_r"), F.col("_keep").alias("_all"), "_total")
    joined = dealt.join(F.broadcast(whole), (F.col("_hash") == F.col("_h")) & (F.col("_salt") == F.col("_s")) & (F.col("_run") == F.col("_r")))
    return cold.unionByName(shown(joined, "_all", "_total", "_sha"))


def op5(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text"), keep="max").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
