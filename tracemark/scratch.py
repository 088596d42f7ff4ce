"""Cut-off points in shared storage, and joins and ranks that need them."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent, a local session gets a temporary folder; a cluster gets an error,
    since its machines would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to shared storage and read it again: lost executors never recompute what is before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":")[-1].strip("/") in path:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """big joined with small, which has one row for a key, on keys without nulls; how is inner, left, left_semi or left_anti.

    Keys that hold more than one row of big in `share` are fewer than `share`: their rows of small are broadcast, so that
    a hot key's rows stay where they are. The others are joined by shuffle. The keys are counted when this is called.
    """
    counts = materialise(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    some = counts.filter(F.col("_n") > max(total // share, 1000)).select(*keys)
    if some.isEmpty():
        return big.join(small, keys, how)
    hot = F.broadcast(some)
    few = F.broadcast(small.join(hot, keys, "left_semi"))
    return big.join(hot, keys, "left_anti").join(small, keys, how).unionByName(big.join(hot, keys, "left_semi").join(few, keys, how))


def with_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with its place from 1 on in an order, without gaps; equal rows of the order have any places among theirs.

    A range partitioning by the order and a sort in each part are written once, with every row's number in its part; the
    places then need the number of rows in the parts before, a list as long as there are parts. No task sees all
    rows. Runs when this is called.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the number of the part is in the upper 31 bits, that of the row in the lower 33
    held = materialise(sorted_rows, "ranked").withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = sorted(map(tuple, held.groupBy("_part").agg(F.max("_at") + 1).collect()))
    ends = list(accumulate(n for _, n in sizes))
    starts = [(part, end - n) for (part, n), end in zip(sizes, ends, strict=True)]
    before = spark.createDataFrame(starts, "_part int, _before long")
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).select(*[c for c in df.columns if c != name], name)
