import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemark.operators import evaluation as E
from tracemark.operators.quantiles import ordered_bits, percentiles

SHARES = {"low": 0.0, "a": 0.1, "mid": 0.5, "high": 0.95, "top": 1.0}


def test_against_numpy(spark):
    rng = random.Random(2)
    groups = {"ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(500)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(401)],
              "near": [1.0 + k * 2.0**-52 for k in range(97)], "one": [7.5], "zeros": [0.0, -0.0, 0.0, -1e-320, 5e-324], None: [rng.gauss(0, 1) for _ in range(300)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: [r[c] for c in SHARES] for r in percentiles(df, ["g"], F.col("v"), SHARES).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, list(SHARES.values())), rtol=1e-15, atol=0), g


def test_order_of_bits(spark):
    values = [float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1e-3, 1.5, 1e308, float("inf"), float("nan")]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(v,) for v in values], "v double").select(ordered_bits("v")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_plans_hold_no_percentile_buffer(spark):
    rows = spark.createDataFrame([(5, 1.0, 2.0, 3.0, 4, 5), (None, 1.0, 2.0, 5.0, 4, 5)], "clip_s int, t_fingerprint_ms double, t_lookup_ms double, t_score_ms double, query_hashes int, db_hits int")
    out = E.latency(rows)
    assert "percentile" not in out._jdf.queryExecution().toString() and {(r["clip_s"], r["p50_ms"]) for r in out.collect()} == {(5, 6.0), (None, 8.0)}
    none = spark.createDataFrame([], "kind string, correct boolean, offset_s double, true_start_s double")
    assert [tuple(r) for r in E.offset_error(none).collect()] == [(None, None, None, 0)]


SMALL_HEAP = """
from pyspark.sql import SparkSession, functions as F
from tracemark.operators.quantiles import percentiles
s = (SparkSession.builder.master("local[2]").config("spark.driver.memory", "600m").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate())
n = 10_000_001
rows = s.range(0, n, 1, 8).select((F.pmod(F.col("id") * 7919, F.lit(n)) * 0.25 - 3).alias("v"))
r = percentiles(rows, [], F.col("v"), {"mid": 0.5, "high": 0.95}).first()
assert tuple(r) == (5_000_000 * 0.25 - 3, 9_500_000 * 0.25 - 3), r
"""


def test_ten_million_distinct_values_in_a_small_heap():
    done = subprocess.run([sys.executable, "-c", SMALL_HEAP], capture_output=True, text=True, timeout=600, cwd=Path(__file__).resolve().parent.parent)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_rows(spark):
    assert percentiles(spark.createDataFrame([], "g string, v double"), ["g"], F.col("v"), {"m": 0.5}).collect() == []
    with pytest.raises(Exception):
        percentiles(spark.createDataFrame([("a", "x")], "g string, v string"), ["g"], F.col("v"), {"m": 0.5}).collect()
