from pyspark.sql import functions as F

from tracemark.operators import evaluation as E
from tracemark.schemas import EVAL_RECORDS


def record(kind, condition, clip_s, best, aligned, confidence, split="test", true=1, offset=1.0, start=0.95):
    true = true if kind == "positive" else None
    return (kind, "t", split, condition, clip_s, true, start, best, aligned, 1, confidence, offset, 10, 20, 1.0, 2.0, float(clip_s))


def records(spark):
    return spark.createDataFrame([
        record("positive", "clean", 5, 1, 20, 0.9), record("positive", "clean", 10, 1, 20, 0.5), record("positive", "noise", 5, 2, 20, 0.9), record("positive", "noise", 10, 1, 4, 0.9),
        record("negative", "clean", 5, 7, 9, 0.2, "calibration"), record("negative", "noise", 5, 7, 4, 0.7, "calibration"),
        record("negative", "clean", 5, 8, 9, 0.3), record("negative", "noise", 10, None, 0, 0.0)], EVAL_RECORDS)


def test_calibration(spark):
    r = records(spark)
    assert E.calibrate(r).first()[0] == 0.21
    assert E.calibrate(r.filter("kind = 'positive'")).first()[0] == 0.0
    assert E.calibrate(r.withColumn("confidence", F.lit(1.0))).first()[0] == 1.0


def test_metrics(spark):
    r = records(spark)
    rows = E.judged(r, E.calibrate(r))
    acc = {x["condition"]: x.asDict() for x in E.accuracy(rows, (5, 10)).collect()}
    assert acc["clean"]["5_top1"] == 1 and acc["noise"]["5_top1"] == 0 and acc["noise"]["10_top1"] == 0 and acc["noise"]["10_raw_top1"] == 1
    fp = {(x["condition"], x["clip_s"]): (x["n"], x["n_wrong"]) for x in E.false_positives(rows).collect()}
    assert fp == {("clean", 5): (1, 1), ("noise", 10): (1, 0), (None, None): (2, 1)}
    sweep = {x["t"]: (x["chosen"], x["accuracy"], x["fpr"]) for x in E.threshold_sweep(r, E.calibrate(r)).collect()}
    assert len(sweep) == 9 and sweep[0.21] == (True, 0.5, 0.25) and sweep[0.0] == (False, 0.5, 0.5) and sweep[0.5] == (False, 0.5, 0.0)
    err = E.offset_error(rows).first()
    assert err["n"] == 2 and abs(err["median_s"] - 0.05) < 1e-9 and err["within_100ms"] == 1
    lat = {x["clip_s"]: x for x in E.latency(r).collect()}
    assert lat[5]["mean_ms"] == 8 and lat[10]["p95_ms"] == 13 and lat[5]["db_hits"] == 20
    assert [x[0] for x in E.clip_lengths(r).collect()] == [5, 10]


def test_empty_records(spark):
    r = records(spark).limit(0)
    rows = E.judged(r, E.calibrate(r))
    assert E.offset_error(rows).first()["n"] == 0 and E.false_positives(rows).isEmpty()


def test_holdout(spark):
    files = spark.createDataFrame([(f"/h/{i:06d}.mp3", f"h{i}") for i in range(6)], "path string, content_hash string")
    split = E.split_holdout(files)
    rest, n = E.guard_holdout(split, spark.createDataFrame([("h0",)], "content_hash string"))
    kept, out = E.exclude(rest, spark.createDataFrame([(3, "7", "the same")], "track_id long, library_id string, reason string"))
    assert n.first()[0] == 1 and [r[0] for r in out.collect()] == ["000003: the same"]
    # places were counted before the drops
    assert {(r["track_id"], r["split"]) for r in kept.collect()} == {(1, "test"), (2, "calibration"), (4, "calibration"), (5, "test")}


def test_query_grid(spark):
    sources = spark.createDataFrame([(1, 30.0), (2, 5.4), (3, 10.5)], "song_id long, duration_s double")
    got = E.query_grid(sources).collect()
    assert {(r["song_id"], r["clip_s"]) for r in got} == {(1, 5), (1, 10), (3, 5), (3, 10)}
    assert all(0 <= r["start_s"] <= r["duration_s"] - r["clip_s"] for r in got)
    clips = spark.createDataFrame([(100, 1, [float(i) for i in range(300)], 1.0)], "sample_rate int, clip_s int, samples array<float>, start_s double")
    cut = E.cut_clips(clips).first()["samples"]
    assert len(cut) == 100 and cut[0] == 100.0


def test_report(spark, tmp_path):
    text = E.write_report(records(spark), str(tmp_path / "r"))
    assert "Top-1 accuracy" in text and spark.read.json(str(tmp_path / "r/records")).count() == 8
    assert E.index_size(spark.range(10), spark.range(4)).first()["rows_per_song"] == 2.5
