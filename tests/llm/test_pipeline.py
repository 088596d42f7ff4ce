import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemark.llm import queries

ROOT = Path(__file__).resolve().parent.parent.parent
EN = "the of and that with this from have been were".split()
DE = "der die und das nicht mit eine sich auch nach".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(60):
        ws = EN if i % 2 else DE
        rows.append((i, " ".join(ws[(i * 7 + j * (i + 3) + j * j) % 10] + ("" if j % 4 else f"{chr(97 + i % 26)}{chr(97 + i // 26)}") for j in range(30 + i)), "en" if i % 2 else "de", f"src{i % 3}", 0))
    rows.append((100, rows[5][1], "en", "src0", 0))  # an exact copy
    words = rows[50][1].split()
    rows.append((101, " ".join([*words[:-1], "another"]), "de", "src1", 0))  # a near copy
    item = "which of the many questions in a benchmark would be found again in some other text by its words"
    rows.append((102, f"{rows[7][1][:40]} {item} and so forth", "en", "src2", 0))  # a leak
    rows += [(103, None, "en", "src0", 0), (104, "12 34 !", None, None, None), (105, "", "de", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    df.write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        gone.append(before - after)
        docs = out
    assert gone == [{103, 104, 105}, {100}, {101}, {102}]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= set(range(60))
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out.collect()))


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_names():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.queries()}) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_nothing_else_imports_this_part():
    code = ("import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n"
            "        if name.startswith('tracemark.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'identify_events' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline')")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_run_against_brute_force(spark, sf):
    """Language identification is a trained model, whose rows are taken; all that follows is done again, slowly."""
    from test_counts_mixing_warc import brute_mixture
    from test_dedup_and_joins import brute_components
    from test_text_operators import brute_leaks

    from tracemark.llm.mixing import temperature_weights

    found = corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    least = {}
    for r in found:
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    texts = [(i, t) for t, i in least.items()]
    alone = {i for i, _, c in brute_components(texts, 5, 80, 100) if i == c}
    texts = [(i, t) for i, t in texts if i in alone]
    leaked = {d for d, _ in brute_leaks(texts, bench)}
    source = {r["doc_id"]: r["source"] or "" for r in found}
    rows = [(i, source[i], len(t.split())) for i, t in texts if i not in leaked]
    totals = spark.createDataFrame([(s, sum(n for _, t, n in rows if t == s)) for s in {s for _, s, _ in rows}], "source string, tokens long")
    weights = {r["source"]: r["weight"] for r in temperature_weights(totals, 1.0, 0.9, 4.0).collect()}
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["place"])
    assert [(r["doc_id"], r["epoch"]) for r in got] == brute_mixture(rows, weights)
    assert {r["doc_id"] for r in found} - alone >= {100, 101} and leaked == {102}
