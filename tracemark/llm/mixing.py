"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares of the sources are raised to an exponent and normalised; bisection finds the exponent whose weights meet
a target entropy or a repetition limit. A budget of tokens is then dealt out by the weights: each source's documents
are hashed into blocks, every epoch runs through all blocks in a permutation of its own, and a source ends where its
part of the budget is used up. A document's copy has a place in its source's run, counted in tokens; the mixture puts
the runs of all sources beside each other, so that every stretch of it has the target weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import materialise, with_rank, without

STEPS = 60
MAX_SOURCES = 100_000


def hash_number(*parts) -> Column:
    """48 bits of an MD5 as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 12), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return, a stand-in for tokens; null text has none."""
    bare = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def temperature_weights(totals: DataFrame, budget: float = 1.0, target_entropy: float | None = None,
                        max_repeats: float | None = None, steps: int = STEPS) -> DataFrame:
    """totals (source, tokens) with alpha and weight.

    The exponent lies in 0 (all sources alike) to 1 (as they are). With target_entropy, a share of the entropy of
    equal weights, it is the largest exponent whose entropy reaches the target; with max_repeats, the smallest whose
    sources all fit in max_repeats runs through their tokens for budget times all tokens; with both, the larger of the
    two, since a limit binds and a target does not. If even exponent 1 repeats more, it stays 1. Sources without
    tokens have weight 0. The totals of all sources are held in one row; more than MAX_SOURCES raise an error.
    """
    if target_entropy is None and max_repeats is None:
        raise ValueError("give target_entropy, max_repeats or both")
    live = totals.filter("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"))
    live = live.withColumn("s", F.when(F.size("s") <= MAX_SOURCES, F.col("s")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")).cast("array<struct<source:string,tokens:bigint>>")))

    def total(xs, f):
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))

    share = F.transform("s", lambda x: x["tokens"].cast("double"))
    live = live.withColumn("all", total(share, lambda x: x)).withColumn("p", F.transform(share, lambda x: x / F.col("all")))

    def reached(alpha: Column, kind: str) -> Column:
        z = total(F.col("p"), lambda x: F.pow(x, alpha))
        if kind == "entropy":  # of weights x^a / z: ln z - a * sum(x^a ln x) / z
            h = F.log(z) - alpha * total(F.col("p"), lambda x: F.pow(x, alpha) * F.log(x)) / z
            return h >= target_entropy * F.log(F.size("p").cast("double"))
        # repeats of a source: budget * x^a / z / x, most for the smallest source
        least = F.array_min("p")
        return budget * F.pow(least, alpha) / z / least > max_repeats

    def bisect(kind: str) -> Column:
        """Both conditions hold for small exponents and then no longer; the border between."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(acc, _):
            mid = (acc["lo"] + acc["hi"]) / 2
            yes = reached(mid, kind)
            return F.struct(F.when(yes, mid).otherwise(acc["lo"]).alias("lo"), F.when(yes, acc["hi"]).otherwise(mid).alias("hi"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
        return F.when(reached(F.lit(1.0), kind), 1.0).otherwise(found["lo" if kind == "entropy" else "hi"])

    found = [bisect(k) for k, given in (("entropy", target_entropy), ("repeats", max_repeats)) if given is not None]
    solved = live.withColumn("alpha", F.when(F.size("s") == 0, 1.0).otherwise(F.greatest(*found) if len(found) > 1 else found[0]))
    solved = solved.withColumn("w", F.transform("p", lambda x: F.pow(x, F.col("alpha")))).withColumn("z", total(F.col("w"), lambda x: x))
    rows = solved.select("alpha", "z", F.explode(F.arrays_zip("s", "w")).alias("x")).select(
        F.col("x.s.source").alias("source"), "alpha", (F.col("x.w") / F.col("z")).alias("weight"))
    return (totals.join(rows, totals["source"].eqNullSafe(rows["source"]), "left").drop(rows["source"])
            .fillna({"weight": 0.0}))


def _dealt(rows: DataFrame, seed: str, budget: float, target_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """rows (_row, _src, _id, n) once for each copy in the mixture, with block, weight, epoch and place.

    A source of n rows has blocks of about the root of n rows, in as many blocks, so that neither the blocks of a source
    nor the rows of a block are more than that in one group.
    """
    totals = materialise(rows.groupBy(F.col("_src").alias("source")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "totals")
    everything = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("everything"))
    plan = temperature_weights(totals, budget, target_entropy, max_repeats).crossJoin(F.broadcast(everything)).select(
        F.col("source").alias("_src"), "weight", "tokens", F.ceil(F.sqrt("docs")).cast("long").alias("n_blocks"),
        F.floor(F.col("weight") * F.col("everything") * budget).cast("long").alias("due"))
    plan = F.broadcast(materialise(plan, "weights"))  # no more rows than MAX_SOURCES, which is checked
    rows = rows.join(plan.select("_src", "n_blocks"), "_src").withColumn("block", F.pmod(hash_number(F.lit(seed), F.lit("block"), F.col("_src"), F.col("_id")), F.col("n_blocks")))
    runs = rows.groupBy("_src", "block").agg(F.sum("n").alias("t")).join(plan, "_src")
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.ceil(F.col("due") / F.col("tokens")).cast("long"), F.lit(1))).otherwise(1)
    runs = runs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    runs = runs.withColumn("turn", hash_number(F.lit(seed), F.lit("epoch"), F.col("epoch"), F.col("_src"), F.col("block")))
    blocks = Window.partitionBy("_src", "epoch").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("ahead", F.col("epoch") * F.col("tokens") + F.sum("t").over(blocks) - F.col("t"))
    within = Window.partitionBy("_src", "block").orderBy("nth", "_id", "n", "_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", hash_number(F.lit(seed), F.lit("row"), F.col("_src"), F.col("_id"))).withColumn("upto", F.sum("n").over(within))
    copies = rows.drop("n_blocks").join(runs.select("_src", "block", "weight", "due", "epoch", "turn", "ahead"), ["_src", "block"]).filter(F.col("ahead") + F.col("upto") <= F.col("due"))
    copies = copies.withColumn("at", F.when(F.col("due") > 0, (F.col("ahead") + F.col("upto") - F.col("n")) / F.col("due")).otherwise(0.0))
    return with_rank(copies, ["at", "_src", "epoch", "turn", "block", "nth", "_id", "n", "_row"], "place").select(
        "_row", F.col("n").alias("n_tokens"), "block", "weight", "epoch", "place")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix",
            budget: float = 1.0, target_entropy: float | None = 0.9, max_repeats: float | None = 4.0, tokens: Column | None = None) -> DataFrame:
    """A row of df for each of its copies in the mixture, with n_tokens, block, weight (of its source), epoch and place.

    place is a whole number from 1 on, without gaps, that no two rows share; rows in the order of place are the mixture.
    budget is in all the tokens of df, which are the words of text_col or, where they are counted already, tokens, a
    non-null column of whole numbers. A null source is the source "". A copy is in the mixture if its source's run,
    whole epochs and then blocks of the next, has reached its end within the source's part of the budget; so rows without
    tokens go with their neighbours. Ties of hashes fall to the smaller id (null is ""), then the fewer tokens. Rows that
    repeat an id lie beside each other in a block. Rows without a place are those that the budget has no room for. An
    empty table gives an empty table. Own columns replace columns of the same names. Runs when this is called.
    """
    counted = df.withColumn("_n", words(F.col(text_col)) if tokens is None else tokens.cast("long"))
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    held = counted.withColumns({"_src": key, "_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_row": F.monotonically_increasing_id()})
    held = materialise(held, "counted")
    dealt = _dealt(held.select("_row", "_src", "_id", F.col("_n").alias("n")), seed, budget, target_entropy, max_repeats)
    names = without(df, "n_tokens", "block", "weight", "epoch", "place", "_n", "_src", "_id", "_row").columns
    return held.select("_row", *names).join(dealt, "_row").select(*names, "n_tokens", "block", "weight", "epoch", "place")


def op8(docs: DataFrame) -> DataFrame:
    counted = docs.select("doc_id", "source", words(F.col("text")).alias("n"))
    return mixture(counted, tokens=F.col("n")).select("doc_id", "source", "n_tokens", "block", F.round("weight", 9).alias("weight"), "epoch", "place")


def _sql() -> str:
    number = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT)"
    z = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
    h = f"(ln({z}) - {{a}} * list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(x))) / {z} >= 0.9 * ln(len(p)))"
    r = f"(pow(list_min(p), {{a}}) / {z} / list_min(p) > 4.0)"
    mid_e, mid_r = "((elo + ehi) / 2)", "((rlo + rhi) / 2)"
    he, rr, h1, r1 = h.format(a=mid_e), r.format(a=mid_r), h.format(a="1.0"), r.format(a="1.0")
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
tot AS (SELECT src, CAST(sum(n) AS BIGINT) AS tokens, CAST(ceil(sqrt(count(*))) AS BIGINT) AS nb FROM d GROUP BY 1),
k AS (SELECT d.*, {number.format("'mix|block|' || src || '|' || id")} % nb AS block, {number.format("'mix|row|' || src || '|' || id")} AS nth FROM d JOIN tot USING (src)),
held AS (SELECT src, block, CAST(sum(n) AS BIGINT) AS t FROM k GROUP BY 1, 2),
one AS (SELECT list(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM tot) ORDER BY src) AS p FROM tot WHERE tokens > 0),
b AS (SELECT 0 AS i, p, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi FROM one
  UNION ALL SELECT i + 1, p, CASE WHEN {he} THEN {mid_e} ELSE elo END, CASE WHEN {he} THEN ehi ELSE {mid_e} END,
                   CASE WHEN {rr} THEN {mid_r} ELSE rlo END, CASE WHEN {rr} THEN rhi ELSE {mid_r} END FROM b WHERE i < {STEPS}),
al AS (SELECT p, greatest(CASE WHEN {h1} THEN 1.0 ELSE elo END, CASE WHEN {r1} THEN 1.0 ELSE rhi END) AS a FROM b WHERE i = {STEPS}),
wt AS (SELECT src, tokens, coalesce(CASE WHEN tokens > 0 THEN (SELECT pow(tokens / (SELECT sum(tokens)::DOUBLE FROM tot), a) / {z.format(a="a")} FROM al) END, 0) AS weight FROM tot),
du AS (SELECT *, CAST(floor(weight * (SELECT sum(tokens) FROM tot)) AS BIGINT) AS due FROM wt),
ep AS (SELECT *, unnest(range(CASE WHEN tokens > 0 THEN greatest((due + tokens - 1) // tokens, 1) ELSE 1 END)) AS epoch FROM du),
ru AS (SELECT h.src, h.block, h.t, weight, due, epoch, tokens, {number.format("'mix|epoch|' || epoch || '|' || h.src || '|' || h.block")} AS turn FROM held h JOIN ep USING (src)),
ah AS (SELECT *, epoch * tokens - t + sum(t) OVER (PARTITION BY src, epoch ORDER BY turn, block ROWS UNBOUNDED PRECEDING) AS ahead FROM ru),
kw AS (SELECT *, sum(n) OVER (PARTITION BY src, block ORDER BY nth, id, n ROWS UNBOUNDED PRECEDING) AS upto FROM k),
co AS (SELECT k.doc_id, k.source, k.src, k.id, k.n, k.nth, k.block, weight, epoch, turn,
         CASE WHEN due > 0 THEN CAST(ahead + upto - n AS DOUBLE) / due ELSE 0.0 END AS at_
       FROM kw k JOIN ah ON ah.src = k.src AND ah.block = k.block WHERE ahead + upto <= due)
SELECT doc_id, source, n AS n_tokens, block, round(weight, 9) AS weight, epoch, CAST(row_number() OVER (ORDER BY at_, src, epoch, turn, block, nth, id, n) AS BIGINT) AS place FROM co
"""


OP8_SQL = _sql()
