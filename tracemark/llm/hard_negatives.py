"""Hard-negative mining: for an anchor and each of its positives, the best-scoring rows of other labels in a window of scores.

The score of a row is its inner product with the anchor, in whole numbers. An anchor's positives are the first rows of its label;
a positive with score p has the window low * p <= 100 * score <= high * p, in which the first negatives are asked for.

1. Anchors and rows are dealt over a grid of cells of bounded size, which are scored as blocks.
   Each cell returns an anchor's first positives, and the first of all cells are kept.
2. The upper limits of an anchor's positives split the scores below them into disjoint slots. Each cell returns the first k rows of
   each slot, and a limit by group keeps the first k of all cells, on the map side first.
3. From the lowest slot up, the first k of a slot and of all slots below it are merged: that answers every window with this upper
   limit, whatever the overlap, since rows below a window's lower limit come after those in it and are cut at the end.

Cases: rows without id, label or vector, or with a component that is null or not finite, take no part. Equal scores go by the
smaller id. Repeated rows count once; rows of one id with other contents are rows of their own, but of such anchors the one with the
greatest label and vector is asked for. Vectors of other lengths are filled up with zeros. Scores beyond 64 bits are held at
their ends. An anchor without positives or a positive without negatives gives no row; an empty table gives none. Other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import materialise

ANCHORS, ROWS, LEAST_ROWS = 4096, 16384, 1024  # of a cell at most; rows of a cell at least, where there are more cores than cells
AT_ONCE = 256  # anchors that are scored at once
NONE = -(1 << 63)
FIRST = "anchor_id long, slot int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def limits(positive_scores: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """The least and greatest score of each positive's window."""
    return [-(-low * p // 100) for p in positive_scores], [high * p // 100 for p in positive_scores]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """All inner products, and whether an order by score and place fits 64 bits; where sums can pass what doubles hold
    exactly, they are made of Python's numbers."""
    most = max(a.shape[1], 1) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64), most * len(b) < 2.0**62
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64), False


def first_of(scores: np.ndarray, fits: bool, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the first k wanted scores of every line: greater ones first, of equal ones the smaller place."""
    n = scores.shape[1]
    if fits:
        keys = np.where(wanted, scores * n + (n - 1 - np.arange(n)), NONE)
        if k < n:
            keys = np.partition(keys, n - k, axis=1)[:, n - k:]
        line, at = np.nonzero(keys != NONE)
        return line, n - 1 - keys[line, at] % n
    found = [(i, p) for i in range(len(scores)) for p in sorted(np.flatnonzero(wanted[i]).tolist(), key=lambda p, i=i: (-int(scores[i, p]), p))[:k]]
    return np.array([i for i, _ in found], np.int64), np.array([p for _, p in found], np.int64)


def _cell(k: int, slots):
    """A cell's first k rows of every slot of every anchor. slots: (anchors' table) -> list of (upper, lower) for each slot, arrays over
    anchors, with None for the positives, which have one slot without limits and the anchor's own label."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
            width = max(int(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (anchors, rows))
            vectors, ids, labels = _matrix(rows["v"], width), rows["id"].to_numpy(), rows["label"].to_numpy()
            seen, single = set(), np.ones(len(ids), bool)
            for i in np.flatnonzero((ids[1:] == ids[:-1])):  # repeats of a row are neighbours, and count once
                seen |= {(ids[i], labels[i], vectors[i].tobytes())}
                single[i + 1] = (ids[i + 1], labels[i + 1], vectors[i + 1].tobytes()) not in seen
            vectors, ids, labels = vectors[single], ids[single], labels[single]
            for at in range(0, len(anchors), AT_ONCE):
                part = anchors.slice(at, AT_ONCE)
                anchor, label = part["anchor_id"].to_numpy(), part["label"].to_numpy()
                scores, fits = _scores(_matrix(part["v"], width), vectors)
                same = label[:, None] == labels
                for slot, limit in enumerate(slots(part)):
                    if limit is None:
                        wanted = same & (anchor[:, None] != ids)
                    else:
                        upper, lower = (x[:, None] for x in limit)
                        wanted = ~same & (scores <= upper) & (scores >= lower)
                    line, place = first_of(scores, fits, wanted, k)
                    out.append((anchor[line], np.full(len(line), slot, np.int32), ids[place], scores[line, place]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        return pa.table(dict(zip(("anchor_id", "slot", "id", "score"), map(pa.array, parts), strict=True)))
    return run


def anchor_slots(positive_scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Disjoint slots (upper, lower) of an anchor's scores, from the highest down: each ends where the next begins, and the last one at
    the least score that any window takes."""
    lower, upper = limits(positive_scores, low, high)
    uppers = sorted(set(upper), reverse=True)
    return list(zip(uppers, [max(u + 1, min(lower)) for u in uppers[1:]] + [min(lower)], strict=True))


def _negative_slots(positives: int, low: int, high: int):
    def slots(anchors: pa.Table) -> list:
        held = [anchor_slots([p["score"] for p in ps], low, high) for ps in anchors["positives"].to_pylist()]
        filled = [(s + [(NONE, -NONE - 1)] * positives)[:positives] for s in held]
        return [tuple(np.array([s[j][side] for s in filled], np.int64) for side in (0, 1)) for j in range(positives)]
    return slots


def merged(positives: list[dict], found: list[dict], k: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(positive, rank, negative, positive's score, negative's score) from the first k of every slot, by merging slots from the lowest up."""
    lower, upper = limits([p["score"] for p in positives], low, high)
    by_slot: dict = {}
    for f in found:
        by_slot.setdefault(f["slot"], set()).add((-f["score"], f["id"]))
    best, answers = set(), {}
    uppers = sorted(set(upper), reverse=True)
    for slot in range(len(uppers) - 1, -1, -1):
        best = set(sorted(best | by_slot.get(slot, set()))[:k])
        answers[uppers[slot]] = sorted(best)
    return [(p["id"], rank, i, p["score"], -s) for p, least, most in zip(positives, lower, upper, strict=True)
            for rank, (s, i) in enumerate(answers[most], 1) if -s >= least]


def _merge(k: int, low: int, high: int):
    def run(batches):
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            out = [(r["anchor_id"], *m) for r in batch.to_pylist() for m in merged(r["positives"], r["found"], k, low, high)]
            kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names)
    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   cell: tuple[int, int] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from rows (id, label, vector); is_anchor may use id and label.

    cell: the most anchors and rows of a cell. Runs jobs when called, since the grid needs counts.
    """
    held = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole_numbers(F.col("vector"), scale).alias("v"))
    held = materialise(held.dropna().withColumn("at", F.monotonically_increasing_id()), "vectors")
    best = held.filter(is_anchor).groupBy(F.col("id").alias("anchor_id")).agg(F.max(F.struct("label", "v")).alias("s"))
    anchors = materialise(best.select("anchor_id", "s.label", "s.v"), "anchors")
    n, n_anchors = held.count(), anchors.count()
    most_anchors, most = cell or (ANCHORS, ROWS)
    spread = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS)
    across, down = max(1, math.ceil(n_anchors / most_anchors)), max(1, math.ceil(n / most), spread)
    dealt = held.withColumn("down", F.pmod(F.xxhash64("at"), F.lit(down))).withColumn("across", F.explode(_numbers(across))).drop("at")

    def cells(asked: DataFrame, first: int, slots) -> DataFrame:
        """The first rows of every slot of every anchor: of each cell, and then of all."""
        asked = asked.withColumn("across", F.pmod(F.xxhash64("anchor_id"), F.lit(across))).withColumn("down", F.explode(_numbers(down)))
        by = ("across", "down")
        each = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_cell(first, slots), FIRST)
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
        return each.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= first).dropDuplicates(["anchor_id", "slot", "place"])

    found = cells(anchors, positives, lambda anchors: [None])
    listed = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    asked = materialise(anchors.join(listed, "anchor_id"), "positives")
    negatives = cells(asked, k, _negative_slots(positives, low, high)).groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score", "id")).alias("found"))
    return asked.select("anchor_id", "positives").join(negatives, "anchor_id").mapInArrow(_merge(k, low, high), RESULT)


def op13(embeddings: DataFrame) -> DataFrame:
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


OP13_SQL = """
with q as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
           from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
      from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, id as positive_id, score as positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from pos join p using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
"""
