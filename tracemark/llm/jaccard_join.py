"""N-gram Jaccard join by a token-group matrix: an exact self-join of documents' shingle sets, down to components.

1. Equal sets fold to one class, whose representative is the smallest id.
2. A class emits one key for each part of a partition of its tokens. A linked pair differs in fewer tokens than there
   are non-empty parts, so it has a known number of parts in common (a set for which that cannot be said emits one more,
   shared key): classes with fewer common keys need never meet. Sizes are in bands, so that both sides use one number
   of parts. Classes that share too few keys with all others together are left out, twice over.
3. Similar classes form groups: a class joins the smallest id with which it shares a key. The other groups in which
   it finds enough of its keys are the groups that it queries.
4. Every member is compared with its group's leader, once and exactly. Those that link with it are one component and need not meet
   each other; only the rest of the group asks the group as other groups' queries do. So a group of near copies costs as much as
   it has members.
5. A group that is asked is stored in blocks of a bounded number of tokens. For each block and each block of queries, the union of
   the block's tokens bounds a query's overlap with any member; only a query that the bound lets through is compared
   with the members.
6. Links, at most one for each class and block, go to connected components.

No pairs of a group are emitted, no group is gathered in one task, and nothing but counts goes to the driver.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.llm.common import discard, join_hot, materialise
from tracemark.llm.shingles import STEP, U, mix, shingle_set, signature

BLOCK_TOKENS = 150_000
BROADCAST_IDS = 2_000_000


class Bands:
    """Bands of set sizes and the parts of each; a linked pair's bands are at most one apart."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.parts = num, den, [0, 1], {}

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return bisect.bisect_right(self.low, n) - 1

    def most(self, slot: int) -> int:
        """The most tokens in which a linked pair of the bands slot - 1 and slot differs."""
        while slot + 1 >= len(self.low):
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return 2 * (self.low[slot + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def count(self, slot: int) -> int:
        """So many parts that, for nearly every set of the slot, a good deal more than most(slot) are non-empty."""
        if slot not in self.parts:
            d, n = self.most(slot), max(1, self.low[max(1, slot - 1)])
            k = d + 1
            while k < 3 * n + d:
                q = math.exp(-n / k)
                full, spread = k * (1 - q), math.sqrt(max(0.0, k * q * (1 - q * (1 + n / k))))
                if full - 3 * spread >= 1.15 * d + 2:
                    break
                k += max(1, k // 50)
            self.parts[slot] = k
        return self.parts[slot]

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and for each a tag that tells a set's two slots apart and says how many keys of the slot a linked set
        has in common with this one at least: tag // 2."""
        out, tags, own = [], [], self.band(len(tokens))
        for slot in (own, own + 1):
            d = self.most(slot)
            if not d:
                continue  # only equal sets link here, and those are one class
            k = self.count(slot)
            with np.errstate(over="ignore"):
                seed = U(slot * 0x632BE59BD9B4E019 % 2**64)
                h = mix(tokens ^ seed)
                part = ((h >> U(32)) * U(k) >> U(32)).astype(np.int64)
                sums = np.zeros(k, U)
                np.add.at(sums, part, mix(h + STEP))
                full = np.flatnonzero(np.bincount(part, minlength=k))
                out.append(mix(sums[full] + mix(full.astype(U) * STEP + seed)))
                if len(full) <= d:
                    out.append(mix(np.array([seed], U) + U(1)))
                tags.append(np.full(sum(map(len, out)) - sum(map(len, tags)), 2 * max(1, len(full) - d) + slot - own, np.int32))
        return (np.concatenate(out), np.concatenate(tags)) if out else (np.empty(0, U), np.empty(0, np.int32))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield batch.column(0), batch.column(1).to_pylist()


def _signatures(words: int):
    def run(batches):
        for ids, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            signs = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in signs], pa.int64()),
                 pa.array([b for _, b in signs], pa.int64())], ["id", "n", "s1", "s2"])
    return run


def _keys(words: int, num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for ids, texts in _texts(batches):
            held, size = [], 0
            for i, t in zip(ids.to_pylist(), texts, strict=True):
                if len(s := shingle_set(t, words)):
                    keys, tags = bands.keys(s)
                    held.append((keys.view(np.int64), np.full(len(keys), i, np.int64), tags))
                    size += len(keys)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["key", "id", "tag"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["key", "id", "tag"])
    return run


def _tokens(words: int):
    def run(batches):
        for ids, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())], ["id", "tokens"])
    return run


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets link."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return den * both >= num * (len(a) + len(b) - both)


def _leaders(num: int, den: int):
    """Rows come sorted by block of a group, its leader first: members that link with the leader, one at a time."""
    def run(batches):
        now, leader, lead = None, np.empty(0, U), -1
        for batch in batches:
            found = []
            for g, b, is_member, i, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not is_member:
                    now, leader, lead = (g, b), np.frombuffer(tokens, U), i
                elif now == (g, b) and linked(leader, np.frombuffer(tokens, U), num, den):
                    found.append((i, lead))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def compare(ids: list[int], sets: list[np.ndarray], query: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links within one tile as (id, smallest id that it reaches here), by asking the members for each query."""
    members = [i for i, q in enumerate(query) if not q]
    asking = [i for i, q in enumerate(query) if q]
    if not members or not asking:
        return []
    flat = np.concatenate([sets[i] for i in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(sets[i]) for i in members])
    root = list(range(len(ids)))
    for i in asking:
        q = sets[i]
        lo, hi = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
        # the bound: tokens of the query in the union of the block's sets
        if den * int(np.count_nonzero(hi > lo)) < num * len(q):
            continue
        width = hi - lo
        spots = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
        both = np.bincount(owner[spots], minlength=len(members))
        for m in np.flatnonzero(den * both >= num * (len(q) + sizes - both)):
            a, b = _find(root, i), _find(root, members[m])
            if a != b:
                root[max(a, b, key=lambda x: (ids[x], x))] = min(a, b, key=lambda x: (ids[x], x))
    return [(ids[i], ids[r]) for i in range(len(ids)) if ids[r := _find(root, i)] != ids[i]]


def _tiles(num: int, den: int):
    """Rows come sorted by tile; a tile's rows are gathered over batches and compared when it ends."""
    def run(batches):
        now, rows, out = None, [], []

        def close():
            if rows:
                out.extend(compare([r[0] for r in rows], [np.frombuffer(r[1], U) for r in rows], [r[2] for r in rows], num, den))

        for batch in batches:
            for *tile, query, i, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tuple(tile) != now:
                    close()
                    now, rows = tuple(tile), []
                rows.append((i, tokens, query))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b), root the smallest id that it reaches, by alternate large and small
    stars: each round ties neighbours to the smallest of them. Sums by node combine on the map side, so that a node
    with very many links is no large task; each round is written, and the one before deleted."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.join(least, "u")
        if large:
            return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        return (tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())

    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, edges
        edges = materialise(star(star(edges, large=True), large=False), "stars")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs (id, text) by a list of ids, which is sent to every executor if it is counted to be small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys (key, id, tag) whose key more than one id has, with lead, the smallest of them; written."""
    by_key = Window.partitionBy("key")
    rows = keys.withColumns({"lead": F.min("id").over(by_key), "last": F.max("id").over(by_key)})
    return materialise(rows.filter("lead < last").select("key", "id", "tag", "lead"), "shared")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       threshold: tuple[int, int] = (80, 100), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of df.

    Two documents link when threshold[1] * intersection >= threshold[0] * union of their sets of distinct shingles
    of `words` words (of fewer words: the whole sequence as one). component_id is the smallest id reachable by links.
    A null text, one without words, and a row with a null id link with nothing; their component is their own id.
    Rows that share an id are one document for links. An empty table gives an empty table; other columns are not read.
    """
    num, den = threshold
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_signatures(words), "id long, n long, s1 long, s2 long"), "signatures")
    classes = signed.filter("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    # one text may be a large part of all rows
    members = materialise(join_hot(signed, classes, ["n", "s1", "s2"], "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")).alias("rep")), "members")
    discard(signed)

    copies = (members.filter("n > 0 and id is not null").groupBy("id")
              .agg(F.bool_or(F.col("id") == F.col("rep")).alias("first")).filter("not first").select("id"))
    named = docs.filter("id is not null and text is not null")
    keys = _only(named, copies, "left_anti").mapInArrow(_keys(words, num, den), "key long, id long, tag int")
    shared = _shared(keys)
    for _ in range(2):
        enough = F.count(F.lit(1)).over(Window.partitionBy("id", "tag")) >= F.floor(F.col("tag") / 2)
        before, shared = shared, _shared(shared.select("key", "id", "tag", enough.alias("enough")).filter("enough").select("key", "id", "tag"))
        discard(before)

    joined = shared.groupBy("id").agg(F.min("lead").alias("g"))
    sizes = members.filter("id = rep").groupBy("id").agg(F.max("n").alias("n"))
    grouped = materialise(joined.join(sizes, "id"), "groups")  # id, g, n
    touched = shared.select("key", "id", "tag").join(grouped.select("id", "g"), "id")
    mixed = touched.groupBy("key").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).filter("g1 < g2").select("key")
    touched = materialise(touched.join(mixed, "key", "left_semi"), "touched")
    # (a query's keys are counted in each group of smaller name, whose turn it is to be asked)
    queries = (touched.alias("q").join(touched.select("key", "g").distinct().alias("m"), "key").filter("m.g < q.g")
               .groupBy(F.col("q.id").alias("id"), F.col("q.tag").alias("tag"), F.col("m.g").alias("g")).agg(F.count(F.lit(1)).alias("found"))
               .filter(F.col("found") >= F.floor(F.col("tag") / 2)).select("id", "g").distinct())
    queries = materialise(queries.join(grouped.select("id", "n"), "id"), "queries")
    discard(touched)
    discard(shared)

    # every member meets its leader, in blocks of the group that each have a copy of the leader
    sets = materialise(_only(named, grouped.select("id"), "left_semi").mapInArrow(_tokens(words), "id long, tokens binary"), "tokens")
    block = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    sized = grouped.groupBy("g").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("nb"))
    own = grouped.join(sized, "g").withColumn("b", block)
    led = own.filter("id <> g").select("g", "b", F.lit(True).alias("is_member"), "id")
    leads = sized.select("g", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(False).alias("is_member"), F.col("g").alias("id"))
    met = leads.unionByName(led).join(sets, "id").select("g", "b", "is_member", "id", "tokens").repartition("g", "b").sortWithinPartitions("g", "b", "is_member")
    by_leader = materialise(met.mapInArrow(_leaders(num, den), "a long, b long"), "leader-links")
    rest = own.filter("id <> g").join(by_leader.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", "g", "n")

    # a tile (i, j) has block i of a group's members and block j of those that ask it: its own rest, and queries from other groups
    queries = queries.select("id", "g", "n").unionByName(rest)
    asked_by = queries.groupBy("g").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("nq"))
    asked = own.join(asked_by, "g").select("g", F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), F.lit(False).alias("query"), "id")
    asking = queries.join(sized, "g").join(asked_by, "g").withColumn("j", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int")).select(
        "g", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), "j", F.lit(True).alias("query"), "id")
    tiles = (asked.unionByName(asking).join(sets, "id")
             .select("g", "i", "j", "query", "id", "tokens").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j"))
    links = tiles.mapInArrow(_tiles(num, den), "a long, b long").unionByName(by_leader)
    # the classes of one id are one document's
    several = members.filter("n > 0 and id is not null").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b < last")
    links = links.unionByName(members.filter("n > 0").join(several.select("id", "b"), "id").select(F.col("rep").alias("a"), "b"))
    roots = components(links)
    return members.join(roots, members["rep"] == roots["node"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def jaccard_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of df, one document of each component: that with the smallest id. Rows with a null id all stay."""
    found = jaccard_components(df, id_col, text_col, **how)
    stay = found.filter("id = component_id").select(F.col("id").alias("__id")).distinct()
    held = df.join(stay, df[id_col].cast("long") == F.col("__id"), "left_semi")
    return held.unionByName(df.filter(F.col(id_col).isNull()))


def op3(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, words=3, threshold=(90, 100)).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = w.doc_id
"""
