"""Substring dedup: words of passages that an earlier document has too are removed.

Words are runs of other characters than space and tab to carriage return, unchanged. Every window of `window` words of
every whole text gets a Rabin-Karp hash (a polynomial over its words' hashes). A window counts as repeated in a document if its
word sequence also starts in a document with a smaller id; windows are judged on the input. The repeated windows of a
document merge into maximal intervals of words, which are removed.

1. Documents are read in blocks of bounded size. Within a block, each hash goes to the document with the smallest id;
   for the block's other documents it is a repeat already.
2. Hashes are dealt by their upper bits over buckets, packed by block; a bucket's size is bounded as their number grows with
   the corpus. A bucket finds each hash's smallest document of all blocks. A window that very many
   documents share is one entry of a block, not one of a document.
3. The repeats go to their documents, which mark the words.

Results are exact up to collisions of hashes, of which 56 bits tell windows of one bucket apart: as a bucket holds two million windows or
so at every size, a window is taken for a repeat with a chance of 3e-11.

Cases: a null text has no words; a text of fewer words than a window keeps all. Repeated rows of one id are one document, so
nothing is removed from them for each other's sake. Rows without an id come after all others, and are one document too.
Other columns of the input are not read, whatever they are called. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm.shingles import U, batch_windows

WINDOW = 13
BLOCK_BYTES = (256 << 10, 8 << 20)  # least and most bytes of text in a block; between them, a block is 1/2000 of the corpus
BUCKET_WINDOWS = 2_000_000  # about so many windows in a bucket, at most
LEAST_BITS, HASH_BYTES = 6, 7
LAST = (1 << 63) - 1  # stands for a missing id
PACKED = "bucket long, known boolean, docs binary, counts binary, hashes binary"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(SPAN)), ("kept", pa.string())])


def _packed_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values cut at ends, each piece as bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * (values.nbytes // max(1, len(values)))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _ends(change: np.ndarray, n: int) -> np.ndarray:
    """The ends of the runs whose later members begin where change (of n - 1) holds."""
    return np.append(np.flatnonzero(change) + 1, n)


def kept_bits(bits: int) -> np.uint64:
    """What is used of a hash: the upper bits, which name the bucket, and the lower 56."""
    return U(((1 << bits) - 1) << (64 - bits) | (1 << 8 * HASH_BYTES) - 1)


def _pack(hashes: np.ndarray, docs: np.ndarray, bits: int, known: bool) -> pa.RecordBatch:
    """(hash, document) pairs as one row for a bucket: its documents, their numbers of hashes, and the hashes by document."""
    bucket = (hashes >> U(64 - bits)).astype(np.int64)
    order = np.lexsort((docs, bucket))
    hashes, docs, bucket = hashes[order], docs[order], bucket[order]
    new_bucket = bucket[1:] != bucket[:-1]
    run_ends = _ends(new_bucket | (docs[1:] != docs[:-1]), len(docs))
    bucket_ends = _ends(new_bucket, len(docs))
    runs = np.searchsorted(run_ends, bucket_ends, "right")
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[bucket_ends - 1]), pa.array(np.full(len(runs), known)), _packed_bytes(docs[run_ends - 1], runs),
         _packed_bytes(np.diff(run_ends, prepend=0).astype(np.int32), runs), _packed_bytes(hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES], bucket_ends)],
        ["bucket", "known", "docs", "counts", "hashes"])


def block_entries(ids: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> tuple:
    """Of a block's windows (hash, row of ids): each hash with its smallest id, and the (hash, id) that are repeats of one."""
    docs = ids[row]
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    first = np.append(True, hashes[1:] != hashes[:-1])
    least = docs[first][np.cumsum(first) - 1]
    again = docs != least
    again[1:] &= first[1:] | (docs[1:] != docs[:-1])  # once for a document
    return hashes[first], docs[first], hashes[again], docs[again]


def _blocks(window: int, bits: int, block_bytes: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, hashes, rows, n = [], [], [], 0
        for part_ids, texts in held:
            for h, r in batch_windows(texts, window):
                hashes.append(h & kept_bits(bits))
                rows.append(r + n)
            ids.append(part_ids)
            n += len(part_ids)
        h = np.concatenate(hashes) if hashes else np.empty(0, U)
        if len(h):
            first_h, first_d, more_h, more_d = block_entries(np.concatenate(ids), h, np.concatenate(rows))
            yield _pack(first_h, first_d, bits, known=False)
            if len(more_h):
                yield _pack(more_h, more_d, bits, known=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at, done = 0, 0
            while at < len(ids):
                stop = min(len(ids), int(np.searchsorted(total, done + block_bytes - size)) + 1)
                held.append((ids[at:stop], texts.slice(at, stop - at)))
                size += int(total[stop - 1]) - done
                at, done = stop, int(total[stop - 1])
                if size >= block_bytes:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)
    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bucket_repeats(bits: int):
    """The repeats of one bucket's hashes: for a document, those that a document with a smaller id has."""
    def run(table: pa.Table) -> pa.Table:
        known = np.repeat(table["known"].to_numpy(), pc.binary_length(table["hashes"]).to_numpy() // HASH_BYTES)
        hashes = np.zeros((len(known), 8), np.uint8)
        hashes[:, :HASH_BYTES] = _joined(table["hashes"], np.uint8).reshape(-1, HASH_BYTES)
        hashes = hashes.reshape(-1).view(U) | U(table["bucket"][0].as_py() << (64 - bits))
        docs = np.repeat(_joined(table["docs"], np.int64), _joined(table["counts"], np.int32))
        out_h, out_d = hashes[known], docs[known]
        hashes, docs = hashes[~known], docs[~known]
        if len(hashes):
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            least = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))
            later = docs > least
            out_h, out_d = np.concatenate([out_h, hashes[later]]), np.concatenate([out_d, docs[later]])
        if not len(out_d):
            return pa.table({"id": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary())})
        order = np.argsort(out_d, kind="stable")
        out_h, out_d = out_h[order], out_d[order]
        ends = _ends(out_d[1:] != out_d[:-1], len(out_d))
        return pa.table({"id": pa.array(out_d[ends - 1]), "hashes": _packed_bytes(out_h, ends)})
    return run


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    np.subtract.at(change, np.minimum(starts + window, n), 1)
    return np.cumsum(change[:n]) > 0


def _remove(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, kept = [], [], []
            texts = batch.column("text")
            for at, (text, repeats) in enumerate(zip(texts.to_pylist(), batch.column("repeats").to_pylist(), strict=True)):
                words, gone = text.encode().split(), []  # bytes are split at the six white-space characters only
                counts.append(len(words))
                if repeats:
                    found = np.isin(np.concatenate([h for h, _ in batch_windows(texts.slice(at, 1), window)]) & kept_bits(bits), np.frombuffer(b"".join(repeats), U))
                    mask = covered(np.flatnonzero(found), window, len(words))
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                    gone = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                    words = [w for a, b in zip([0, *edges[1::2]], [*edges[0::2], len(words)], strict=True) for w in words[a:b]]
                spans.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.binary()).cast(pa.string())],
                                             schema=RESULT)
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, the removed intervals of words (start, end; end is not in it),
    and the words that are kept, joined by one space."""
    if window < 1:
        raise ValueError("a window has at least one word")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(40, max(LEAST_BITS, math.ceil(math.log2(max(1, total / 6) / BUCKET_WINDOWS))))
    block = block_bytes or min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], total // 2000))
    packed = rows.select("id", "text").mapInArrow(_blocks(window, bits, block), PACKED)
    repeats = packed.groupBy("bucket").applyInArrow(_bucket_repeats(bits), "id long, hashes binary")
    of_document = repeats.groupBy("id").agg(F.collect_list("hashes").alias("repeats"))
    return (rows.join(of_document, "id", "left").select("doc_id", "text", "repeats")
            .mapInArrow(_remove(window, bits), "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string"))


def op12(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from d),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from s),
f as (select g, min(doc_id) as first from g group by g),
hit as (select distinct g.doc_id, i + k as i from g join f on g.g = f.g and f.first < g.doc_id, (select unnest(range(13)) as k)),
t as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from d),
k as (select t.doc_id, count(hit.i) as n_removed, coalesce(string_agg(t.w, ' ' order by t.i) filter (where hit.i is null), '') as kept
      from t left join hit on t.doc_id = hit.doc_id and t.i = hit.i group by t.doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
