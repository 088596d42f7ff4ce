"""Cross-tokenizer alignment: where the tokens of two tokenizers of one text end together, and which of them overlap.

A is a byte-level BPE and encodes a space and the text; B is a BPE of pieces with byte fallback, which puts the space itself. Both
token streams spell the same bytes. Offsets at which tokens of both end cut them into groups; an A and a B token
are linked where their byte ranges overlap. A pair of ids counts as often as its tokens are linked in the corpus.

1. Texts are encoded once, long ones in pieces (cut before a space between two letters, where neither tokenizer's tokens cross), and the
   ids are written by byte-range chunks: a token belongs to the chunk in which it ends.
2. A chunk becomes a fragment: an open prefix (up to its first common end), closed groups, an open suffix (after its last one). Fragments
   compose associatively: a suffix and the next prefix close one more group. Texts of one chunk are whole at once; those of longer
   texts meet in a tree of Spark tasks, a few neighbours at a time.
3. Links of closed groups are counted by id pair. The most frequent pairs, a bounded number, are broadcast with their
   counts; links of rarer ones are joined by shuffle.

Cases: a null or empty text has no tokens, nor has one whose tokens of A or B do not spell a space and the text. Strings of special
tokens in a text are plain text. Repeated rows, and rows of one id or without one, are texts of their own, each aligned and counted. Other
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import materialise
from tracemark.llm.token_counts import PATTERN, vocabulary_bytes

A_SETTING, B_SETTING = "tracemark.tokenizer.a", "tracemark.tokenizer.b"
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"  # of the registered query, where the settings are absent
CHUNK, PIECE, FAN_IN = 1 << 18, 1 << 16, 8  # bytes of a chunk, least characters of a piece, neighbours that one task composes
BROADCAST_PAIRS = 4_000_000
AT_ONCE = 1 << 20  # bytes of ids, and links, that are worked at together
CHUNKS = "row long, doc_id long, chunk int, chunks int, a binary, b binary, a_start long, b_start long"
FRAGMENT = "row long, doc_id long, chunk int, cut boolean, n_a long, n_b long, n_groups long, head_a binary, head_b binary, tail_a binary, tail_b binary, groups string, links binary"
COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
RARE = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
# below this code point, letters, digits and white space are those of every Unicode version in use
SETTLED = 0x530


@dataclass
class Pair:
    """Both tokenizers, with the bytes and the length in bytes of every id."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    size_a: np.ndarray
    size_b: np.ndarray
    cuts: bool  # no piece of B has a space after another character, so B's tokens do not cross a cut


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _level_a(data: bytes) -> tuple:
    """(encoder of many texts, bytes of every id). Texts of settled characters go to a faster encoder of the same vocabulary, whose
    merges go by id, as they do in the file; its split of words differs for newer characters at most."""
    import tiktoken

    letters = byte_letters()
    held = json.loads(data)
    vocabulary = held["model"]["vocab"]
    added = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
    table = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for word, i in vocabulary.items():
        table[i] = word.encode() if word in added else bytes(letters[c] for c in word)
    ranks = {table[i]: i for word, i in vocabulary.items() if word not in added}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in held["model"]["merges"]]
    del held, vocabulary
    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) and len(ranks) == 256 + len(made) else None

    def whole():  # only where a text needs it
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(data.decode())
        out.encode_special_tokens = True
        return out

    def encode(texts: list[str]) -> list:
        odd = [i for i, t in enumerate(texts) if fast is None or not (t.isascii() or max(t) < chr(SETTLED))]
        out: list = [None] * len(texts)
        if odd:
            for i, e in zip(odd, once(("whole", hash(data)), whole).encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return [fast.encode_ordinary(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]
    return encode, table


def _level_b(data: bytes) -> tuple:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return (lambda texts: model.encode(texts, num_threads=1)), table, not any("▁" in n.lstrip("▁") for n in names)


def once(key: tuple, make):
    """What make gives, once in a process: functions come to a worker with each task anew, so their module cannot hold it."""
    held = sys.modules.setdefault("tracemark_worker_cache", ModuleType("tracemark_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def tokenizers(data_a: bytes, data_b: bytes) -> Pair:
    def make() -> Pair:
        (encode_a, a), (encode_b, b, cuts) = _level_a(data_a), _level_b(data_b)
        return Pair(encode_a, encode_b, a, b, np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64), cuts)
    return once(("tokenizers", hash(data_a), hash(data_b)), make)


def pieces(text: str, least: int) -> list[str]:
    """text cut into pieces of at least so many characters, each but the first beginning at a space between two ASCII letters."""
    out, at, place = [], 0, re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
    while len(text) - at > least and (m := place.search(text, at + least)):
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


def encoded(pair: Pair, texts: list[str | None], piece: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Ids of A and B for each text; None where it is null or empty, or where tokens do not spell it."""
    parts = [(pieces(t, piece) if pair.cuts and len(t) > piece else [t]) if t else [] for t in texts]
    # a piece after the first begins with the space that B puts itself
    flat_a = [p if k else f" {p}" for ps in parts for k, p in enumerate(ps)]
    flat_b = [p[1:] if k else p for ps in parts for k, p in enumerate(ps)]
    ids_a, ids_b, out, at = pair.encode_a(flat_a), pair.encode_b(flat_b), [], 0
    for ps in parts:
        stop, found = at + len(ps), None
        if ps and all(b"".join(map(table.__getitem__, ids[k])) == flat_a[k].encode() for k in range(at, stop) for table, ids in ((pair.bytes_a, ids_a), (pair.bytes_b, ids_b))):
            found = tuple(np.concatenate([np.array(ids[k], np.int64) for k in range(at, stop)]) for ids in (ids_a, ids_b))
        out.append(found)
        at = stop
    return out


def _narrow(ids: np.ndarray, size: np.ndarray) -> bytes:
    return ids.astype(np.uint16 if len(size) <= 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, size: np.ndarray) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(size) <= 1 << 16 else np.uint32).astype(np.int64)


def byte_chunks(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, chunk: int) -> list[tuple]:
    """(ids of A, ids of B, where the first of each starts) of every byte range of so many bytes; a token lies where it ends."""
    ends = [np.cumsum(size[ids]) for ids, size in ((a, size_a), (b, size_b))]
    n = max(1, -(-int(ends[0][-1] if len(a) else 0) // chunk))
    edges = np.arange(1, n) * chunk
    at = [np.concatenate([[0], np.searchsorted(e, edges, "right"), [len(e)]]) for e in ends]
    starts = [np.concatenate([[0], e]) for e in ends]
    return [(a[at[0][k]:at[0][k + 1]], b[at[1][k]:at[1][k + 1]], int(starts[0][at[0][k]]), int(starts[1][at[1][k]])) for k in range(n)]


def overlaps(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple:
    """Of tokens that begin and end together: whether each token of A and of B ends its group, and the places of the tokens of every link."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    first = np.searchsorted(end_b, end_a - size_a[a], "right")
    last = np.searchsorted(end_b, end_a)  # the token of B in which one of A ends
    n = last - first + 1
    at_a = np.repeat(np.arange(len(a)), n)
    at_b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(at_a))
    ends_a = end_b[last] == end_a
    ends_b = np.zeros(len(b), bool)
    ends_b[last[ends_a]] = True
    return ends_a, ends_b, at_a, at_b


def group_words(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, names: tuple) -> np.ndarray:
    """The ids of closed groups with what follows them, in the order of a1,a2|b1;a3|b2,b3;"""
    before_a, before_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # the number of a token's group
    count_a, count_b = np.bincount(before_a), np.bincount(before_b)
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[before_a]] = names[0][2 * a + ends_a]
    out[np.arange(len(b)) + np.cumsum(count_a)[before_b]] = names[1][2 * b + ends_b]
    return out


def _names(n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of ids with what follows them: inside a group, and at its end."""
    return once(("names", n_a, n_b), lambda: tuple(np.array([f"{i}{end}" for i in range(n) for end in ends], object) for n, ends in ((n_a, ",|"), (n_b, ",;"))))


@dataclass
class Fragment:
    """What lies between two places of a text: with a cut, the tokens up to the first and after the last common end, and the closed groups
    between; without one, all its tokens as head. Ids are packed; links are packed codes of id pairs, one for each overlap."""

    cut: bool
    head: tuple[bytes, bytes]
    tail: tuple[bytes, bytes]
    n_groups: int
    n: tuple[int, int]  # tokens of A and B in closed groups
    groups: str
    links: bytes


def closed(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, want_text: bool) -> tuple[int, str, bytes]:
    """(number of groups, their text, codes of their links) of tokens that begin and end together."""
    ends_a, ends_b, at_a, at_b = overlaps(a, b, size_a, size_b)
    codes = a[at_a] * len(size_b) + b[at_b]
    text = "".join(group_words(a, b, ends_a, ends_b, _names(len(size_a), len(size_b))).tolist())[:-1] if want_text else ""
    return int(ends_a.sum()), text, codes.astype(np.uint32).tobytes()


def fragment(a: np.ndarray, b: np.ndarray, a_start: int, b_start: int, size_a: np.ndarray, size_b: np.ndarray, want_text: bool = True) -> Fragment:
    """The fragment of a chunk's tokens, A's first of which starts at a_start, and B's at b_start."""
    end_a, end_b = a_start + np.cumsum(size_a[a]), b_start + np.cumsum(size_b[b])
    common = np.intersect1d(end_a, end_b)
    whole = a_start == b_start  # the chunk begins at a common end: its first group lacks nothing
    if not len(common):
        return Fragment(False, (_narrow(a, size_a), _narrow(b, size_b)), (b"", b""), 0, (0, 0), "", b"")
    i, j = (np.searchsorted(e, common[0], "right") for e in (end_a, end_b))
    i, j = (0, 0) if whole else (i, j)
    m, n = (np.searchsorted(e, common[-1], "right") for e in (end_a, end_b))
    count, text, links = closed(a[i:m], b[j:n], size_a, size_b, want_text) if m > i else (0, "", b"")
    return Fragment(True, (_narrow(a[:i], size_a), _narrow(b[:j], size_b)), (_narrow(a[m:], size_a), _narrow(b[n:], size_b)), count, (int(m - i), int(n - j)), text, links)


def compose(x: Fragment, y: Fragment, size_a: np.ndarray, size_b: np.ndarray, want_text: bool = True) -> Fragment:
    """The fragment of x's and then y's stretch. Associative; a fragment without tokens and cut is neutral."""
    if not y.cut:
        if not x.cut:
            return Fragment(False, (x.head[0] + y.head[0], x.head[1] + y.head[1]), (b"", b""), 0, (0, 0), "", b"")
        return Fragment(True, x.head, (x.tail[0] + y.head[0], x.tail[1] + y.head[1]), x.n_groups, x.n, x.groups, x.links)
    if not x.cut:
        return Fragment(True, (x.head[0] + y.head[0], x.head[1] + y.head[1]), y.tail, y.n_groups, y.n, y.groups, y.links)
    parts = [(x.n_groups, x.n, x.groups, x.links), (y.n_groups, y.n, y.groups, y.links)]
    between = tuple(_wide(s + p, size) for s, p, size in zip(x.tail, y.head, (size_a, size_b), strict=True))
    if len(between[0]):  # a suffix and a prefix that begin and end together: the group that lay across
        count, text, links = closed(*between, size_a, size_b, want_text)
        parts.insert(1, (count, (len(between[0]), len(between[1])), text, links))
    return Fragment(True, x.head, y.tail, sum(p[0] for p in parts), tuple(sum(p[1][k] for p in parts) for k in (0, 1)),
                    ";".join(p[2] for p in parts if p[2]), b"".join(p[3] for p in parts))


def _settled(f: Fragment, size_a: np.ndarray, size_b: np.ndarray, want_text: bool) -> Fragment:
    """The fragment of a whole text, whose head is a group too, as it begins with the text."""
    start = Fragment(True, (b"", b""), (b"", b""), 0, (0, 0), "", b"")
    return compose(start, f, size_a, size_b, want_text)


def _write_chunks(held, chunk: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*held.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                rows = []
                for row, doc, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoded(pair, part.column(2).to_pylist(), piece), strict=True):
                    parts = byte_chunks(*ids, pair.size_a, pair.size_b, chunk) if ids else [(np.empty(0, np.int64), np.empty(0, np.int64), 0, 0)]
                    rows += [(row, doc, k, len(parts), _narrow(a, pair.size_a), _narrow(b, pair.size_b), i, j) for k, (a, b, i, j) in enumerate(parts)]
                yield _batch(rows, CHUNKS)
    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _row(row: int, doc, chunk: int, f: Fragment) -> tuple:
    return row, doc, chunk, f.cut, *f.n, f.n_groups, *f.head, *f.tail, f.groups, f.links


def _fragment(r: dict) -> Fragment:
    return Fragment(r["cut"], (r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]), r["n_groups"], (r["n_a"], r["n_b"]), r["groups"], r["links"])


@dataclass
class Aligned:
    """A number of whole texts: columns of a row for each, and the codes of all their links, text after text."""

    row: list
    doc_id: list
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    codes: np.ndarray


def whole_texts(rows: list[dict], size_a: np.ndarray, size_b: np.ndarray, want_text: bool) -> Aligned:
    """Texts of one chunk have no open ends: their closed groups, of many texts at once, as one stretch of tokens."""
    parts = [(_wide(r["a"], size_a), _wide(r["b"], size_b)) for r in rows]
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    n_a, n_b = (np.array([len(p[k]) for p in parts], np.int64) for k in (0, 1))
    ends_a, ends_b, at_a, at_b = overlaps(a, b, size_a, size_b)
    text_a, until = np.repeat(np.arange(len(rows)), n_a), np.cumsum(n_a + n_b)
    words = group_words(a, b, ends_a.astype(np.int64), ends_b.astype(np.int64), _names(len(size_a), len(size_b))).tolist() if want_text else []
    groups = ["".join(words[end - n:end])[:-1] for end, n in zip(until.tolist(), (n_a + n_b).tolist(), strict=True)]
    return Aligned([r["row"] for r in rows], [r["doc_id"] for r in rows], n_a, n_b, np.bincount(text_a[ends_a], minlength=len(rows)),
                   np.bincount(text_a[at_a], minlength=len(rows)), groups, (a[at_a] * len(size_b) + b[at_b]).astype(np.uint32))


def _whole(sizes, want_text: bool, finish):
    """Chunks of whole texts, a bounded number of bytes of ids at a time, to what finish makes of them."""
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[Aligned]:
        for batch in batches:
            total = np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE)))
                yield whole_texts(batch.slice(at, stop - at).to_pylist(), *sizes.value, want_text)
                at = stop
    return lambda batches: finish(aligned(batches))


def _composed(finish):
    """Fragments of whole texts to what finish makes of them."""
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[Aligned]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["links"], np.uint32)
                yield Aligned([r["row"]], [r["doc_id"]], *(np.array([x], np.int64) for x in (r["n_a"], r["n_b"], r["n_groups"], len(codes))), [r["groups"]], codes)
    return lambda batches: finish(aligned(batches))


def _columns(x: Aligned, **more) -> pa.RecordBatch:
    named = {"row": x.row, "doc_id": x.doc_id, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links}
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in named.values()), pa.array(x.groups, pa.string()), *more.values()], [*named, "groups", *more])


def _with_links(found: Iterator[Aligned]) -> Iterator[pa.RecordBatch]:
    for x in found:
        ends = np.cumsum(x.n_links)
        yield _columns(x, links=pa.array([x.codes[end - n:end].tobytes() for end, n in zip(ends.tolist(), x.n_links.tolist(), strict=True)], pa.binary()))


def _counted(found: Iterator[Aligned]) -> Iterator[pa.RecordBatch]:
    """(code, n): partial counts of links."""
    held, size = [], 0
    for x in found:
        held.append(x.codes)
        if (size := size + len(x.codes)) > AT_ONCE:
            yield _counts(held)
            held, size = [], 0
    if size:
        yield _counts(held)


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


def _scored(held):
    """Sums over the links of a text whose pair is in the broadcast table; rare: its other links."""
    def finish(found: Iterator[Aligned]) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for x in found:
            code, inverse = np.unique(x.codes, return_inverse=True)
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            there = known[at] == code if len(known) else np.zeros(len(code), bool)
            count = np.where(there, n[at], 0) if len(known) else np.zeros(len(code), np.int64)
            top = there & (count == best[code % len(best)])
            ends = np.cumsum(x.n_links)
            sums, bests, rare = (np.concatenate([[0], np.cumsum(c[inverse])]) for c in (count, top.astype(np.int64), ~there))
            others = [None] * len(ends)
            for k in np.flatnonzero(np.diff(rare[np.append(0, ends)])):
                some, times = np.unique(x.codes[ends[k] - x.n_links[k]:ends[k]][~there[inverse[ends[k] - x.n_links[k]:ends[k]]]], return_counts=True)
                others[k] = [{"code": c, "times": t} for c, t in zip(some.tolist(), times.tolist(), strict=True)]
            yield _columns(x, count_sum=pa.array(sums[ends] - sums[ends - x.n_links]), n_best=pa.array(bests[ends] - bests[ends - x.n_links]), rare=pa.array(others, RARE))
    return finish


def _fragments(sizes, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = sizes.value
        for batch in batches:
            for r in batch.to_pylist():
                f = fragment(_wide(r["a"], size_a), _wide(r["b"], size_b), r["a_start"], r["b_start"], size_a, size_b, want_text)
                yield _batch([_row(r["row"], r["doc_id"], r["chunk"], f)], FRAGMENT)
    return run


def _neighbours(sizes, last: bool, want_text: bool):
    """Composes the fragments of a text that lie side by side, FAN_IN at most; last: they are the whole text."""
    def run(table: pa.Table) -> pa.Table:
        size_a, size_b = sizes.value
        found = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        f = _fragment(found[0])
        for r in found[1:]:
            f = compose(f, _fragment(r), size_a, size_b, want_text)
        f = _settled(f, size_a, size_b, want_text) if last else f
        return pa.Table.from_batches([_batch([_row(found[0]["row"], found[0]["doc_id"], found[0]["chunk"] // FAN_IN, f)], FRAGMENT)])
    return run


class Alignment:
    """The alignment of docs (doc_id, text): `groups()` has one row for each row of docs, `links()` counts by id pair.

    The texts are encoded, and the ids written to shared storage, when this is made. a_file and b_file are paths that the driver reads, or
    names in a store; both files are sent to the executors.
    """

    def __init__(self, docs: DataFrame, a_file: str, b_file: str, chunk: int = CHUNK, piece: int = PIECE):
        self.spark = docs.sparkSession
        data = vocabulary_bytes(self.spark, a_file), vocabulary_bytes(self.spark, b_file)
        pair = tokenizers(*data)
        self.n_b, context = len(pair.size_b), self.spark.sparkContext
        if len(pair.size_a) * self.n_b > 1 << 32:
            raise ValueError("pairs of ids do not fit 32 bits")
        self.sizes = context.broadcast((pair.size_a, pair.size_b))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.chunks = materialise(rows.mapInArrow(_write_chunks(context.broadcast(data), chunk, piece), CHUNKS), "token-chunks")
        self.most_chunks = self.chunks.agg(F.max("chunks")).first()[0] or 1

    def _aligned(self, finish, columns: str, want_text: bool = True) -> DataFrame:
        """What finish makes of all texts: those of one chunk, and those whose fragments meet in a tree."""
        whole = self.chunks.filter("chunks = 1").mapInArrow(_whole(self.sizes, want_text, finish), columns)
        if self.most_chunks == 1:
            return whole
        parts = self.chunks.filter("chunks > 1").repartition("row", "chunk").mapInArrow(_fragments(self.sizes, want_text), FRAGMENT)
        width = self.most_chunks
        while width > 1:
            width = -(-width // FAN_IN)
            parts = parts.groupBy("row", F.floor(F.col("chunk") / FAN_IN).alias("next")).applyInArrow(_neighbours(self.sizes, width == 1, want_text), FRAGMENT)
        return whole.unionByName(parts.mapInArrow(_composed(finish), columns))

    def links(self) -> DataFrame:
        """a, b, n: how many links of the corpus hold this pair of ids."""
        counts = self._aligned(_counted, "code long, n long", want_text=False).groupBy("code").agg(F.sum("n").alias("n"))
        return counts.select(F.floor(F.col("code") / self.n_b).alias("a"), (F.col("code") % self.n_b).alias("b"), "n")

    def groups(self) -> DataFrame:
        """row, doc_id, n_a, n_b, n_groups, n_links, groups (as a1,a2|b1;a3|b2,b3), links (packed codes of 32 bits, a * size of B + b)."""
        return self._aligned(_with_links, f"{COLUMNS}, links binary")

    def scored(self, most: int = BROADCAST_PAIRS) -> DataFrame:
        """groups() without links, but with n_best, the links whose count is the highest of their B id, and count_sum, the sum of all links' counts.

        Counts of at most `most` pairs, the most frequent, are broadcast. The highest count of every B id is, too: there are no more than ids.
        """
        counts = materialise(self.links().select((F.col("a") * self.n_b + F.col("b")).alias("code"), "b", "n"), "pair-counts")
        top = counts.groupBy("b").agg(F.max("n").alias("top"))
        least, frequent = 0, counts
        if counts.count() > most:
            sizes = counts.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()  # at most 64 rows
            total, least = 0, 1 << 62
            for r in sizes:
                if (total := total + r["count"]) > most:
                    break
                least = 1 << r["size"]
            frequent = counts.filter(F.col("n") >= least)
        best = np.zeros(self.n_b, np.int64)
        for r in top.collect():
            best[r["b"]] = r["top"]
        table = frequent.select("code", "n").toArrow()
        order = np.argsort(table["code"].to_numpy())
        held = self.spark.sparkContext.broadcast((table["code"].to_numpy()[order], table["n"].to_numpy()[order], best))

        out = self._aligned(_scored(held), f"{COLUMNS}, count_sum long, n_best long, rare array<struct<code:long,times:long>>")
        if not least:
            return out.drop("rare")
        out = materialise(out, "aligned")
        rare = out.select("row", F.explode("rare").alias("r")).select("row", "r.code", "r.times")
        more = rare.join(counts, "code").join(F.broadcast(top), "b").groupBy("row").agg(
            F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
        return out.drop("rare").join(more, "row", "left").select(
            *[c.split()[0] for c in COLUMNS.split(", ")], (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"))


def op11(docs: DataFrame) -> DataFrame:
    conf = docs.sparkSession.conf
    aligned = Alignment(docs, conf.get(A_SETTING, A_FILE), conf.get(B_SETTING, B_FILE)).scored()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
