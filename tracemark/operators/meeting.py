"""Clips and songs meet in a grid of tasks: the best songs of each clip without a row for every pair of equal hashes.

The pairs of equal hashes grow with clips times songs, and most of them are chance. So they are made, counted and forgotten inside
a task: a group of clips, which is held, meets a group of songs, which passes one after the other. What is shuffled are both
sides' hashes, packed by clip or song, once for each group of the other side, and then a few candidates of each clip and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 1 << 24  # hashes of clips that a task holds, but for a clip that has more
CLIP_GROUPS = 2  # at least, so that a long song is the work of as many tasks
SONG_GROUPS = 16
AT_ONCE = 200_000  # hashes of songs that are looked up at once, but for a song that has more
PAIRS = 1 << 20  # pairs that are made at once, but for those of a single hash of a song
CHUNK = 1 << 20  # held rows that are gone through at once
HEADER = 6  # whole numbers before the planes of packed rows: how many rows, first and last hash, least time, sum of times, widths and span of times
NO_ID = np.iinfo(np.int64).min  # stands for null

PACKED = "id long, rows binary"
FOUND = "clip_id long, sent long, hits long, song_id long, offset_frames int, aligned_matches long"


def clip_groups(n_rows: int) -> int:
    """How many groups of clips n_rows hashes are dealt over."""
    return max(CLIP_GROUPS, -(-n_rows // HELD))


def best_songs(queries: DataFrame, index: DataFrame, groups: int, k: int, tolerance: int = 1) -> DataFrame:
    """J1, J2, A1, E5, A2, E6, A4 of queries (clip_id, hash, anchor_time) and index (hash, song_id, anchor_time): (clip_id, query_hashes, db_hits, best),
    best being the first k of (worth, song_id, offset_frames), worth the negated score of the best offset; ties go to the smaller song id, and
    of offsets to the smallest. Repeats of rows count in full for query_hashes and scores, repeats in a clip once for db_hits."""
    q = _packed(queries, "clip_id").filter("id is not null")
    i = _packed(index, "song_id")
    g, h = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(SONG_GROUPS)).cast("int")
    q = q.withColumns({"clips": g, "songs": F.explode(F.sequence(F.lit(0), F.lit(SONG_GROUPS - 1)))})
    i = i.withColumns({"songs": h, "clips": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    both = _side(q, 0).unionByName(_side(i, 1))
    met = both.repartition(2 * groups * SONG_GROUPS, "clips", "songs").sortWithinPartitions("clips", "songs", "side", "id").mapInArrow(_meet(k, tolerance), FOUND)
    top = F.when(F.col("aligned_matches").isNotNull(), F.struct((-F.col("aligned_matches")).alias("worth"), "song_id", "offset_frames"))
    return met.groupBy("clip_id").agg(F.sum("sent").alias("query_hashes"), F.sum("hits").alias("db_hits"), F.slice(F.sort_array(F.collect_list(top)), 1, k).alias("best"))


def _side(rows: DataFrame, side: int) -> DataFrame:
    return rows.select("clips", "songs", F.lit(side).alias("side"), "id", "rows")


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(id, rows): the hashes and times of a key in one value, or in several where they come from several batches."""
    return rows.select(F.col(key).cast("long").alias("id"), "hash", F.col("anchor_time").cast("int").alias("t")).dropna(subset=["hash", "t"]).mapInArrow(_pack, PACKED)


def _bytes(x: np.ndarray) -> tuple[int, bytes]:
    """Numbers from 0 on by planes of bytes, as many as the largest needs: they compress well."""
    width = (int(x.max()).bit_length() + 7) // 8
    return width, np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def pack(hashes: np.ndarray, t: np.ndarray, times: np.ndarray) -> bytes:
    """Rows sorted by hash in bytes; times are how often each comes."""
    first, least = int(hashes[0]), int(t.min())
    (a, x), (b, y), (c, z) = _bytes(np.diff(hashes, prepend=first)), _bytes(t - least), _bytes(times - 1)
    return np.array([len(hashes), first, int(hashes[-1]), least, int(times.sum()), a | b << 4 | c << 8 | int(t.max()) - least << 12], "<i8").tobytes() + x + y + z


def unpack(rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, _, least, _, widths = np.frombuffer(rows, "<i8", HEADER).tolist()
    out, at = [], 8 * HEADER
    for width in (widths & 15, widths >> 4 & 15, widths >> 8 & 15):
        x = np.zeros((n, 4), np.uint8)
        x[:, :width] = np.frombuffer(rows, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view("<u4").ravel().astype(np.int64))
        at += n * width
    return np.cumsum(out[0]) + first, out[1] + least, out[2] + 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = np.where(null, NO_ID, batch.column(0).fill_null(0).to_numpy())
        hashes, t = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
        order = np.lexsort((t, hashes, ids))
        ids, hashes, t = ids[order], hashes[order], t[order]
        new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (t[1:] != t[:-1])))
        times = np.diff(np.append(new, len(ids)))
        ids, hashes, t = ids[new], hashes[new], t[new]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        parts = zip(start.tolist(), [*start[1:].tolist(), len(ids)])
        packed = [pack(hashes[a:b], t[a:b], times[a:b]) for a, b in parts]
        yield pa.RecordBatch.from_arrays([pa.array(ids[start], mask=ids[start] == NO_ID), pa.array(packed, pa.binary())], ["id", "rows"])


class Clips:
    """A group of clips, by hash, and the best songs so far of each.

    An executor has several tasks, which hold up to HELD rows each. So hash, clip and time of a row are one number of 8 bytes, sorted where it
    lies, and a repeated row is there again. Rows that repeat often, or whose numbers need more bits, are held in columns with their times.
    """

    def __init__(self, ids: list[int], rows: list[bytes], k: int, tolerance: int):
        """rows is emptied."""
        self.k, self.tolerance = k, tolerance
        self.ids, number = np.unique(np.array(ids, np.int64), return_inverse=True)
        n, first, last, least, sent, span = np.array([np.frombuffer(r, "<i8", HEADER) for r in rows]).T
        self.sent = np.zeros(len(self.ids), np.int64)
        np.add.at(self.sent, number, sent)
        self.low, self.t_low, self.t_high = int(first.min()), int(least.min()), int((least + (span >> 12)).max())
        high = int(last.max())
        self.clip_bits, self.t_bits = (len(self.ids) - 1).bit_length(), (self.t_high - self.t_low).bit_length()
        self.whole = self.clip = self.t = self.times = None
        if sent.sum() <= 2 * n.sum() and (high - self.low).bit_length() + self.clip_bits + self.t_bits < 64:
            self.whole = np.empty(int(sent.sum()), np.int64)
            end = 0
            for m in range(len(rows)):
                h, t, times = unpack(rows[m])
                rows[m] = b""
                one = (h - self.low << self.clip_bits | int(number[m])) << self.t_bits | (t - self.t_low)
                end += int(sent[m])
                self.whole[end - int(sent[m]):end] = one if sent[m] == n[m] else np.repeat(one, times)
            self.whole.sort()
            hash_of, size = self._hash_of, len(self.whole)
        else:
            parts = [unpack(r) for r in rows]
            hashes, t, times = (np.concatenate([p[m] for p in parts]) for m in range(3))
            clip = np.repeat(number, n)
            order = np.lexsort((clip, hashes))
            hashes, self.clip, self.t, self.times = hashes[order], clip[order].astype(np.int32), t[order].astype(np.int32), times[order]
            hash_of, size = hashes.__getitem__, len(hashes)
        rows.clear()
        kind, place = (np.int32 if abs(self.low) < 1 << 31 and abs(high) < 1 << 31 else np.int64), np.int32 if size < 1 << 31 else np.int64
        found, starts = [], []
        for a in range(0, size, CHUNK):
            h = hash_of(slice(max(0, a - 1), a + CHUNK))  # and the one before
            new = np.append([True] if a == 0 else [], h[1:] != h[:-1]).astype(bool)
            h = h if a == 0 else h[1:]
            found.append(h[new].astype(kind))
            starts.append((np.flatnonzero(new) + a).astype(place))
        self.hashes, self.starts = np.concatenate(found), np.append(np.concatenate(starts), place(size))
        self.met = np.zeros(len(self.hashes), np.int64)  # index rows of each hash
        self.least, self.least_song = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), np.iinfo(np.int64).max)
        self.best: tuple = (np.empty(0, np.int64),) * 4
        self.more: list[tuple] = []
        self.n_more = 0

    def _hash_of(self, place) -> np.ndarray:
        return (self.whole[place] >> self.clip_bits + self.t_bits) + self.low

    def rows(self, place) -> tuple[np.ndarray, np.ndarray]:
        """Clip, as its place in ids, and time."""
        if self.whole is None:
            return self.clip[place].astype(np.int64), self.t[place].astype(np.int64)
        one = self.whole[place]
        return one >> self.t_bits & (1 << self.clip_bits) - 1, (one & (1 << self.t_bits) - 1) + self.t_low

    def meet(self, songs: np.ndarray, number: np.ndarray, hashes: np.ndarray, t: np.ndarray, times: np.ndarray) -> None:
        """Whole songs, with the rows of each in sequence: number is a row's place in songs."""
        some = np.flatnonzero((hashes >= self.hashes[0]) & (hashes <= self.hashes[-1]))
        at = np.searchsorted(self.hashes, hashes[some].astype(self.hashes.dtype))
        equal = self.hashes[at] == hashes[some]
        at, some = at[equal], some[equal]
        number, t, times = number[some], t[some], times[some]
        if not len(at):
            return
        start, end = self.starts[at].astype(np.int64), self.starts[at + 1].astype(np.int64)
        np.add.at(self.met, at, times)
        done = np.cumsum(end - start)
        last = np.append(np.flatnonzero(number[1:] != number[:-1]), len(number) - 1)  # rows where a song ends
        a = 0
        while a < len(at):  # songs with so many pairs; a song with more is taken alone, in parts
            held = done[a - 1] if a else 0
            fit = last[np.searchsorted(done[last], held + PAIRS, "right") - 1] if done[last[np.searchsorted(last, a)]] <= held + PAIRS else last[np.searchsorted(last, a)]
            rows = slice(a, int(fit) + 1)
            self._songs(songs, number[rows], start[rows], end[rows], t[rows], times[rows])
            a = int(fit) + 1

    def _songs(self, songs, number, start, end, t, times) -> None:
        first = int(number[0])
        low = int(t.min()) - self.t_high
        width = int(t.max()) - self.t_low - low + self.tolerance + 2
        n_songs = int(number[-1]) - first + 1
        if n_songs > 1 and len(self.ids) * n_songs * width >= 1 << 62:  # numbers would not hold it
            cut = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(number)]):
                self._songs(songs, number[a:b], start[a:b], end[a:b], t[a:b], times[a:b])
            return
        parts, done, a = [], np.cumsum(end - start), 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
            n = (end - start)[a:b]
            row = np.repeat(np.arange(a, b), n)
            place = np.arange(len(row)) + np.repeat(start[a:b] - (np.cumsum(n) - n), n)
            clip, at = self.rows(place)
            key = (clip * n_songs + (number[row] - first)) * width + (t[row] - at - low)
            parts.append(_counted(key, None if self.times is None and (times[a:b] == 1).all() else times[row] if self.times is None else times[row] * self.times[place]))
            a = b
            if len(parts) > 1 and len(parts[-1][0]) >= len(parts[0][0]) or a >= len(start) and len(parts) > 1:
                parts = [_counted(*(np.concatenate(c) for c in zip(*parts)))]
        key, n = parts[0]
        score = n.copy()
        for d in range(1, self.tolerance + 1):
            near = key[d:] - key[:-d] <= self.tolerance
            score[:-d] += np.where(near, n[d:], 0)
            score[d:] += np.where(near, n[:-d], 0)
        group = key // width
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        top = np.maximum.reduceat(score, cut)
        group = group[cut]
        clip, song = group // n_songs, songs[first + group % n_songs]
        good = (top > self.least[clip]) | (top == self.least[clip]) & (song < self.least_song[clip])
        size = np.diff(np.append(cut, len(key)))
        # the smallest offset with the best score, of the groups that are still of use
        cut, size, clip, song, top = cut[good], size[good], clip[good], song[good], top[good]
        if not len(cut):
            return
        row = np.repeat(np.arange(len(cut)), size)
        place = np.arange(len(row)) + np.repeat(cut - (np.cumsum(size) - size), size)
        hit = np.flatnonzero(score[place] == top[row])
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        self.more.append((clip, song, top, key[place[hit]] % width + low))
        self.n_more += len(cut)
        if self.n_more > max(1_000_000, 2 * len(self.best[0])):
            self.keep()

    def keep(self) -> None:
        """The k best of each clip; a clip that has k tells what a further one must beat."""
        clip, song, top, offset = (np.concatenate(c) for c in zip(self.best, *self.more))
        order = np.lexsort((song, -top, clip))
        clip, song, top, offset = clip[order], song[order], top[order], offset[order]
        start = np.flatnonzero(np.append(True, clip[1:] != clip[:-1])) if len(clip) else np.empty(0, np.int64)
        rank = np.arange(len(clip)) - np.repeat(start, np.diff(np.append(start, len(clip))))
        full = rank == self.k - 1
        self.least[clip[full]], self.least_song[clip[full]] = top[full], song[full]
        self.best = tuple(c[rank < self.k] for c in (clip, song, top, offset))
        self.more, self.n_more = [], 0

    def _hits(self) -> np.ndarray:
        """Index rows of each clip's hashes; a hash counts once in a clip."""
        hits, size = np.zeros(len(self.ids), np.int64), int(self.starts[-1])
        for a in range(0, size, CHUNK):
            b = min(size, a + CHUNK)
            one, end = (int(np.searchsorted(self.starts, self.starts.dtype.type(x), "right")) for x in (a, b - 1))
            edges = np.clip(self.starts[one - 1:end + 1].astype(np.int64), a, b)
            number = np.repeat(np.arange(one - 1, end), np.diff(edges))
            clip = self.rows(slice(max(0, a - 1), b))[0]  # and the one before
            new = np.append([True] if a == 0 else [], clip[1:] != clip[:-1]).astype(bool)
            new[edges[:-1][self.starts[one - 1:end] >= a] - a] = True
            clip = clip[len(clip) - (b - a):]
            hits += np.bincount(clip[new], self.met[number[new]], len(self.ids)).astype(np.int64)
        return hits

    def result(self, count_sent: bool) -> Iterator[pa.RecordBatch]:
        self.keep()
        hits = self._hits()
        n, none = len(self.ids), np.ones(len(self.ids), bool)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in FOUND.split(", ")]
        sums = [self.ids, self.sent if count_sent else np.zeros(n, np.int64), hits]
        yield pa.RecordBatch.from_arrays([*map(pa.array, sums), *(pa.array(np.zeros(n, np.int64), k, mask=none) for k in kinds[3:])], names)
        clip, song, top, offset = self.best
        for a in range(0, len(clip), AT_ONCE):
            cut = slice(a, a + AT_ONCE)
            no = np.ones(len(clip[cut]), bool)
            zero = np.zeros(len(no), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[clip[cut]]), pa.array(zero, mask=no), pa.array(zero, mask=no), pa.array(song[cut], mask=song[cut] == NO_ID),
                                              pa.array(offset[cut].astype(np.int32)), pa.array(top[cut])], names)


def _counted(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sums of n (1 by default) over each."""
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new], np.diff(np.append(new, len(key))) if n is None else np.add.reduceat(n, new)


def _meet(k: int, tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, clips = None, None
        q: tuple[list, list] = [], []  # ids and rows of clips, until their cell's first song comes
        held: list[tuple] = []  # songs
        size = 0

        def met():
            nonlocal held, size, clips, q
            if q[0]:
                clips, q = Clips(*q, k, tolerance), ([], [])
            if held and clips:
                ids = np.array([r[0] for r in held], np.int64)
                parts = [r[1] for r in held]
                new = np.append(True, ids[1:] != ids[:-1])
                clips.meet(ids[new], np.repeat(np.cumsum(new) - 1, [len(p[0]) for p in parts]), *(np.concatenate([p[n] for p in parts]) for n in range(3)))
            held, size = [], 0

        def result():
            nonlocal clips
            met()
            if clips:
                yield from clips.result(cell[1] == 0)
            clips = None

        for batch in batches:
            packed = batch.column(4)
            for m, (g, h, side, key) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(4)))):
                if (g, h) != cell:
                    yield from result()
                    cell = g, h
                key = NO_ID if key is None else key
                if side == 0:
                    q[0].append(key)
                    q[1].append(packed[m].as_py())
                    continue
                if q[0] or size >= AT_ONCE and held[-1][0] != key:
                    met()
                if clips:
                    held.append((key, unpack(packed[m].as_py())))
                    size += len(held[-1][1][0])
        yield from result()
    return run
