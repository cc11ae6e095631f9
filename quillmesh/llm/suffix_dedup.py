"""Repeated passages by a distributed merge sort of sampled suffixes.

A byte is removed if a ``length``-byte string that covers it also starts anywhere
else (in any document, on the input as given). Strings never cross documents.

Which strings repeat is decided for runs of windows that share an anchor:

1. Anchors: in each window of ``length`` bytes the leftmost ``GRAM``-byte string of
   least hash (winnowing), so equal windows have their anchor at the same place. The
   windows with one anchor are a run. Per block of texts, the fingerprints of the anchors
   and of their runs' bytes are exchanged; anchors that occur once have no repeated
   window (distributed duplicate detection).
2. An anchor that occurs twice or more, always with one run: all windows of the run are
   repeated. Its run's first suffix is sorted within each block and exchanged in
   front-coded runs (common prefix with the string before, then the rest), by ranges of
   the sorted order; a range's runs are combined with a loser tree that compares two
   strings only beyond the prefix they are known to share. Strings that come from two
   places are repeated, and with them all of the run.
3. An anchor with different runs: which windows repeat is open, in all places alike. A
   run's windows overlap, so they travel as one string, by anchor, and are compared where
   the anchor's strings meet (by 126-bit fingerprints). For anchors that occur over ``hot``
   times each window's fingerprint is exchanged by itself, so that no anchor
   has to meet in one task.

Scale: a block sends each anchor and each suffix once, so copies meet
as one entry per block; ranges are cut at quantiles of a bounded sample (balance
only, results don't depend on it), of which no more than ``MAX_CUTS`` go to the tasks; beyond
them each range is split by a hash of the string, so ranges stay small at any size. An
anchor's strings meet in one task up to ``hot`` of them (some 15 MB). Texts travel as
compressed blocks. The scan of ``docs`` must give the same rows in the same order when it is repeated (any file
table does; else write it first), which the last step verifies.

Nulls and empty texts have no bytes. Rows with null or repeated ids are rows of
their own. Texts of fewer than ``length`` bytes lose nothing. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut

GRAM = 50
_A, _B, _W = np.uint64(0), np.uint64(1), np.uint64(2)  # kinds of key: anchor, first window of a run, window
_LOW = ~np.uint64(3)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POSITION = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class _Hasher:
    """Polynomial hashes of all k-byte strings of a text, modulo 2^64, mixed."""

    def __init__(self):
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _tables(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(1 << 16, 1 << n.bit_length())
            have = tuple(
                np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                for b in (base, pow(base, -1, 1 << 64))
            )
            if n <= 1 << 22:
                self.powers[base] = have
        return have

    def sums(self, data: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
        powers, _ = self._tables(base, len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
        _, inverse = self._tables(base, len(sums))
        return _mixed((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, where its leftmost least gram is."""
    n = len(grams)
    at = np.arange(n, dtype=np.uint64)
    keys = (grams & ~_POSITION) | (at & _POSITION)
    padded = np.full(-(-n // width) * width, np.uint64((1 << 64) - 1))
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    start = at[: n - width + 1]
    return (start + ((least - start) & _POSITION)).astype(np.int64)


class _Text:
    """One text's anchors, and the runs of windows that have one anchor."""

    def __init__(self, hasher: _Hasher, data: bytes, length: int):
        self.data, self.length, self.hasher = data, length, hasher
        self.bytes = np.frombuffer(data, np.uint8)
        self.n = len(data)
        self.windows = max(0, self.n - length + 1)
        if not self.windows:
            return
        self.sums = sums = hasher.sums(self.bytes)
        grams = hasher.grams(sums, GRAM)
        self.owner = owners(grams, length - GRAM + 1)
        self.first = np.concatenate(([0], np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1))  # owners never go back
        self.anchors = anchors = self.owner[self.first]
        self.anchor_keys = (grams[anchors] & _LOW) | _A

    def prints(self, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at these places."""
        _, inverse = self.hasher._tables(_BASES[0], len(self.sums))
        return _mixed((self.sums[at + self.length] - self.sums[at]) * inverse[at]) & _LOW

    def owned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first, last, and a key of the bytes
        that they cover together."""
        first = self.first
        last = np.append(first[1:] - 1, self.windows - 1)
        end = last + self.length
        _, inverse = self.hasher._tables(_BASES[0], len(self.sums))
        h = (self.sums[end] - self.sums[first]) * inverse[first] + (end - first).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return first, last, ((h ^ (h >> np.uint64(30))) & _LOW) | _W

    def second_print(self, at: np.ndarray) -> np.ndarray:
        base = _BASES[1]
        return self.hasher.grams(self.hasher.sums(self.bytes, base), self.length, base)[at]


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value its place in an ordered array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


class _Counts:
    """How often each key of a block occurs over all blocks (0: once; negative: in
    the same surroundings everywhere)."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray):
        self.keys, first = np.unique(keys, return_index=True)
        self.totals = totals[first]

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = _among(self.keys, keys)
        return np.where(at >= 0, self.totals[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64)


# ---- blocks of texts -------------------------------------------------------


def _pack(rows: list[tuple]) -> tuple[int, bytes]:
    ids = b"".join(struct.pack("<?q", i is not None, i or 0) for i, _ in rows)
    sizes = struct.pack(f"<{len(rows)}q", *(len(t) for _, t in rows))
    body = struct.pack("<q", len(rows)) + ids + sizes + b"".join(t for _, t in rows)
    return xxhash.xxh64_intdigest(body) - (1 << 63), zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(blob: bytes) -> Iterator[tuple[int | None, bytes]]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", body)
    ids = list(struct.iter_unpack("<?q", body[8 : 8 + 9 * n]))
    sizes = struct.unpack_from(f"<{n}q", body, 8 + 9 * n)
    at = 8 + 17 * n
    for (known, doc_id), size in zip(ids, sizes):
        yield (doc_id if known else None), body[at : at + size]
        at += size


def _chunks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[list[tuple]]:
    rows, held = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            rows.append((doc_id, data))
            held += len(data) + 32
            if held >= block_bytes:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _first_keys(length: int, block_bytes: int):
    """Of each block: its anchors' keys, those of their runs, and how often it has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for rows in _chunks(batches, block_bytes):
            block, _ = _pack(rows)
            keys, around = [], []
            for _, data in rows:
                text = _Text(hasher, data, length)
                if text.windows:
                    keys.append(text.anchor_keys)
                    around.append(text.owned()[2])
            if keys:
                columns = [pa.array(c) for c in _distinct_pairs(np.concatenate(keys), np.concatenate(around))]
                blocks = pa.array(np.full(len(columns[0]), block, np.int64))
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], blocks, columns[2]], ["key", "second", "block", "n"])

    return run


def _distinct_pairs(k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, as signed numbers, and how often each is met."""
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    start = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))) if len(k) else np.zeros(0, np.int64)
    return k[start].view(np.int64), s[start].view(np.int64), np.diff(np.append(start, len(k)))


def _repeated(rows: DataFrame) -> DataFrame:
    """(block, key, total) of the (key, second) that occur twice or more over all
    blocks. One exchange and one sort."""
    total = F.sum("n").over(Window.partitionBy("key", "second"))
    return rows.select("key", "second", "block", "n").withColumn("total", total).where("total > 1").select("block", "key", "total")


def _repeated_anchors(rows: DataFrame) -> DataFrame:
    """(block, key, total) of the keys that occur twice or more; negative if with
    one ``second`` everywhere. One exchange and one sort."""
    whole = Window.partitionBy("key")
    met = rows.select("key", "second", "block", "n").withColumn("total", F.sum("n").over(whole))
    met = met.withColumn("same", F.min("second").over(whole) == F.max("second").over(whole)).where("total > 1")
    return met.select("block", "key", F.when(F.col("same"), -F.col("total")).otherwise(F.col("total")).alias("total"))


# ---- sorted runs and their merge -------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    top = min(len(a), len(b))
    if a[known:top] == b[known:top]:
        return top
    low, step = known, 8
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(strings: list[bytes], counts: list[int]) -> bytes:
    """A sorted run: per string the length shared with the one before (2 bytes),
    1 or 2 for once or more, the length of the rest (2 bytes) and the rest."""
    out, before = [], b""
    for string, count in zip(strings, counts):
        shared = common_prefix(before, string, 0)
        out.append(struct.pack("<HBH", shared, min(count, 2), len(string) - shared) + string[shared:])
        before = string
    return b"".join(out)


def read_run(coded: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(string, length shared with the one before, count) of a front-coded run."""
    at, before = 0, b""
    while at < len(coded):
        shared, count, rest = struct.unpack_from("<HBH", coded, at)
        at += 5 + rest
        before = before[:shared] + coded[at - rest : at]
        yield before, shared, count


class LoserTree:
    """Merges sorted runs. For each waiting string the length that it shares with
    the last string given out is known; a contest is decided by these lengths
    alone when they differ, else by the bytes beyond them."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.runs = runs
        self.k = len(runs)
        self.now: list = [next(r, None) for r in runs]
        self.shared = [0] * self.k
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._climb(i, True)

    def _loses(self, a: int, b: int) -> bool:
        """Whether a loses to b; the loser's shared length is brought up to date."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return x is None
        if self.shared[a] != self.shared[b]:
            return self.shared[a] < self.shared[b]
        p = common_prefix(x[0], y[0], self.shared[a])
        first, second = x[0][p : p + 1], y[0][p : p + 1]
        lost = first > second or (first == second and (len(x[0]) > len(y[0]) or len(x[0]) == len(y[0]) and a > b))
        self.shared[a if lost else b] = p
        return lost

    def _climb(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            waiting = self.losers[node]
            if waiting < 0 and building:
                self.losers[node] = winner
                return
            if self._loses(winner, waiting):
                self.losers[node], winner = winner, waiting
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(string, length shared with the one before, count, run) in order."""
        while self.k and self.now[self.losers[0]] is not None:
            i = self.losers[0]
            string, _, count = self.now[i]
            yield string, self.shared[i], count, i
            self.now[i] = next(self.runs[i], None)
            self.shared[i] = self.now[i][1] if self.now[i] else 0
            self._climb(i)


def repeated_strings(runs: list[bytes]) -> Iterator[tuple[bytes, set[int]]]:
    """(string, runs that have it) for strings met twice over all runs."""
    before, total, where = None, 0, set()
    for string, shared, count, run in LoserTree([read_run(r) for r in runs]):
        if before is not None and shared == len(string) == len(before):
            total += count
            where.add(run)
            continue
        if total > 1:
            yield before, where
        before, total, where = string, count, {run}
    if total > 1:
        yield before, where


def _decode_block(blobs: pa.Table, keys: pa.Table) -> list[tuple]:
    rows = [row for blob in blobs.column("blob") for row in _unpack(blob.as_py())]
    if not rows and keys.num_rows:
        raise RuntimeError("the input gave other rows when read again; write it to a table first")
    return rows


def range_of(cuts: list[bytes], parts: int, suffix: bytes) -> int:
    """The range of the sorted order that a suffix is in, and where there are more ranges
    than cuts, its part of that by a hash: equal suffixes always go together."""
    place = bisect_right(cuts, suffix) * parts
    return place + xxhash.xxh64_intdigest(suffix, 5) % parts if parts > 1 else place


def _runs_and_windows(length: int, cuts: list[bytes], parts: int, hot: int, n_buckets: int):
    """From a block and its keys that occur twice: front-coded runs of its suffixes
    (range, run), strings of open windows packed by buckets of anchors (range null,
    run, key: the bucket) and windows of hot anchors (key, second, n)."""

    def run(key, blobs: pa.Table, keys: pa.Table) -> pa.Table:
        rows = _decode_block(blobs, keys)
        block = key[0].as_py()
        counts = _Counts(keys.column("key").to_numpy().view(np.uint64), keys.column("total").to_numpy())
        hasher, strings, joint, windows, seconds = _Hasher(), {}, {}, [], []
        maybe = np.zeros(len(rows), bool)
        for number, (_, data) in enumerate(rows if keys.num_rows else ()):
            text = _Text(hasher, data, length)
            if not text.windows:
                continue
            of_anchor = counts.of(text.anchor_keys)
            met = np.flatnonzero(of_anchor)
            if not len(met):
                continue
            maybe[number] = True
            first, last, covered = text.owned()
            for at in first[met[of_anchor[met] < 0]].tolist():
                suffix = data[at : at + length]
                strings[suffix] = strings.get(suffix, 0) + 1
            is_hot = of_anchor > hot
            if is_hot.any():
                runs = np.flatnonzero(is_hot)
                at = np.concatenate([np.arange(first[i], last[i] + 1) for i in runs.tolist()])
                windows.append(text.prints(at) | _W)
                seconds.append(text.second_print(at))
            for i in met[(of_anchor[met] > 0) & ~is_hot[met]].tolist():
                named = int(covered[i])
                anchor = int(text.anchor_keys[i])
                before = joint.get(named)
                joint[named] = (anchor, data[first[i] : last[i] + length], before[2] + 1 if before else 1)
        ranges: dict[int, list[bytes]] = {}
        for suffix in sorted(strings):
            ranges.setdefault(range_of(cuts, parts, suffix), []).append(suffix)
        buckets: dict[int, list[tuple[int, int, bytes, int]]] = {}
        for named, (anchor, string, times) in joint.items():
            buckets.setdefault((anchor >> 2) % n_buckets, []).append((anchor, named, string, times))
        packed = zstandard.ZstdCompressor(level=3)
        coded = [packed.compress(front_code(x, [strings[s] for s in x])) for x in ranges.values()]
        k = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
        s = np.concatenate(seconds) if seconds else np.zeros(0, np.uint64)
        k, s, n = _distinct_pairs(k, s)
        r, j, m = len(coded), len(buckets), len(k)
        flags = [np.packbits(maybe).tobytes()] if maybe.any() else []  # range -1: texts that may lose something
        f = len(flags)

        def column(*parts) -> pa.ChunkedArray:
            kind = next(p.type for p in parts if not isinstance(p, int))
            return pa.chunked_array([pa.nulls(p, kind) if isinstance(p, int) else p for p in parts])

        strings_of = [packed.compress(_pack_strings(x)) for x in buckets.values()]
        return pa.table(
            {
                "block": pa.array(np.full(r + f + j + m, block, np.int64)),
                "range": column(pa.array([*ranges, *([-1] * f)], pa.int64()), j, m),
                "run": column(pa.array(coded + flags + strings_of, pa.binary()), m),
                "key": column(r + f, pa.array(list(buckets), pa.int64()), pa.array(k)),
                "second": column(r + f + j, pa.array(s)),
                "n": column(r + f + j, pa.array(n)),
            }
        )

    return run


def _pack_strings(strings: list[tuple[int, int, bytes, int]]) -> bytes:
    """(anchor, key, string, times) rows as columns of bytes."""
    anchors, named, parts, times = zip(*strings)
    columns = [np.array(anchors, "<u8"), np.array(named, "<u8"), np.array(times, "<u4"), np.array([len(p) for p in parts], "<u4")]
    return struct.pack("<q", len(strings)) + b"".join(c.tobytes() for c in columns) + b"".join(parts)


def _unpack_strings(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors, keys, times, sizes, and all bytes one after the other."""
    (n,) = struct.unpack_from("<q", body)
    at, out = 8, []
    for kind in ("<u8", "<u8", "<u4", "<u4"):
        out.append(np.frombuffer(body, kind, n, at).astype(np.uint64 if kind == "<u8" else np.int64))
        at += n * int(kind[-1])
    return *out, np.frombuffer(body, np.uint8, len(body) - at, at)


def _meet_anchors(length: int, slice_windows: int = 200_000):
    """Of strings of open windows, in buckets of anchors: (block, key, mask), the
    string's key and which of its windows occur twice. Anchors are taken in turn, in
    slices of about ``slice_windows`` windows, an anchor's strings together."""

    def run(table: pa.Table) -> pa.Table:
        hasher, unpack = _Hasher(), zstandard.ZstdDecompressor()
        parts = [_unpack_strings(unpack.decompress(x.as_py())) for x in table.column("run")]
        anchors, named, times, sizes, data = (np.concatenate([p[i] for p in parts]) for i in range(5))
        blocks = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts])
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        del parts
        order = np.argsort(anchors, kind="stable")
        counts = sizes[order] - length + 1
        done = np.cumsum(counts)
        edges = np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))
        keep, masks, first = [], [], 0
        for last in [*edges[1:].tolist(), len(order)]:
            if last < len(order) and done[last - 1] - (done[first - 1] if first else 0) < slice_windows:
                continue
            mine = order[first:last]
            a, b = [], []
            for i in mine.tolist():
                piece = data[starts[i] : starts[i] + sizes[i]]
                a.append(hasher.grams(hasher.sums(piece), length))
                b.append(hasher.grams(hasher.sums(piece, _BASES[1]), length, _BASES[1]))
            a, b, n = np.concatenate(a), np.concatenate(b), counts[first:last]
            of = np.repeat(np.arange(len(mine)), n)
            z = anchors[mine][of]
            by = np.lexsort((b, a, z))
            x, y, z = a[by], b[by], z[by]
            group = np.cumsum(np.concatenate(([False], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))))
            total = np.bincount(group, times[mine][of][by])
            twice = np.zeros(len(a), bool)
            twice[by] = total[group] > 1
            ends = np.cumsum(n)
            for j in np.flatnonzero(np.add.reduceat(twice, ends - n)).tolist():
                keep.append(int(mine[j]))
                masks.append(np.packbits(twice[ends[j] - n[j] : ends[j]]).tobytes())
            first = last
        kept = np.array(keep, np.int64)
        return pa.table({"block": pa.array(blocks[kept]), "key": pa.array(named[kept].view(np.int64)), "mask": pa.array(masks, pa.binary())})

    return run


def _merge_range(length: int):
    def run(table: pa.Table) -> pa.Table:
        unpack, hasher = zstandard.ZstdDecompressor(), _Hasher()
        blocks = table.column("block").to_numpy()
        out_blocks, out_keys, held, where = [], [], [], []

        def give() -> None:
            flat = np.frombuffer(b"".join(held), np.uint8)
            at = np.arange(len(held)) * length
            keys = (hasher.grams(hasher.sums(flat), length)[at] & _LOW) | _B
            out_keys.append(np.repeat(keys, [len(w) for w in where]))
            out_blocks.append(blocks[np.fromiter((r for w in where for r in w), np.int64)])
            held.clear()
            where.clear()

        for string, runs in repeated_strings([unpack.decompress(x.as_py()) for x in table.column("run")]):
            held.append(string)
            where.append(runs)
            if len(held) >= 2000:
                give()
        if held:
            give()
        b = np.concatenate(out_blocks) if out_blocks else np.zeros(0, np.int64)
        k = np.concatenate(out_keys).view(np.int64) if out_keys else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(b), "key": pa.array(k)})

    return run


def _cover(text: _Text, known: np.ndarray, single: np.ndarray, joint: np.ndarray, masks: list[bytes]) -> np.ndarray:
    """Which bytes of a text are covered by repeated windows: ``known`` are keys of
    first windows of repeated runs, ``single`` of windows of hot anchors."""
    start = np.zeros(text.windows, bool)
    if len(single):
        start = _among(single, text.prints(np.arange(text.windows)) | _W) >= 0
    first, last, covered = text.owned()
    if len(joint):
        found = _among(joint, covered)
        for i in np.flatnonzero(found >= 0).tolist():
            bits = np.unpackbits(np.frombuffer(masks[found[i]], np.uint8), count=int(last[i] - first[i]) + 1)
            start[first[i] : last[i] + 1] |= bits.astype(bool)
    edge = np.zeros(text.n + 1, np.int32)
    at = np.flatnonzero(start)
    edge[at] += 1
    edge[at + text.length] -= 1
    whole = np.flatnonzero(_among(known, text.prints(first) | _B) >= 0)
    edge[first[whole]] += 1  # no two runs have their first or their last window in common
    edge[last[whole] + text.length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finish(length: int, digest: bool):
    def run(key, blobs: pa.Table, keys: pa.Table) -> pa.Table:
        rows = _decode_block(blobs, keys)
        named = keys.column("key").is_valid()
        flags = keys.filter(pc.invert(named)).column("mask").to_pylist()
        maybe = np.unpackbits(np.frombuffer(b"".join(flags), np.uint8), count=len(rows)).astype(bool) if flags else np.zeros(len(rows), bool)
        keys = keys.filter(named)
        mask = keys.column("mask").combine_chunks()
        key_values = keys.column("key").to_numpy().view(np.uint64)
        plain = mask.is_null().to_numpy(zero_copy_only=False)
        known = np.unique(key_values[plain])
        hot_windows = (known & np.uint64(3)) == _W
        known, single = known[~hot_windows], known[hot_windows]
        joint, place = np.unique(key_values[~plain], return_index=True)
        masks = mask.drop_null().take(pa.array(place, pa.int64())).to_pylist()
        hasher, out = _Hasher(), []
        for (doc_id, data), may in zip(rows, maybe.tolist()):
            kept, n_spans = data, 0
            if may:
                text = _Text(hasher, data, length)
                gone = _cover(text, known, single, joint, masks)
                if gone.any():
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = text.bytes[~gone].tobytes()
            out.append((doc_id, len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    return run


def _sample(share: float):
    """Strings at every 2,048 bytes, those of the least hashes: about ``share``."""
    bound = int(min(1.0, share) * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - 200, 2048):
                    piece = data[at : at + 24]
                    if xxhash.xxh32_intdigest(piece) < bound:
                        found.add(piece)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["piece"])

    return run


#: Cuts between ranges that go to every task, at most; and strings sampled for them, about.
MAX_CUTS, SAMPLE = 4096, 16_384


def _ranges(source: DataFrame, range_bytes: int, max_cuts: int) -> tuple[list[bytes], int, int]:
    """Cuts of the sorted order, parts of each range, and the ranges in all: about one
    for ``range_bytes`` of text. Beyond ``max_cuts`` cuts the ranges are split by a hash."""
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = total // range_bytes + 1
    n = min(max_cuts + 1, wanted)
    sampled = source.select("text").mapInArrow(_sample(SAMPLE * 2048 / max(1, total)), "piece binary").distinct().collect() if n > 1 else []
    pieces = sorted(bytes(r.piece) for r in sampled)
    cuts = sorted({pieces[i * len(pieces) // n] for i in range(1, n)}) if pieces else []
    return cuts, -(-wanted // n), wanted


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    digest: bool = False,
    block_bytes: int = 8 << 20,
    range_bytes: int = 12 << 20,
    hot: int = 50_000,
    max_cuts: int = MAX_CUTS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row; with
    ``digest`` kept_sha256 in place of kept."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts, parts, n_ranges = _ranges(source, range_bytes, max_cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, block_bytes):
            block, blob = _pack(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

    blocks = source.mapInArrow(pack, "block bigint, blob binary")
    first = source.mapInArrow(_first_keys(length, block_bytes), "key bigint, second bigint, block bigint, n bigint")
    twice = _repeated_anchors(first)
    sent = cut(
        blocks.groupBy("block")
        .cogroup(twice.groupBy("block"))
        .applyInArrow(_runs_and_windows(length, cuts, parts, hot, n_ranges), "block bigint, range bigint, run binary, key bigint, second bigint, n bigint")
    )
    none = F.lit(None).cast("binary")
    sorted_runs = sent.where("range >= 0").select("block", "range", "run")
    merged = sorted_runs.groupBy("range").applyInArrow(_merge_range(length), "block bigint, key bigint")
    joint = sent.where("range IS NULL AND run IS NOT NULL").select("block", F.col("key").alias("bucket"), "run")
    met = joint.groupBy("bucket").applyInArrow(_meet_anchors(length), "block bigint, key bigint, mask binary")
    windows = _repeated(sent.where("run IS NULL"))
    known = merged.select("block", "key", none.alias("mask")).union(windows.select("block", "key", none.alias("mask"))).union(met)
    known = known.union(sent.where("range = -1").select("block", F.lit(None).cast("long").alias("key"), F.col("run").alias("mask")))
    made = "kept_sha256 string" if digest else "kept binary"
    return (
        blocks.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(_finish(length, digest), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {made}")
    )
