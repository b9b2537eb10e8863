"""Repeated byte strings across documents, by suffix sorting with a difference cover.

A suffix array of everything would be many times the size of the texts. So suffixes are
sorted where a repeat can be, and only there:

1. Each window of ``length`` bytes (a candidate for removal) picks an anchor, the ``seed``-byte
   string in it with the smallest hash. Equal windows pick equal anchors at equal places. An
   anchor that occurs once in the corpus therefore rules out all windows that picked it.
2. The bytes around the other anchors are dealt out by the anchor's hash: two equal windows
   meet in the same task, whatever their documents. Equal surroundings are one string.
3. Each task sorts the suffixes of its strings by the difference-cover algorithm and compares
   the first ``length`` bytes of neighbours; of equal windows, the first one in the corpus stays.
4. The removed windows of each document are merged, and its other bytes joined.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import forget, map_batches, written
from forecourt.llm.words import mixed

_LAST = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(30_011).integers(1, 2**64, 256, dtype=np.uint64)
_UP = 0x9E3779B97F4A7C15
_DOWN = pow(_UP, -1, 2**64)
_SEGMENT = (1 << 18) - 2048
_TOGETHER = 12 << 20
_TEXTS = 2500
_PLACE = np.uint64((1 << 20) - 1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 18), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


# --- suffix sorting -------------------------------------------------------------------------


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of small whole numbers, and their dense names from 1, in that order."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:]):
            key = (key << b) | c
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(max(len(order) - 1, 0), dtype=bool)
        for c in columns:
            new |= np.diff(c[order]) != 0
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(new))) if len(order) else order
    return order, names


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``s`` (whole numbers above 0) in order of at least ``depth`` symbols.

    The difference cover of 3: the suffixes at places 1 and 2 modulo 3 are named by their
    first three symbols; the names, those of 1 before those of 2, are a shorter text whose
    suffixes are sorted in the same way, unless all names differ or cover ``depth`` symbols.
    Suffixes at places 0 modulo 3 are sorted by their first symbol and the rank of the next
    suffix, then merged: any two suffixes differ in a symbol or two or in sampled ranks.
    Suffixes alike for ``depth`` symbols stand together, in any order.
    """
    n = len(s)
    if n <= 2:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    pad = np.concatenate((s.astype(np.int64), np.zeros(3, dtype=np.int64)))
    # Where n is 1 modulo 3, an empty suffix ends the first half of the sample.
    first = np.arange(1, n + (n % 3 == 1), 3)
    second = np.arange(2, n, 3)
    sample = np.concatenate((first, second))
    order, names = _names([pad[sample], pad[sample + 1], pad[sample + 2]])
    if depth > 3 and names[order[-1]] < len(sample):
        order = suffix_order(names, -(-depth // 3))
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # The empty suffix has served; ranks of places beyond the end are 0.
    ordered = sample[order]
    ordered = ordered[ordered < n]
    if n % 3 == 1:
        rank[n] = 0
    zeros = np.arange(0, n, 3)
    wide = len(sample) + 2
    zeros = zeros[np.argsort(pad[zeros] * wide + rank[zeros + 1], kind="stable")]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    _, pairs = _names([np.concatenate((pad[twos], pad[zeros])),
                       np.concatenate((pad[twos + 1], pad[zeros + 1]))])
    before = np.searchsorted(pad[ones] * wide + rank[ones + 1],
                             pad[zeros] * wide + rank[zeros + 1])
    before += np.searchsorted(pairs[:len(twos)] * wide + rank[twos + 2],
                              pairs[len(twos):] * wide + rank[zeros + 2])
    out = np.empty(n, dtype=np.int64)
    # Where suffixes alike for ``depth`` symbols stand in any order, so do the places found.
    at = np.maximum.accumulate(before) + np.arange(len(zeros))
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    out[at] = zeros
    out[~taken] = ordered
    return out


def equal_windows(data: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """The class of each window of ``length`` bytes that begins at ``begins``: equal ones share it."""
    wanted = np.zeros(len(data) + 1, dtype=bool)
    wanted[begins] = True
    codes = np.zeros(256, dtype=np.int64)
    present = np.flatnonzero(np.bincount(data, minlength=256))
    codes[present] = np.arange(1, len(present) + 1)
    order = suffix_order(codes[data], length)
    order = order[wanted[order]]
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    live = np.arange(len(same))
    for step in range(0, length, 8):
        # Eight bytes at a time, the last eight overlapping.
        offset = min(step, length - 8)
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        a = np.ascontiguousarray(eight[order[live] + offset]).view(np.uint64).ravel()
        b = np.ascontiguousarray(eight[order[live + 1] + offset]).view(np.uint64).ravel()
        same[live[a != b]] = False
        live = live[a == b]
    classes = np.zeros(len(data) + 1, dtype=np.int64)
    classes[order] = np.concatenate(([0], np.cumsum(~same))) if len(order) else order
    return classes[begins]


# --- anchors ---------------------------------------------------------------------------------


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.empty(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts have few megabytes each (or are one text)."""
    for batch in batches:
        column = batch.column(text)
        sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // _TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


class Runs:
    """Neighbouring windows with the same anchor, for the documents of one batch.

    ``doc``, ``start`` (in its document) and ``count`` of windows, ``at`` (in the data),
    ``anchor`` (the hash of the anchor), ``around`` (the hash of all bytes of its windows).
    Runs depend on their document only, not on its neighbours in the batch or on segments.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int,
                 segment: int = _SEGMENT):
        parts = [self._segment(data, offsets, at, length, seed, segment)
                 for at in range(0, max(len(data) - length + 1, 0), segment)]
        names = ("at", "count", "anchor", "around")
        for i, name in enumerate(names):
            kind = np.int64 if i < 2 else np.uint64
            setattr(self, name, np.concatenate([p[i] for p in parts]).astype(kind)
                    if parts else np.empty(0, dtype=kind))
        if len(parts) > 1:
            self._join(data, np.concatenate([p[4] for p in parts]), length)
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1
        self.start = self.at - offsets[self.doc]

    def _join(self, data, spot, length):
        """Make one run of those that a border between segments cuts (one anchor at one place)."""
        more = (self.at[1:] == self.at[:-1] + self.count[:-1]) & (spot[1:] == spot[:-1])
        if not more.any():
            return
        lead = np.flatnonzero(np.concatenate(([True], ~more)))
        parts = np.diff(np.append(lead, len(self.at)))
        count = np.add.reduceat(self.count, lead)
        self.at, self.anchor, self.around = self.at[lead], self.anchor[lead], self.around[lead]
        self.count = count
        for i in np.flatnonzero(parts > 1).tolist():
            own = data[self.at[i]:self.at[i] + count[i] + length - 1]
            total = np.sum(_TABLE[own] * _power(_UP, len(own))[:len(own)], dtype=np.uint64)
            size = np.array([len(own)], dtype=np.uint64)
            self.around[i] = mixed(total + size * np.uint64(_UP))[0]

    @staticmethod
    def _segment(data, offsets, at, length, seed, segment):
        part = data[at:at + segment + length - 1]
        n, span = len(part), length - seed + 1
        windows = n - length + 1
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(
            _TABLE[part] * _power(_UP, n)[:n], dtype=np.uint64)))
        down = _power(_DOWN, n + 1)
        hashes = mixed((sums[seed:] - sums[:-seed]) * down[:n - seed + 1])
        ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        # The minimum of every ``span`` neighbours, from minima up to and from block borders.
        blocks = -(-len(ranked) // span)
        full = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        full[:len(ranked)] = ranked
        full = full.reshape(blocks, span)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
                  & _PLACE).astype(np.int64)
        # Windows must not reach into the next document.
        low, high = np.searchsorted(offsets, (at + 1, at + n))
        borders = offsets[low:high] - at
        inside = np.zeros(windows + 1, dtype=np.int64)
        np.add.at(inside, np.clip(borders - length + 1, 0, windows), 1)
        np.add.at(inside, np.clip(borders, 0, windows), -1)
        valid = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        if not len(valid):
            return [np.empty(0, dtype=np.int64)] * 5
        cut = np.flatnonzero((np.diff(anchor[valid]) != 0) | (np.diff(valid) != 1)) + 1
        first = valid[np.concatenate(([0], cut))]
        last = valid[np.concatenate((cut - 1, [len(valid) - 1]))]
        end = last + length
        around = mixed((sums[end] - sums[first]) * down[first]
                       + (end - first).astype(np.uint64) * np.uint64(_UP))
        return first + at, last - first + 1, hashes[anchor[first]], around, anchor[first] + at


def _bytes_of(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return data[np.arange(total) - np.repeat(before - at, sizes)]


def _spread(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket in use and the places of its keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


_ANCHORS = pa.schema([("bucket", pa.int64()), ("anchor", pa.binary()), ("times", pa.binary()),
                      ("row", pa.binary()), ("start", pa.binary())])
_STRINGS = pa.schema([("bucket", pa.int64())] + [(name, pa.binary()) for name in (
    "anchor", "around", "key", "row", "start", "count", "data")])
_SPANS = pa.schema([("row", pa.int64()), ("spans", pa.binary())])


def _packed(row_ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Spans by row, as pairs of 32-bit numbers."""
    order = np.lexsort((starts, row_ids))
    row_ids = row_ids[order]
    pairs = np.stack((starts[order], ends[order]), axis=1).astype(np.int32)
    cuts = np.flatnonzero(np.diff(row_ids)) + 1
    firsts = np.concatenate(([0], cuts)).astype(np.int64)[:len(row_ids)]
    return pa.RecordBatch.from_arrays(
        [pa.array(row_ids[firsts]), pa.array([p.tobytes() for p in np.split(pairs, cuts)]
                                             if len(row_ids) else [], pa.binary())], schema=_SPANS)


def _merged(pairs: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans as one."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]))
    return np.stack((pairs[new, 0], reach[ends]), axis=1)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The rows of one bucket after the other, of batches sorted by bucket, by column."""
    current, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, *row in zip(*columns):
            if bucket != current and held:
                yield [list(c) for c in zip(*held)]
                held = []
            current = bucket
            held.append(row)
    if held:
        yield [list(c) for c in zip(*held)]


def _array(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


def _find_anchors(length: int, seed: int, buckets: int, segment: int = _SEGMENT):
    """Of each batch (row, text): its anchors by bucket; those that the batch repeats, in bucket -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            runs = Runs(*_column(batch.column(1)), length, seed, segment)
            if not len(runs.at):
                continue
            owner = rows[runs.doc]
            kinds, first, times = np.unique(runs.anchor, return_index=True, return_counts=True)
            again = np.ones(len(runs.at), dtype=bool)
            again[first] = False
            out = [(-1, runs.anchor[again].tobytes(), b"", owner[again].tobytes(),
                    runs.start[again].astype(np.int32).tobytes())]
            for bucket, places in _spread(kinds, buckets):
                at = first[places]
                out.append((bucket, kinds[places].tobytes(), times[places].tobytes(),
                            owner[at].tobytes(), runs.start[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), _ANCHORS)], schema=_ANCHORS)

    return run


_SPOTS = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()),
                    ("hot", pa.bool_())])


def _spots(rows, starts, anchors, hot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(starts), pa.array(anchors.view(np.int64)), pa.array(hot)],
        schema=_SPOTS)


def _repeated_anchors(hot: int):
    """Where anchors stand that occur more than once, and whether more than ``hot`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, times, rows, starts in _by_bucket(batches):
            anchors = _array(anchors, np.uint64)
            _, of, = np.unique(anchors, return_inverse=True)
            total = np.bincount(of, weights=_array(times, np.int64))[of]
            many = total > 1
            yield _spots(_array(rows, np.int64)[many], _array(starts, np.int32)[many],
                         anchors[many], total[many] > hot)

    return run


def _local_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, anchors, _, rows, starts = (c.to_pylist() for c in batch.columns)
        anchors = _array(anchors, np.uint64)
        yield _spots(_array(rows, np.int64), _array(starts, np.int32), anchors,
                     np.zeros(len(anchors), dtype=bool))


def _strings(length: int, seed: int, buckets: int, segment: int = _SEGMENT):
    """Of each batch (row, key, text, spots): the bytes around repeated anchors, by bucket.

    Equal surroundings go once per batch, with the first place; the windows of the others
    are repeats for sure, and stay behind in bucket -1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = _column(batch.column(2))
            spots = batch.column(3)
            sizes = spots.value_lengths().to_numpy(zero_copy_only=False)
            marks = spots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            places = np.repeat(np.arange(len(rows), dtype=np.int64), sizes) << 32 | marks >> 1
            runs = Runs(data, offsets, length, seed, segment)
            own = runs.doc << 32 | runs.start
            found = np.flatnonzero(np.isin(own, places))
            hot = np.isin(own[found], places[marks & 1 == 1])
            at, doc, start, count = (x[found] for x in (runs.at, runs.doc, runs.start, runs.count))
            anchor, around = runs.anchor[found], runs.around[found]
            if hot.any():
                # Windows of a hot anchor go one by one, by their own hash.
                n = count[hot]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                each = [np.repeat(x[hot], n) for x in (at, doc, start)]
                each[0], each[2] = each[0] + step, each[2] + step
                view = np.lib.stride_tricks.sliding_window_view(data, length)
                names = np.array([
                    int.from_bytes(hashlib.blake2b(view[i].tobytes(), digest_size=8).digest())
                    for i in each[0].tolist()], dtype=np.uint64)
                cold = ~hot
                at, doc, start = (np.concatenate((x[cold], y)) for x, y in zip((at, doc, start), each))
                count = np.concatenate((count[cold], np.ones(len(step), dtype=np.int64)))
                anchor = np.concatenate((anchor[cold], names))
                around = np.concatenate((around[cold], names))
            if not len(at):
                continue
            key, row = keys[doc], rows[doc]
            order = np.lexsort((start, key, around, anchor))
            at, start, count, anchor, around, key, row = (
                x[order] for x in (at, start, count, anchor, around, key, row))
            lead = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(around) != 0)))
            of = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            later = ~lead & ((key != key[of]) | (start != start[of]))
            none = b""
            out = [(-1, none, none, none, row[later].tobytes(), start[later].astype(np.int32).tobytes(),
                    count[later].astype(np.int32).tobytes(), none)]
            lead = np.flatnonzero(lead)
            for bucket, some in _spread(anchor[lead], buckets):
                i = lead[some]
                out.append((
                    bucket, anchor[i].tobytes(), around[i].tobytes(), key[i].tobytes(),
                    row[i].tobytes(), start[i].astype(np.int32).tobytes(),
                    count[i].astype(np.int32).tobytes(),
                    _bytes_of(data, at[i], count[i] + length - 1).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), _STRINGS)], schema=_STRINGS)

    return run


def _local_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, counts = (
                _array(batch.column(i).to_pylist(), kind).astype(np.int64)
                for i, kind in ((4, np.int64), (5, np.int32), (6, np.int32)))
            yield _packed(rows, starts, starts + counts + length - 1)

    return run


def _repeats(length: int):
    """Of each bucket of strings: the spans of windows that an earlier one equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_bucket(batches):
            kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8)
            anchor, around, key, row, start, count, data = (
                _array(c, k) for c, k in zip(columns, kinds))
            start, count = start.astype(np.int64), count.astype(np.int64)
            sizes = count + length - 1
            at = np.cumsum(sizes) - sizes
            order = np.lexsort((start, key, around, anchor))
            at, start, count, anchor, around, key, row = (
                x[order] for x in (at, start, count, anchor, around, key, row))
            lead = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(around) != 0)))
            of = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            later = ~lead & ((key != key[of]) | (start != start[of]))
            spans = [(row[later], start[later], start[later] + count[later] + length - 1)]
            # Different surroundings of one anchor: sort their suffixes.
            lead = np.flatnonzero(lead)
            _, group, members = np.unique(
                anchor[lead], return_inverse=True, return_counts=True)
            lead = lead[members[group] > 1]
            if len(lead):
                n = count[lead]
                text = _bytes_of(data, at[lead], n + length - 1)
                begins = np.cumsum(n + length - 1) - (n + length - 1)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                window = np.repeat(begins, n) + step
                its_key, its_row = np.repeat(key[lead], n), np.repeat(row[lead], n)
                its_start = np.repeat(start[lead], n) + step
                classes = equal_windows(text, window, length)
                order = np.lexsort((its_start, its_key, classes))
                classes, its_key, its_row, its_start = (
                    x[order] for x in (classes, its_key, its_row, its_start))
                lead = np.concatenate(([True], np.diff(classes) != 0))
                of = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
                later = ~lead & ((its_key != its_key[of]) | (its_start != its_start[of]))
                spans.append((its_row[later], its_start[later], its_start[later] + length))
            rows, begin, end = (np.concatenate(x) for x in zip(*spans))
            yield _packed(rows, begin, end)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = [_merged(_array(parts, np.int32).reshape(-1, 2)).astype(np.int32).tobytes()
                  for parts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(merged, pa.binary())], schema=_SPANS)


_RESULT = pa.schema([("n", pa.int64()), ("bytes", pa.int64()), ("removed", pa.int64()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     ("kept", pa.binary())])


def _cut(kind: pa.DataType):
    schema = pa.schema([("key", kind), *list(_RESULT)[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            out: list[list] = [[], [], [], []]
            for text, blob in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8")
                blob = blob.as_py()
                pairs = np.frombuffer(blob, dtype=np.int32).reshape(-1, 2).tolist() if blob else []
                at, kept = 0, []
                for start, end in pairs:
                    kept.append(data[at:start])
                    at = end
                kept = b"".join(kept) + data[at:] if pairs else data
                for column, value in zip(out, (
                        len(data), len(data) - len(kept),
                        [{"start": a, "end": b} for a, b in pairs], kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(out, list(schema)[1:])],
                schema=schema)

    return run


def _with_small(texts: DataFrame, small: DataFrame, values: F.Column, how: str,
                most: int) -> DataFrame:
    """Join by ``row`` with a written table that is sent around if it has at most ``most`` bytes."""
    size = small.agg(F.sum(values), F.count("*")).first()
    fits = (size[0] or 0) + 64 * size[1] <= most
    return texts.join(F.broadcast(small) if fits else small, "row", how)


def repeated_bytes(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, seed: int = 32,
    hot: int = 20_000, docs_per_bucket: int = 2_000, broadcast_bytes: int = 64 << 20,
    segment: int = _SEGMENT,
) -> DataFrame:
    """Every row's key with ``n_bytes``, ``n_removed``, ``spans`` and ``kept`` of its text in UTF-8.

    Removed is each byte of a string of ``length`` bytes that also starts earlier: in a row
    with a smaller key (an integer; nulls come last), or earlier in the same text. Strings
    overlap, and are judged on the input. ``spans`` are the maximal removed runs (start, end),
    ``kept`` the other bytes joined. A null text is empty; texts shorter than ``length``
    lose nothing. Rows that repeat both key and text are one document; of rows with one key
    and different texts, none is earlier by the key, and the place decides. Other columns
    are not read.

    The text is read three times. Only what stands around repeated anchors is moved, once per
    task and content. A group of more than ``hot`` occurrences of an anchor is dealt out again
    by the windows' own content, so no task gets it whole. Positions and spans are joined to
    the texts by sending them around if they have at most ``broadcast_bytes``, else by a shuffle.
    Anchors are looked for in ``segment`` bytes at a time, which changes no result.
    """
    buckets = max(8, math.ceil(docs.count() / docs_per_bucket))
    base = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(int(_LAST))).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    binary = "anchor binary, times binary, row binary, start binary"
    anchors = written(map_batches(
        base.select("row", "text"), _find_anchors(length, seed, buckets, segment),
        "bucket long, " + binary), "anchors", _TEXTS)
    spot = "row long, start int, anchor long, hot boolean"
    dealt = anchors.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    first = written(map_batches(dealt, _repeated_anchors(hot), spot), "spots")
    local = map_batches(anchors.where("bucket < 0"), _local_anchors, spot)
    heated = first.where("hot").select("anchor").distinct()
    if heated.head(1):
        local = local.drop("hot").join(heated.withColumn("hot", F.lit(True)), "anchor", "left") \
            .select("row", "start", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    marks = written(first.union(local).groupBy("row").agg(F.collect_set(
        F.col("start") * 2 + F.col("hot").cast("int")).alias("spots")), "marks")
    for used in (anchors, first):
        forget(used)
    around = _with_small(base, marks, 4 * F.size("spots"), "inner", broadcast_bytes)
    strings = written(map_batches(
        around.select("row", "key", "text", "spots"), _strings(length, seed, buckets, segment),
        "bucket long, anchor binary, around binary, key binary, row binary, start binary,"
        " count binary, data binary"), "strings", _TEXTS)
    dealt = strings.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    found = map_batches(dealt, _repeats(length), "row long, spans binary").union(map_batches(
        strings.where("bucket < 0"), _local_spans(length), "row long, spans binary"))
    spans = written(map_batches(
        found.groupBy("row").agg(F.collect_list("spans").alias("spans")), _merge,
        "row long, spans binary"), "spans")
    for used in (marks, strings):
        forget(used)
    kind = docs.schema[key].dataType
    cut = _with_small(
        docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).alias("key"),
                    F.col(text).alias("text")),
        spans, F.octet_length("spans"), "left", broadcast_bytes)
    return map_batches(
        cut.select("key", "text", "spans"), _cut(to_arrow_type(kind)),
        f"key {kind.simpleString()}, n_bytes long, n_removed long,"
        " spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("key", key)
