"""Removal of repeated byte strings with two-stage suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller id. Every window of that length has one anchor: its least hashed gram of GRAM bytes,
leftmost. Equal windows have equal anchors, so windows are compared only where an anchor occurs in
several different texts. The stretch of a document whose windows share an anchor travels to the
anchor's bucket; there one suffix array over the different stretches brings equal windows together.

Steps: anchors of all texts, packed per bucket of hashes -> anchors found in two texts or more ->
stretches around them -> suffix arrays per bucket -> byte spans per document. Equal texts are
compared as one. Buckets follow from the number of bytes, so their size does not grow.

A passage may stand in a third of all texts. What a task can tell alone it does not send to the
bucket: an anchor it met in many texts is shared by them, and two of these texts speak for it; a
stretch it met in a smaller document is gone, and the smallest document speaks for it. Such rows
take part under a number of their task (below zero), so no group holds all rows of a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.words import hash_spans, mix, slices
from retail_lake.session import freeze

LENGTH = 50
GRAM = 24
#: Bytes of text per bucket of anchors, and anchors a task packs together.
BUCKET_BYTES, PACKED = 3 << 20, 500_000
#: Bytes of text a task looks at together; working memory is about a hundred times that.
SLICE = 1_000_000
#: Texts of a pack from which an anchor is settled by the task, and stretches a task remembers.
SEVERAL, REMEMBERED = 8, 200_000
NO_ID = (1 << 63) - 1  # stands for a null id, after all others


# --- suffix arrays -------------------------------------------------------------------------


def _words(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """At every position the next ``depth`` bytes as big-endian numbers of eight bytes."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    pair = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (pair[:-2] << np.uint64(16)) | pair[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    return [eight[j : j + len(data)] for j in range(0, depth, 8)]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` bytes, at least.

    Two stages: suffixes smaller than their successor are sorted directly. The others follow from
    one ascending scan over the buckets of first bytes: a suffix larger than its successor stands
    in its bucket in the order of the successors, before all directly sorted suffixes. A bucket is
    placed in waves, since within it a suffix may only follow from one placed just before.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    after = np.append(data[1:].astype(np.int16), -1)  # the end is smaller than any byte
    differs = np.flatnonzero(data.astype(np.int16) != after)
    decides = differs[np.searchsorted(differs, np.arange(n))]  # of a run of equal bytes, its end
    small = data.astype(np.int16)[decides] < after[decides]

    direct = np.flatnonzero(small)
    if len(direct):
        direct = _sorted_by(direct, _words(data, -(-depth // 8) * 8))
    firsts = data[direct]
    bounds = np.searchsorted(firsts, np.arange(257))

    pending: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(placed: np.ndarray) -> None:
        """The larger predecessors of placed suffixes, in order, to their buckets."""
        before = placed[placed > 0] - 1
        before = before[~small[before]]
        heads = data[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts):
            if len(part):
                pending[data[part[0]]].append(part)

    out = []
    hand_on(np.array([n]))  # the empty suffix is the smallest
    for byte in range(256):
        while pending[byte]:
            wave = np.concatenate(pending[byte])
            pending[byte] = []
            out.append(wave)
            hand_on(wave)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            hand_on(own)
    return np.concatenate(out)


def _sorted_by(items: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Items by what the keys hold for them, the first key first; only ties look at the next key."""
    value = keys[0][items]
    order = np.argsort(value, kind="stable")
    group = np.cumsum(np.append(0, np.diff(value[order]) != 0))
    for key in keys[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        rows = order[tied]
        value = key[items[rows]]
        inner = np.lexsort((value, group[tied]))
        order[tied] = rows[inner]
        values = np.zeros(len(order), dtype=np.uint64)
        values[tied] = value[inner]
        group = np.cumsum(np.append(0, (np.diff(group) != 0) | (np.diff(values) != 0)))
    return items[order]


def equal_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class number for each window start; equal windows have equal numbers.

    The suffix array brings equal windows together; neighbours whose common prefix has at least
    ``length`` bytes are equal.
    """
    wanted = np.zeros(len(data), dtype=bool)
    wanted[starts] = True
    order = suffix_array(data, length)
    order = order[wanted[order]]
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for j, word in enumerate(_words(data, -(-length // 8) * 8)):
        left = length - 8 * j
        mask = np.uint64(2**64 - 1) if left >= 8 else ~np.uint64((1 << (8 * (8 - left))) - 1)
        value = word[order] & mask
        same &= value[1:] == value[:-1]
    number = np.zeros(len(data), dtype=np.int64)
    number[order] = np.cumsum(np.append(0, ~same)) if len(order) else 0
    return number[starts]


# --- anchors ---------------------------------------------------------------------------------


def anchors(values: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Joined bytes, and per anchor: hash, its text, first and last window start that have it."""
    raw = [v or b"" for v in values.to_pylist()]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    grams = length - GRAM + 1
    if len(data) < length:
        empty = np.zeros(0, dtype=np.int64)
        return data, ends - sizes, empty.view(np.uint64), empty, empty, empty
    a, b, c = _words(data, GRAM)
    hashes = mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + mix(c)))
    # the place in the low bits: the least value is the least hash, leftmost
    low = 32
    least = (hashes >> np.uint64(low) << np.uint64(low)) | np.arange(len(data), dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    least = least[: len(data) - length + 1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(least)) + length <= ends[owner[: len(least)]])
    at = (least[start] & np.uint64((1 << low) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(start) != 1))) if len(at) else at
    last = np.append(new[1:], len(at))[: len(new)] - 1
    return data, ends - sizes, hashes[at[new]], owner[at[new]], start[new], start[last]


def _own_bucket() -> int:
    """The group, below zero, of what this task has settled alone."""
    context = TaskContext.get()
    return -1 - (context.partitionId() if context else 0)


def _settled(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different (text, anchor): which are known as shared, and which the bucket must see.

    An anchor of SEVERAL texts is shared by all of them. Two of them go on, so that any other text
    with that anchor still meets a text that is not its equal.
    """
    order = np.lexsort((keys, hashes))
    head = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0)) if len(order) else np.zeros(0, int)
    sizes = np.diff(np.append(head, len(order)))
    shared = np.zeros(len(order), dtype=bool)
    shared[order] = np.repeat(sizes >= SEVERAL, sizes)
    seen = ~shared
    seen[order[head]] = True
    seen[order[head + sizes - 1]] = True
    return shared, seen


def _anchor_lists(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """(bucket, texts, counts, hashes): packed anchors, each once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        own = _own_bucket()

        def packed() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held] or [np.zeros(0, np.int64)])
            hashes = np.concatenate([h[1] for h in held] or [np.zeros(0, np.uint64)])
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((hashes, keys, bucket))
            keys, hashes, bucket = keys[order], hashes[order], bucket[order]
            fresh = np.append(True, (np.diff(keys) != 0) | (np.diff(hashes) != 0)) if len(keys) else np.zeros(0, bool)
            keys, hashes, bucket = keys[fresh], hashes[fresh], bucket[fresh]
            shared, seen = _settled(keys, hashes)
            by_text = np.flatnonzero(shared)[np.argsort(keys[shared], kind="stable")]
            row = np.concatenate([by_text, np.flatnonzero(seen)])
            bucket = np.concatenate([np.full(len(by_text), own), bucket[seen]])
            keys, hashes = keys[row], hashes[row]
            rows = ([], [], [], [])
            for a, b in _cuts(bucket):
                for column, x in zip(rows, (int(bucket[a]), *_pack(keys[a:b], hashes[a:b])), strict=True):
                    column.append(x)
            arrays = [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "texts", "counts", "hashes"])

        for batch in batches:
            done = 0
            for values in slices(batch.column(1), SLICE):
                keys = batch.column(0).slice(done, len(values)).to_numpy(zero_copy_only=False)
                done += len(values)
                _, _, hashes, owner, _, _ = anchors(values, length)
                held.append((keys[owner], hashes))
                size += len(hashes)
                if size >= PACKED:
                    yield packed()
                    held, size = [], 0
        yield packed()

    return texts.select("same", "text").mapInArrow(run, "bucket long, texts binary, counts binary, hashes binary")


def _unpacked(texts: list[bytes], counts: list[bytes], hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, anchors), one entry each per pair."""
    keys = [np.zeros(0, np.int64)]
    for a, b in zip(texts, counts, strict=True):
        names = np.frombuffer(a, np.int64)
        keys.append(np.repeat(names, np.frombuffer(b, np.uint16 if len(b) == 2 * len(names) else np.uint32)))
    return np.concatenate(keys), np.frombuffer(b"".join(hashes), np.uint64)


def _pack(keys: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The inverse, of pairs in which those of a text stand together."""
    head = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(head, len(keys)))
    kind = np.uint16 if len(keys) < 65_536 else np.uint32
    return keys[head].tobytes(), counts.astype(kind).tobytes(), hashes.tobytes()


def _cuts(groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of equal numbers."""
    edges = np.append(np.flatnonzero(np.append(True, np.diff(groups) != 0)), len(groups)) if len(groups) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _shared(lists: DataFrame, bits: int) -> DataFrame:
    """(same, hashes): per text the anchors that another text has too.

    A bucket of anchors gives one packed row; tasks deal what these hold out to buckets of texts.
    """
    schema = "bucket long, texts binary, counts binary, hashes binary"

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, hashes = _unpacked(*(table.column(n).to_pylist() for n in ("texts", "counts", "hashes")))
        order = np.lexsort((keys, hashes))
        keys, hashes = keys[order], hashes[order]
        new_hash = np.append(True, np.diff(hashes) != 0)[: len(hashes)]
        new_pair = new_hash | np.append(True, np.diff(keys) != 0)[: len(keys)]
        keys, hashes, new_hash = keys[new_pair], hashes[new_pair], new_hash[new_pair]
        size = np.bincount(np.cumsum(new_hash) - 1) if len(keys) else np.zeros(0, int)
        many = (np.repeat(size, size) > 1) | (bucket < 0)
        keys, hashes = keys[many], hashes[many]
        order = np.argsort(keys, kind="stable")
        packed = _pack(keys[order], hashes[order])
        return pa.table({"bucket": pa.array([bucket], pa.int64()), **{n: pa.array([x], pa.binary()) for n, x in zip(("texts", "counts", "hashes"), packed)}})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            keys, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((keys, bucket))
            keys, hashes, bucket = keys[order], hashes[order], bucket[order]
            rows = [(int(bucket[a]), *_pack(keys[a:b], hashes[a:b])) for a, b in _cuts(bucket)]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "texts", "counts", "hashes"])

        for batch in batches:
            for a, b, c in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                held.append(_unpacked([a], [b], [c]))
                if sum(len(h[0]) for h in held) >= PACKED:
                    yield dealt()
                    held = []
        if held:
            yield dealt()

    def per_text(table: pa.Table) -> pa.Table:
        keys, hashes = _unpacked(*(table.column(n).to_pylist() for n in ("texts", "counts", "hashes")))
        order = np.lexsort((hashes, keys))
        keys, hashes = keys[order], hashes[order]
        fresh = np.append(True, (np.diff(keys) != 0) | (np.diff(hashes) != 0))[: len(keys)]
        keys, hashes = keys[fresh], hashes[fresh]
        edges = list(_cuts(keys))
        offsets = pa.array([a for a, _ in edges] + [len(keys)], pa.int32())
        anchors_of = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
        return pa.table({"same": pa.array([keys[a] for a, _ in edges], pa.int64()), "hashes": anchors_of})

    packed = lists.groupBy("bucket").applyInArrow(run, schema)
    return packed.mapInArrow(deal, schema).groupBy("bucket").applyInArrow(per_text, "same long, hashes array<long>")


# --- stretches and spans -----------------------------------------------------------------------


def _names(data: np.ndarray, total: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number per stretch; equal stretches of one anchor have equal numbers."""
    cuts = [*range(0, len(sizes), 10_000), len(sizes)]
    parts = [hash_spans(data[total[a] : total[b]], total[a:b] - total[a], sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
    return mix(np.concatenate([np.zeros(0, np.uint64), *parts]) + mix(sizes.astype(np.uint64)) + hashes)


class _Smallest:
    """The smallest document, so far, of stretches that a task met more than once."""

    def __init__(self) -> None:
        self.names, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, names: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Per stretch the smallest document known to have it, itself included."""
        different, kind, count = np.unique(names, return_inverse=True, return_counts=True)
        least = _group_first(kind, docs, len(different))
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, different), len(self.names) - 1)
            known = self.names[at] == different
            least[known] = np.minimum(least[known], self.docs[at[known]])
            count[known] = 2
        again = count > 1
        if len(self.names) + again.sum() > REMEMBERED:
            self.names, self.docs = self.names[:0], self.docs[:0]
        joint, where = np.unique(np.concatenate([self.names, different[again]]), return_inverse=True)
        self.docs = _group_first(where, np.concatenate([self.docs, least[again]]), len(joint))
        self.names = joint
        return least[kind]


def _stretches(rows: DataFrame, length: int, bits: int) -> DataFrame:
    """Per bucket, the stretches around shared anchors: packed arrays and their bytes.

    Below zero: stretches, without bytes, that a smaller document of the same task has as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, smallest = _own_bucket(), _Smallest()
        for batch in batches:
            done = 0
            for values in slices(batch.column(2), SLICE):
                part = batch.slice(done, len(values))
                done += len(values)
                data, begins, hashes, owner, first, last = anchors(values, length)
                wanted = part.column(3)
                counts = np.diff(wanted.offsets.to_numpy())
                pairs_h = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                pairs_o = np.repeat(np.arange(len(counts)), counts)
                # an anchor is wanted if its hash is in the list of its own text
                keep = np.isin(mix(hashes + owner.astype(np.uint64)), mix(pairs_h + pairs_o.astype(np.uint64)))
                hashes, owner, first, last = hashes[keep], owner[keep], first[keep], last[keep]
                sizes = last - first + length
                total = np.concatenate([[0], np.cumsum(sizes)])
                text = data[np.arange(total[-1]) - np.repeat(total[:-1] - first, sizes)]
                docs = part.column(1).to_numpy(zero_copy_only=False)[owner]
                gone = docs > smallest.of(_names(text, total, sizes, hashes), docs)
                bucket = np.where(gone, own, (hashes >> np.uint64(64 - bits)).astype(np.int64))
                order = np.argsort(bucket, kind="stable")
                hashes, owner, first, sizes, docs, bucket = (x[order] for x in (hashes, owner, first, sizes, docs, bucket))
                held = np.where(bucket < 0, 0, sizes)  # bytes that go along
                total = np.concatenate([[0], np.cumsum(held)])
                text = data[np.arange(total[-1]) - np.repeat(total[:-1] - first, held)]
                rids = part.column(0).to_numpy(zero_copy_only=False)[owner]
                place = first - begins[owner]
                out: list[list] = [[] for _ in range(7)]
                for a, b in _cuts(bucket):
                    line = (rids[a:b], docs[a:b], hashes[a:b], place[a:b], sizes[a:b].astype(np.uint16), text[total[a] : total[b]])
                    out[0].append(int(bucket[a]))
                    for j, x in enumerate(line):
                        out[j + 1].append(x.tobytes())
                arrays = [pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "rids", "docs", "hashes", "places", "sizes", "bytes"])

    schema = "bucket long, rids binary, docs binary, hashes binary, places binary, sizes binary, bytes binary"
    return rows.select("rid", "doc", "text", "hashes").mapInArrow(run, schema)


def _group_first(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each key."""
    out = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(out, keys, values)
    return out


def covered(stretches: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rid, doc, start, end) of the bytes that a smaller document has too, per run of windows."""
    rids, docs, hashes, places, sizes, data = stretches
    total = np.concatenate([[0], np.cumsum(sizes)])
    # equal stretches of one anchor are one text of the suffix array
    names = _names(data, total, sizes, hashes)
    _, example, kind = np.unique(names, return_index=True, return_inverse=True)
    first_doc = _group_first(kind, docs, len(example))
    # the other stretches of the anchor: only those with several need a suffix array
    _, anchor = np.unique(hashes[example], return_inverse=True)
    several = np.bincount(anchor)[anchor] > 1
    windows = sizes - length + 1
    kind_windows = windows[example]
    begin = np.concatenate([[0], np.cumsum(kind_windows)])
    least = np.repeat(first_doc, kind_windows)  # per stretch and window: the smallest document
    chosen = np.flatnonzero(several)
    chosen = chosen[np.argsort(anchor[chosen], kind="stable")]
    # a suffix array for as many anchors as make about SLICE bytes
    new = np.append(True, np.diff(anchor[chosen]) != 0) if len(chosen) else np.zeros(0, bool)
    part = np.maximum.accumulate(np.where(new, np.cumsum(sizes[example[chosen]]) // SLICE, 0))
    for own in np.split(chosen, np.flatnonzero(np.diff(part)) + 1):
        if not len(own):
            continue
        n = sizes[example[own]]
        upto = np.concatenate([[0], np.cumsum(n)])
        text = data[np.arange(upto[-1]) + np.repeat(total[example[own]] - upto[:-1], n)]
        w = kind_windows[own]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        number = equal_windows(text, np.repeat(upto[:-1], w) + inner, length)
        smallest = _group_first(number, np.repeat(first_doc[own], w), number.max() + 1)
        least[np.repeat(begin[own], w) + inner] = smallest[number]
    out = []
    for at in range(0, len(windows), 20_000):
        w = windows[at : at + 20_000]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        gone = np.repeat(docs[at : at + len(w)], w) > least[np.repeat(begin[kind[at : at + len(w)]], w) + inner]
        owner, inner = np.repeat(np.arange(at, at + len(w)), w)[gone], inner[gone]
        if len(owner):
            new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(inner) != 1)))
            last = np.append(new[1:], len(owner)) - 1
            of = owner[new]
            out.append((rids[of], docs[of], places[of] + inner[new], places[of] + inner[last] + length))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip((none,) * 4, *out, strict=True))


def _spans(stretches: DataFrame, length: int) -> DataFrame:
    """(rid, doc, start, stop) of covered bytes, from every bucket."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int64, np.uint64, np.int64, np.uint16, np.uint8)
        columns = [np.frombuffer(b"".join(table.column(j + 1).to_pylist()), kind) for j, kind in enumerate(kinds)]
        columns[4] = columns[4].astype(np.int64)
        if table.column("bucket")[0].as_py() < 0:
            rids, docs, _, places, sizes, _ = columns
            found = rids, docs, places, places + sizes
        else:
            found = covered(tuple(columns), length)
        return pa.table(dict(zip(("rid", "doc", "start", "stop"), map(pa.array, found), strict=True)))

    return stretches.groupBy("bucket").applyInArrow(run, "rid long, doc long, start long, stop long")


def unite(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(ends))[: len(at)] - 1]


def _cut_out(rows: DataFrame, with_text: bool) -> DataFrame:
    """The result per document; the remaining bytes are text of which whole bytes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: list[list] = [[] for _ in range(6)]
            for doc, text, starts, stops in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = (text or "").encode()
                low, high = unite(*(np.array(side or [], dtype=np.int64) for side in (starts, stops)))
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                line = (None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept)
                for column, x in zip(out, line, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            wanted = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)][:wanted], names[:wanted])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(run, schema + (", kept binary" if with_text else ""))


def remove_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document row: n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept).

    Null and empty texts have no bytes. A null id counts as larger than any other; rows with equal
    ids do not remove each other's bytes. Lengths from GRAM to 30,000 are possible. Empty tables give
    no rows.
    """
    base = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    base = base.withColumn("same", F.xxhash64("text")).withColumn("rid", F.xxhash64("doc", F.md5("text")))
    ids = freeze(base.select("doc", "same", "rid", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n")))
    first = ids.groupBy("digest", "same").agg(F.min("doc").alias("first"), F.first("n").alias("n"))
    first = freeze(first.withColumn("rid", F.xxhash64("first", "digest")))
    size = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (size // BUCKET_BYTES).bit_length())
    shared = freeze(_shared(_anchor_lists(base, length, bits), max(1, bits - 3)))
    wanted = shared.join(first.select("same", "rid"), "same").select("rid", "hashes")
    rows = base.select("rid", "doc", "text")
    # a row that repeats another one whole would be compared with it in vain, but does no harm
    spans = _spans(_stretches(rows.join(wanted, "rid"), length, bits), length)
    copies = (
        ids.join(first.select("digest", "first"), "digest")
        .filter((F.col("doc") > F.col("first")) & (F.col("n") >= length))
        .select("rid", "doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
        .distinct()
    )
    per_doc = (
        spans.unionByName(copies)
        .groupBy("rid", F.col("doc").alias("same_doc"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # bounded by the text's anchors
    )
    joined = rows.join(per_doc, "rid", "left")
    fits = F.col("doc") == F.col("same_doc")  # another document under the same hash does not count
    return _cut_out(
        joined.select("doc", "text", F.when(fits, F.col("spans.start")).alias("starts"), F.when(fits, F.col("spans.stop")).alias("stops")),
        with_text,
    )
