"""Token windows of nearly equal fill by multiway differencing (Karmarkar and Karp).

Every text becomes ids plus an end id. Full windows are cut off its front; the remainder is cut
into pieces of at most ``piece`` ids. Pieces are packed in batches inside each task: a batch of
pieces is divided into k windows of nearly equal sum, and k rises until no window exceeds the
capacity. No shuffle is needed, memory is bounded by one batch, and a lost task is repeated with
the same result, since the order of rows in an input split is fixed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from retail_lake.llm.common import keyed_texts
from retail_lake.llm.memory import lean
from retail_lake.llm.tokens import encoder

WINDOW = 2048
PIECE = 256
#: A batch is packed once its pieces fill so many windows.
WINDOWS_PER_BATCH = 96
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def divide(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing: a part (0 to k - 1) for each size, and the sums of the parts.

    A partial partition is the descending list of the sums of its non-empty parts. The two with
    the largest difference between their largest and smallest part are merged, the largest part
    of one with the smallest of the other, until a single partition is left.
    """
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum()] + [0] * (k - 1))
    order = np.argsort(-sizes, kind="stable").tolist()
    parent = list(range(n))  # pieces of one part form a tree
    # entries: (-difference, number, sums in descending order, a piece of each part)
    heap = [(-int(sizes[i]), j, [int(sizes[i])], [i]) for j, i in enumerate(order)]
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        room = k - len(a)  # parts of a that are empty take the largest of b
        if len(b) <= room:
            sums, items = a + b, ia + ib
        else:
            sums, items = a[:], ia[:]
            last = len(a) - 1
            for j in range(room, len(b)):  # the next largest of b go to the smallest of a
                at = last - (j - room)
                sums[at] += b[j]
                parent[ib[j]] = items[at]
            sums += b[:room]
            items += ib[:room]
        ranked = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in ranked]
        items = [items[i] for i in ranked]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (low - sums[0], number, sums, items))
        number += 1
    _, _, sums, items = heap[0]
    part = {root: i for i, root in enumerate(items)}
    found = np.empty(n, dtype=np.int64)
    for i in range(n):
        root = i
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        found[i] = part[root]
    return found, np.array(sums + [0] * (k - len(sums)), dtype=np.int64)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size, none over ``capacity``; sizes must not exceed it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, sums = divide(sizes, k)
        if sums.max(initial=0) <= capacity:
            return part
        k += 1


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    vocabulary: str,
    ranks: str | None = None,
    window: int = WINDOW,
    piece: int = PIECE,
    end_id: int = 1,
    batch_windows: int = WINDOWS_PER_BATCH,
) -> DataFrame:
    """One row per piece: its document, place there, window, place in the window, and ids.

    Null and empty texts are the end id alone. A null key stays null; repeated rows are packed
    one by one. ``ids`` holds little-endian unsigned 32-bit numbers. Tables without rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks).encode
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 33
        serial = 0
        pending: list[tuple] = []
        held = 0

        def settle() -> tuple[list, int]:
            part = windows(np.array([p[2] for p in pending], dtype=np.int64), window)
            used: dict[int, list[int]] = {}  # part -> its number and fill
            rows = []
            for p, w in zip(pending, part.tolist(), strict=True):
                mine = used.setdefault(w, [serial + len(used), 0])
                rows.append((*p[:4], task + mine[0], mine[1], p[4]))
                mine[1] += p[2]
            return rows, serial + len(used)

        for batch in batches:
            for chunk in range(0, batch.num_rows, 2_000):
                part = batch.slice(chunk, 2_000)
                rows: list[tuple] = []
                keys = part.column(0).to_pylist()
                for doc, tokens in zip(keys, encode(part.column(1)), strict=True):
                    total = len(tokens) + 1
                    raw = np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes()
                    whole = total // window * window
                    for at in range(0, whole, window):
                        rows.append((doc, at, window, total, task + serial, 0, raw[at * 4 : (at + window) * 4]))
                        serial += 1
                    for at in range(whole, total, piece):
                        size = min(piece, total - at)
                        pending.append((doc, at, size, total, raw[at * 4 : (at + size) * 4]))
                        held += size
                    if held >= batch_windows * window:
                        done, serial = settle()
                        rows += done
                        pending, held = [], 0
                yield _batch(rows)
        if pending:
            rows, serial = settle()
            yield _batch(rows)

    return keyed_texts(docs, key, text).mapInArrow(lean(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)
