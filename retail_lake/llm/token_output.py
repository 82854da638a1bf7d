"""Packed id matrices by best-fit decreasing, with cumulative lengths and position resets.

Texts become ids plus an end id. Those longer than the window are split without loss into full
windows and a rest. Pieces are packed batch by batch inside each task, largest first, each into
the open row whose room is smallest but enough; a segment tree over room sizes finds it. Rows are
fixed-width matrix rows of unsigned 16- or 32-bit ids, little-endian, padded with ``pad_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from retail_lake.llm.common import keyed_texts
from retail_lake.llm.tokens import encoder

WINDOW = 2048
#: Pieces held by a task before they are packed; at most this many windows of ids in memory.
PIECES_PER_BATCH = 4_096
SCHEMA = (
    "sequence_id long, ids binary, id_bytes int, length int, doc_ids array<long>, "
    "doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>"
)


class RoomTree:
    """How many open rows have each amount of room; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        at = self.width + room
        while at:
            self.counts[at] += by
            at >>= 1

    def least(self, size: int) -> int:
        """The least room of at least ``size`` that an open row has; -1 if none has."""
        counts, at = self.counts, self.width + size
        if counts[at]:
            return size
        while at > 1:
            if not at & 1 and counts[at + 1]:  # a right sibling holds larger rooms
                at += 1
                while at < self.width:
                    at = 2 * at if counts[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers: best-fit decreasing, equal sizes in their given order."""
    tree, open_rows, rows = RoomTree(capacity), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.least(sizes[i])
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def pack_matrix(
    docs: DataFrame,
    key: str,
    text: str,
    vocabulary: str,
    ranks: str | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    pad_id: int = 0,
    pieces: int = PIECES_PER_BATCH,
) -> DataFrame:
    """One row per packed sequence.

    ``cu_seqlens`` runs from 0 to the filled length; ``position_resets`` are the places where the
    position counter starts from 0 again. Piece j of a row comes from ``doc_ids[j]``, from its id
    number ``doc_starts[j]`` on. Null and empty texts are the end id alone, null keys stay null,
    repeated rows are packed one by one, a table without rows gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, ranks)
        kind = np.dtype("<u2" if max(tool.whole.get_vocab_size(), end_id + 1, pad_id + 1) <= 1 << 16 else "<u4")
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        held: list[tuple[int | None, int, np.ndarray]] = []

        def rows_of(pieces: list[tuple[int | None, int, np.ndarray]]) -> list[tuple]:
            nonlocal serial
            rows = []
            for row in best_fit([len(p[2]) for p in pieces], window):
                mine = [pieces[i] for i in row]
                ends = np.cumsum([0, *(len(p[2]) for p in mine)]).tolist()
                line = np.full(window, pad_id, dtype=kind)
                line[: ends[-1]] = np.concatenate([p[2] for p in mine])
                ids = line.tobytes()
                rows.append((serial, ids, kind.itemsize, ends[-1], [p[0] for p in mine], [p[1] for p in mine], ends, ends[:-1]))
                serial += 1
            return rows

        for batch in batches:
            for chunk in range(0, batch.num_rows, 1_000):
                part = batch.slice(chunk, 1_000)
                rows: list[tuple] = []
                for doc, tokens in zip(part.column(0).to_pylist(), encoder(vocabulary, ranks).encode(part.column(1)), strict=True):
                    ids = np.append(tokens, np.uint32(end_id)).astype(kind)
                    whole = len(ids) // window * window
                    for at in range(0, whole, window):
                        rows += rows_of([(doc, at, ids[at : at + window])])
                    if whole < len(ids):
                        held.append((doc, whole, ids[whole:]))
                if len(held) >= pieces:
                    rows += rows_of(held)
                    held = []
                yield _batch(rows)
        yield _batch(rows_of(held))

    return keyed_texts(docs, key, text).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "sequence_id": pa.int64(),
        "ids": pa.binary(),
        "id_bytes": pa.int32(),
        "length": pa.int32(),
        "doc_ids": pa.list_(pa.int64()),
        "doc_starts": pa.list_(pa.int64()),
        "cu_seqlens": pa.list_(pa.int32()),
        "position_resets": pa.list_(pa.int32()),
    }
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def positions(cu_seqlens: list[int], window: int) -> np.ndarray:
    """The position of each id of a row; counting starts anew in every segment and in the padding."""
    ends = np.array([*cu_seqlens, window])
    return np.arange(window) - np.repeat(ends[:-1], np.diff(ends))


def write_matrix(packed: DataFrame, path: str) -> None:
    """The rows as Parquet files of fixed-width binary rows."""
    packed.write.mode("overwrite").parquet(path)
