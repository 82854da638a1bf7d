"""Text quality by random-indexing word vectors and a small neural network.

Every word row and every shape row has a fixed sparse index vector of a few +1 and -1. Over the
whole corpus, a row's vector is the sum of the index vectors of its neighbours' rows. A text is
the mean of its words' vectors beside the mean of its shapes' vectors; a two-layer network on
that, with its temperature fitted on rows it has not seen, gives the probability.

Words are hashed to a fixed number of rows, so the vectors have a fixed size (ROWS x DIMS) at any
corpus size: they can be sent to all tasks, and nothing is left out of the counts. The network is
fitted on at most ``sample`` labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.memory import lean
from retail_lake.llm.words import SPACED, find, hash_spans, slices

WORD_ROWS, SHAPE_ROWS, DIMS, NONZERO = 1 << 14, 256, 64, 4
ROWS = WORD_ROWS + SHAPE_ROWS
#: Neighbours on either side that count as context.
REACH = 2
#: Labelled rows used for fitting, at most.
SAMPLE = 8_000
BLOCK = 1_024
#: Bytes of text looked at together, in place of the usual slice: half of its working memory.
PART = 1_000_000
_random = np.random.default_rng(7)
_PLACES = np.argsort(_random.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
_SIGNS = np.tile(np.array([1.0, -1.0] * (NONZERO // 2)), (ROWS, 1))
#: The places, with those of -1 after all of +1.
_SIGNED_PLACES = (_PLACES + np.where(_SIGNS < 0, DIMS, 0)).astype(np.int32)
_LETTER, _UPPER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True


@dataclass
class Units:
    """Word row and shape row of every word, and the word numbers at which the texts begin."""

    words: np.ndarray
    shapes: np.ndarray
    first: np.ndarray


def units(values: pa.Array) -> Units:
    """A word's row is a hash of it without case; its shape tells its case and digits, how it ends,
    and whether the word or its whole line came before."""
    found = find(values, SPACED)
    n = len(found.starts)
    if not n:
        return Units(np.zeros(0, np.int64), np.zeros(0, np.int64), found.first)
    hashes = found.hashes()
    raw = np.frombuffer(b" ".join([*(v or b"" for v in values.to_pylist()), b""]), dtype=np.uint8)
    ends = found.starts + found.sizes

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[found.starts]

    letters, upper, digits = per_word(_LETTER[raw]), per_word(_UPPER[raw]), per_word(_DIGIT[raw])
    other = found.sizes - letters - digits
    case = np.select([letters == 0, upper == 0, (upper >= 2) & (2 * upper >= letters), _UPPER[raw[found.starts]]], [0, 1, 2, 3], 4)
    tail = raw[ends - 1]
    ending = np.select([other == 0, (other == 1) & (tail == 46), (other == 1) & (tail == 44), other == 1], [0, 1, 2, 3], 4)
    owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    again = np.zeros(n, dtype=bool)
    for back in (1, 2, 3):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
    shape = (((case * 5 + ending) * 2 + (digits > 0)) * 2 + again) * 2 + _in_old_line(found.data, found.starts, owner)
    return Units((hashes >> np.uint64(50)).astype(np.int64), WORD_ROWS + shape, found.first)


def _in_old_line(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a word stands in a line that its text has had before."""
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(owner) != 0)))
    stop = np.append(starts[new[1:]], len(data))
    hashes = hash_spans(data, starts[new], stop - starts[new])
    keys = hashes ^ (owner[new].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    old = np.ones(len(new), dtype=bool)
    old[first] = False
    return np.repeat(old, np.diff(np.append(new, len(starts))))


class Sums:
    """Sums of the neighbours' index vectors for every row.

    Between words they are added up place by place, the negative ones apart. Shapes are few, so for them
    the neighbours are only counted; a pair counts both ways, so one table serves words beside shapes and
    shapes beside words.
    """

    def __init__(self):
        self.words = np.zeros(WORD_ROWS * 2 * DIMS, np.int64)
        self.mixed = np.zeros(WORD_ROWS * SHAPE_ROWS, np.int64)
        self.shapes = np.zeros(SHAPE_ROWS * SHAPE_ROWS, np.int64)

    def add(self, u: Units) -> None:
        owner = np.repeat(np.arange(len(u.first) - 1), np.diff(u.first))
        near = [(at, at + step) for step in range(1, REACH + 1) for at in [np.flatnonzero(owner[step:] == owner[:-step])]]
        a = np.concatenate([*(x for x, _ in near), *(y for _, y in near)])
        b = np.concatenate([*(y for _, y in near), *(x for x, _ in near)])
        shapes = u.shapes - WORD_ROWS
        at = _SIGNED_PLACES[u.words[b]] + (u.words[a] * (2 * DIMS)).astype(np.int32)[:, None]
        # in place: counts of their own would be as large as the sums
        np.add.at(self.words, at.ravel(), 1)
        np.add.at(self.mixed, u.words[a] * SHAPE_ROWS + shapes[b], 1)
        self.shapes += np.bincount(shapes[a] * SHAPE_ROWS + shapes[b], minlength=len(self.shapes))

    def whole(self) -> np.ndarray:
        """ROWS x DIMS; products are of whole numbers that a double holds exactly."""
        signed = self.words.reshape(WORD_ROWS, 2, DIMS)
        mixed = self.mixed.reshape(WORD_ROWS, SHAPE_ROWS)
        index = np.zeros((ROWS, DIMS))
        np.put_along_axis(index, _PLACES, _SIGNS, axis=1)
        of_words, of_shapes = index[:WORD_ROWS], index[WORD_ROWS:]
        words = signed[:, 0] - signed[:, 1]
        shapes = self.shapes.reshape(SHAPE_ROWS, SHAPE_ROWS).astype(np.float64) @ of_shapes
        for i in range(0, WORD_ROWS, BLOCK):
            part = mixed[i : i + BLOCK].astype(np.float64)
            words[i : i + BLOCK] += (part @ of_shapes).astype(np.int64)
            shapes += part.T @ of_words[i : i + BLOCK]
        return np.concatenate([words, shapes.astype(np.int64)])


def contexts(texts: DataFrame) -> np.ndarray:
    """The vectors of all rows, of length one, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for values in slices(batch.column(0), PART):
                sums.add(units(values))
        whole = sums.whole()  # whole numbers: any order gives one sum
        blocks = [whole[i : i + BLOCK].tobytes() for i in range(0, ROWS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks)], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()])})

    schema = "block int, sums binary"
    rows = texts.mapInArrow(lean(run), schema).groupBy("block").applyInArrow(add, schema).collect()  # 17 rows, 8 MB
    sums = np.zeros((ROWS, DIMS))
    for row in rows:
        block = np.frombuffer(row["sums"], dtype=np.int64).reshape(-1, DIMS)
        sums[row["block"] * BLOCK : row["block"] * BLOCK + len(block)] = block
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(values: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text; zeros for a text without words."""
    u = units(values)
    out = np.zeros((len(values), 2 * DIMS))
    counts = np.diff(u.first)
    filled = np.flatnonzero(counts)
    begin = u.first[:-1][filled]
    if len(filled):  # a dimension at a time: its column stays in the cache
        for j, column in enumerate(np.ascontiguousarray(vectors.T)):
            out[filled, j] = np.add.reduceat(column[u.words], begin)
            out[filled, DIMS + j] = np.add.reduceat(column[u.shapes], begin)
        out[filled] /= counts[filled][:, None]
    return out


@dataclass
class Network:
    """Scaling, two layers and a temperature; ``base`` alone counts if there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 40, seed: int = 3) -> Network:
    """Adam on the log loss; every fifth row is kept apart for the temperature.

    Without rows every score is 0.5; with one label alone it is (ones + 1) / (rows + 2).
    """
    random = np.random.default_rng(seed)
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        flat = np.zeros((width, 1))
        return Network(np.zeros(width), np.ones(width), flat, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    apart = np.arange(len(y)) % 5 == 4
    xa, ya = x[~apart], y[~apart]
    net = Network(
        xa.mean(axis=0),
        xa.std(axis=0) + 1e-3,
        random.normal(0, 1 / np.sqrt(width), (width, hidden)),
        np.zeros(hidden),
        random.normal(0, 1 / np.sqrt(hidden), hidden),
        0.0,
    )
    xa = (xa - net.mean) / net.scale
    state = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    second = [s.copy() for s in state]
    step = 0
    for _ in range(rounds):
        order = random.permutation(len(ya))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            inner = np.tanh(xa[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-(inner @ net.w2 + net.b2))) - ya[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - inner**2)
            grads = [
                xa[rows].T @ back + 1e-3 * net.w1,
                back.sum(axis=0),
                inner.T @ error + 1e-3 * net.w2,
                np.array([error.sum()]),
            ]
            step += 1
            moves = []
            for g, m, v in zip(grads, state, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moves.append(3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1 -= moves[0]
            net.b1 -= moves[1]
            net.w2 -= moves[2]
            net.b2 -= float(moves[3][0])
    logits, ya = net.logits(x[apart]), y[apart]
    choices = np.geomspace(0.25, 8, 41)
    losses = [np.mean(np.logaddexp(0, logits / t) - ya * logits / t) for t in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def held_out(key: str):
    """Whether a row must not be learned from."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> tuple[Network, np.ndarray]:
    """Vectors from all texts; the network from labelled rows that are not held out.

    Rows with a null id or label and ids with contradicting labels teach nothing.
    """
    spark = docs.sparkSession
    vectors = contexts(docs.select(F.col(text).cast("string").alias("text")))
    shared = spark.sparkContext.broadcast(vectors)
    chosen = (
        labels.select(F.col(key).cast("long").alias("learn_id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .filter(~held_out("learn_id"))
        .groupBy("learn_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .filter("label = high")
        .orderBy(F.xxhash64("learn_id"), "learn_id")
        .limit(sample)
    )
    rows = docs.select(F.col(key).cast("long").alias("learn_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values in slices(batch.column(2), PART):
                part = batch.slice(done, len(values))
                done += len(values)
                x = pa.array(list(pooled(values, shared.value)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), x], ["learn_id", "label", "x"])

    # at most ``sample`` ids
    found = rows.join(F.broadcast(chosen.select("learn_id", "label")), "learn_id").select("learn_id", "label", "text")
    table = found.mapInArrow(lean(run), "learn_id long, label int, x array<double>").orderBy("learn_id").limit(sample).toArrow()
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, 2 * DIMS)
    y = np.array(table.column("label").to_pylist(), dtype=float)
    return fit(x, y), vectors


def scores(values: pa.Array, net: Network, vectors: np.ndarray) -> np.ndarray:
    return net.score(pooled(values, vectors))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Only the text counts. Null and empty texts and those without words get the score of the zero
    vector; null ids stay null and are not held out; repeated rows get equal scores. Without
    labelled rows every score is 0.5. Empty tables give no rows.
    """
    net, vectors = learn(docs, labels, key, text, label)
    model = docs.sparkSession.sparkContext.broadcast((net, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values in slices(batch.column(2), PART):
                part = batch.slice(done, len(values))
                done += len(values)
                score = scores(values, *model.value)
                columns = [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col(key).cast("long").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with their columns."""
    net, vectors = learn(docs, labels, key, text, label)
    model = docs.sparkSession.sparkContext.broadcast((net, vectors))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values in slices(batch.column(place), PART):
                part = batch.slice(done, len(values))
                done += len(values)
                yield part.filter(pa.array(scores(values, *model.value) >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
