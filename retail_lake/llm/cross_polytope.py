"""Near-duplicate vectors by cross-polytope hashing with several probes and verified candidates.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the
axis (with sign) nearest to it. A bucket of a table joins HASHES such values. Every vector is a
member of one bucket per table and asks PROBES buckets: its own and those reached by the next best
axes. Members and askers of a bucket are both cut into tiles; every tile of members meets every
tile of askers, in double precision, and no pair is kept beyond its block of 512 askers. A pair that meets several times is counted at its first meeting only, which both
vectors' bucket numbers tell. Equal vectors of one label are compared as one, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.components import components
from retail_lake.session import freeze

TABLES, HASHES, PROBES = 6, 2, 8
#: Members of a bucket, and askers, that one task compares at a time.
TILE, ASKERS = 1_024, 4_096
_NEXT_BEST = 4


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, in place; widths are powers of two."""
    n, width = x.shape
    step = 1
    while step < width:
        view = x.reshape(n, width // (2 * step), 2, step)
        a, b = view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]
        view[:, :, 0], view[:, :, 1] = a, b
        step *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(vector, table, probe) bucket numbers; probe 0 is the vector's own bucket."""
    n, dims = vectors.shape
    width = 1 << max(1, (dims - 1).bit_length())
    base = np.zeros((n, width))
    base[:, :dims] = vectors
    out = np.empty((n, tables, probes), dtype=np.int64)
    keep = min(_NEXT_BEST, width)
    for table in range(tables):
        codes, losses = [], []
        for j in range(hashes):
            random = np.random.default_rng([table, j, width])
            y = base
            for _ in range(3):
                y = _hadamard(y * random.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = np.argpartition(-size, keep - 1, axis=1)[:, :keep]
            value = np.take_along_axis(size, best, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
            codes.append(2 * best + (np.take_along_axis(y, best, axis=1) < 0))
            losses.append((value[:, :1] - value) ** 2)
        code, loss = codes[0].astype(np.int64), losses[0]
        for j in range(1, hashes):
            code = (code[:, :, None] * (2 * width) + codes[j][:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + losses[j][:, None, :]).reshape(n, -1)
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(code, chosen, axis=1)
        out[:, table, : found.shape[1]] = found
        out[:, table, found.shape[1] :] = found[:, :1]
    return out


def _hashed(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """Unit vectors as bytes, with their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                dims = part.column(2).to_numpy(zero_copy_only=False)
                flat = part.column(1).to_pylist()
                units: list = [None] * len(flat)
                codes: list = [None] * len(flat)
                for width in np.unique(dims):
                    rows = np.flatnonzero(dims == width)
                    x = np.array([flat[i] for i in rows], dtype=float)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    code = buckets(x, tables, hashes, probes)
                    for i, u, c in zip(rows.tolist(), x, code, strict=True):
                        units[i], codes[i] = u.tobytes(), c.ravel().tolist()
                columns = [part.column(0), pa.array(units, pa.binary()), pa.array(codes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "unit", "codes"])

    return classes.select("cls", "vector", "dims").mapInArrow(run, "cls long, unit binary, codes array<long>")


def _first_meetings(a: np.ndarray, b: np.ndarray, id_a: np.ndarray, id_b: np.ndarray, table: int) -> np.ndarray:
    """Whether askers a and members b (codes: pair, table, probe) meet here for the first time."""
    ask = (a == b[:, :, :1]).any(axis=2)  # per table: b is a member where a asks
    back = (b == a[:, :, :1]).any(axis=2)
    earlier = (ask | back)[:, :table].any(axis=1)
    return ~earlier & ask[:, table] & (~back[:, table] | (id_a < id_b))


def _fold(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least name of each set) with the sets of every pair (a, b) made one."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a name is its own root here
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _tiles(met: DataFrame, least: float, tables: int, probes: int) -> DataFrame:
    """(cls, links, root) for the vectors of every tile."""

    def run(table: pa.Table) -> pa.Table:
        which = table.column("table")[0].as_py()
        cls = table.column("cls").to_numpy()
        weight = table.column("weight").to_numpy()
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=float).reshape(len(cls), -1)
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cls), tables, probes)
        members, askers = np.flatnonzero(member), np.flatnonzero(~member)
        names, spot = np.unique(cls, return_inverse=True)
        links, root = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
        for at in range(0, len(askers), 512):
            rows = askers[at : at + 512]
            i, j = np.nonzero(x[rows] @ x[members].T >= least)
            i, j = rows[i], members[j]
            other = cls[i] != cls[j]
            i, j = i[other], j[other]
            root = _fold(root, spot[i], spot[j])
            for cut in range(0, len(i), 20_000):
                a, b = i[cut : cut + 20_000], j[cut : cut + 20_000]
                first = _first_meetings(codes[a], codes[b], cls[a], cls[b], which)
                np.add.at(links, spot[a[first]], weight[b[first]])
                np.add.at(links, spot[b[first]], weight[a[first]])
        keep = (links > 0) | (root != np.arange(len(root)))
        return pa.table({"cls": names[keep], "links": links[keep], "root": names[root[keep]]})

    return met.groupBy("table", "cell", "tile", "ask_tile").applyInArrow(run, "cls long, links long, root long")


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and length are compared. Null, empty and zero vectors, those with a
    null or non-finite component and those with a null label link with nothing. Repeated rows link
    with each other; ids that are null stay null and name a component only if it has no other.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        for batch in batches:
            ids = pa.array(np.arange(serial, serial + batch.num_rows))
            serial += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, *batch.columns], ["row", "vec_id", "vector", "label"])

    chosen = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label")
    )
    known = freeze(chosen.mapInArrow(number, "row long, vec_id long, vector array<double>, label string"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = known.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda v: v != 0))
    # -0.0 and 0.0 are one value
    usable = usable.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0))).withColumn(
        "same", F.md5(F.concat_ws(",", F.transform("vector", lambda v: v.cast("string"))))
    )
    named = freeze(usable.groupBy("label", "same").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("weight")))
    classes = (
        usable.join(named.select(F.col("cls").alias("row"), "weight"), "row")
        .select(F.col("row").alias("cls"), "label", "vector", F.size("vector").alias("dims"), "weight")
    )
    classes = freeze(classes)
    hashed = freeze(_hashed(classes, tables, hashes, probes).join(classes.select("cls", "label", "dims", "weight"), "cls"))

    place = F.posexplode("codes").alias("at", "code")
    asks = hashed.select("cls", "label", "dims", place).select(
        "cls",
        F.floor(F.col("at") / probes).cast("int").alias("table"),
        F.xxhash64("label", "dims", "code").alias("cell"),
        (F.col("at") % probes == 0).alias("own"),
    ).groupBy("cls", "table", "cell").agg(F.bool_or("own").alias("own"))  # short vectors repeat buckets
    # buckets in which someone meets someone else
    cells = (
        asks.groupBy("table", "cell")
        .agg(F.count_if("own").alias("members"), F.count(F.lit(1)).alias("askers"))
        .filter("members > 0 and askers > 1")
        .select(
            "table",
            "cell",
            F.ceil(F.col("members") / TILE).cast("int").alias("tiles"),
            F.ceil(F.col("askers") / ASKERS).cast("int").alias("ask_tiles"),
        )
    )
    met = asks.join(cells, ["table", "cell"])

    def part(tiles: str) -> F.Column:
        return F.pmod(F.xxhash64("cls"), F.col(tiles)).cast("int")

    def each(tiles: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))

    as_member = met.filter("own").select(
        "table", "cell", part("tiles").alias("tile"), each("ask_tiles").alias("ask_tile"), "cls", F.lit(True).alias("member")
    )
    as_asker = met.select(
        "table", "cell", each("tiles").alias("tile"), part("ask_tiles").alias("ask_tile"), "cls", F.lit(False).alias("member")
    )
    full = as_member.unionByName(as_asker).join(hashed.select("cls", "unit", "codes", "weight"), "cls")
    found = freeze(_tiles(full, least, tables, probes))

    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    member = usable.select("row", "label", "same").join(named, ["label", "same"]).select("row", "cls", "weight")
    joined = (
        known.select("row", "vec_id")
        .join(member, "row", "left")
        .join(linked, "cls", "left")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "vec_id",
            (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "cls", "row").alias("root"),
        )
    )
    least_id = joined.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return joined.join(least_id, "root").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
