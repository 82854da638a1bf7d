import numpy as np

from retail_lake.llm import cross_polytope
from retail_lake.llm.cross_polytope import _hadamard, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cls string"


def brute(rows):
    ok = lambda v, l: l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v, l) else None for _, v, l, _ in rows]
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
        for i in range(n)
    ]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def test_against_all_pairs(spark):
    random = np.random.default_rng(5)
    rows = []
    for group in range(12):
        base = random.normal(size=20)
        for k in range(10):
            v = base + random.normal(size=20) * random.choice([0.02, 0.1, 0.3])
            rows.append((len(rows), v.tolist(), group % 2, "x"))
    rows += [(900, rows[0][1], 0, "x"), (901, rows[0][1], 0, None), (901, rows[0][1], 0, "x"), (902, rows[0][1], 1, "x")]
    rows += [(910, None, 0, "x"), (911, [0.0] * 20, 0, "x"), (912, [None] * 20, 0, "x"), (913, [float("nan")] * 20, 0, "x"), (914, [float("inf")] + [1.0] * 19, 0, "x")]
    rows += [(915, rows[0][1], None, "x"), (None, rows[0][1], 0, "x"), (916, rows[0][1][:16], 0, "x"), (917, [], 0, "x"), (918, [3.0], 0, "x"), (919, [2.0], 0, "x")]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_recall_of_close_pairs(spark):
    random = np.random.default_rng(6)
    rows = []
    for i in range(300):
        base = random.normal(size=64)
        rows += [(2 * i, base.tolist(), 1, "x"), (2 * i + 1, (base + random.normal(size=64) * 0.19).tolist(), 1, "x")]
    want = sum(n for _, n, _, _ in brute(rows))
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).agg({"n_links": "sum"}).first()[0]
    assert want > 200 and 0.9 * want <= got <= want


def test_one_large_group_stays_in_bounded_tiles(spark, monkeypatch):
    """Both sides of a bucket are cut, so no task holds all askers; links and components stay exact."""
    monkeypatch.setattr(cross_polytope, "TILE", 16)
    monkeypatch.setattr(cross_polytope, "ASKERS", 32, raising=False)
    largest, tiles = [], cross_polytope._tiles

    def watched(met, *more):
        keys = [c for c in met.columns if c not in ("cls", "member", "unit", "codes", "weight")]
        largest.append(met.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return tiles(met, *more)

    monkeypatch.setattr(cross_polytope, "_tiles", watched)
    random = np.random.default_rng(7)
    base = random.normal(size=20)
    rows = [(i, (base + random.normal(size=20) * 0.02).tolist(), 0, "x") for i in range(250)]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert largest[0] <= 2 * (16 + 32)


def test_empty_table_and_transform(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    x = np.eye(8)
    assert np.allclose(_hadamard(_hadamard(x.copy()).copy()), x)
