import collections
import math

import duckdb
import numpy as np
import pytest

from sightline.llm import queries, vector_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, key int, first string, `n` int"


def brute(rows, threshold=0.93):
    """(n_links, component) of each row's number; rows are (vec_id, embedding, label)."""
    unit = []
    for _, vector, label in rows:
        usable = label is not None and vector and None not in vector and all(map(math.isfinite, vector)) and any(vector)
        v = np.array(vector, float) / max(map(abs, vector)) if usable else None
        unit.append(None if v is None else v / np.sqrt(v @ v))
    near = collections.defaultdict(list)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                near[i].append(j)
                near[j].append(i)
    least = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        stack = [i] if i not in least else []
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = rows[i][0]
                stack += near[x]
    return {rows[i][0]: (len(near[i]), least[i]) for i in range(len(rows))}


def result(frame):
    out = {}
    for r in frame.collect():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        out[r["vec_id"]] = (r["n_links"], r["component_id"])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def spread(n, dims, seed, groups=(), labels=3):
    """Vectors in all directions, and groups (size, noise) of near copies about one vector each."""
    draw, rows = np.random.default_rng(seed), []
    for v in draw.standard_normal((n, dims)):
        rows.append((len(rows), v.tolist(), len(rows) % labels))
    for size, noise in groups:
        centre = draw.standard_normal(dims)
        for _ in range(size):
            rows.append((len(rows), (centre + noise * draw.standard_normal(dims)).tolist(), 0))
    return rows


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.execute(f"SELECT vec_id, n_links, component_id FROM ({queries.ORACLE_SQL['op13_vector_dedup']})").fetchall()
    assert result(queries.op13_vector_dedup(spark, sf)) == {r[0]: r[1:] for r in want}


def test_groups_are_found_whole_in_small_cells_and_chunks(spark, monkeypatch):
    """Groups at the threshold and far above it, a third of all rows in one of them; chunks of few rows."""
    monkeypatch.setattr(vector_dedup, "CELL", 8)
    monkeypatch.setattr(vector_dedup, "CHUNK", 20)
    rows = spread(300, 16, 1, groups=((200, 0.02), (60, 0.25), (40, 0.3)))
    got, want = result(vector_dedup.near_vectors(frame(spark, rows))), brute(rows)
    links = sum(n for n, _ in want.values())
    assert sum(abs(got[i][0] - want[i][0]) for i in want) <= 0.005 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] != want[i][1] for i in want) <= 1
    assert all(got[i] == want[i] for i in range(300, 500) if want[i][0] == 199)


def test_measured_recall(spark):
    """Against brute force, of pairs in different cells alone, for neighbours near the threshold."""
    draw = np.random.default_rng(5)
    base = draw.standard_normal((1_500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = draw.standard_normal(base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    other = 0.935 * base + math.sqrt(1 - 0.935**2) * aside
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*base, *other])]
    got = result(vector_dedup.near_vectors(frame(spark, rows)))
    assert sum(got[i][0] >= 1 and got[i][1] <= i for i in range(1_500)) >= 0.99 * 1_500


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_short_vectors(spark, dims):
    rows = spread(60, dims, 2, labels=2)
    got, want = result(vector_dedup.near_vectors(frame(spark, rows))), brute(rows)
    assert sum(got[i] == want[i] for i in want) >= 58


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None),
        (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [nan, 1.0, 0.0], 1), (11, [inf, 1.0, 0.0], 1),
        (12, [1.0, 0.0], 1), (13, [1e300, 0.0, 0.0], 1), (14, [1e-300, 0.0, 0.0], 1), (15, [1.0, 0.0, 0.0], 1), (16, [-1.0, 0.0, 0.0], 1),
    ]
    got = result(vector_dedup.near_vectors(frame(spark, rows)))
    assert got == {**{i: (0, i) for i in range(1, 17)}, **{i: (5, 1) for i in (1, 2, 3, 13, 14, 15)}}
    more = vector_dedup.near_vectors(frame(spark, [*rows, (1, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in more)[:4] == [(0, 0, None), (0, 7, 1), (1, 7, 1), (1, 7, 1)]
    assert vector_dedup.near_vectors(frame(spark, rows).limit(0)).count() == 0
    assert result(vector_dedup.near_vectors(frame(spark, [(1, None, 1), (2, [0.0], 1)]))) == {1: (0, 1), 2: (0, 2)}


def test_cells_come_in_rising_order_and_all_of_them():
    draw = np.random.default_rng(1)
    grid = vector_dedup.Grid(draw.standard_normal((6, 4)), draw.standard_normal((5, 4)))
    _, away = grid.codes(draw.standard_normal((3, 8)))
    for i in range(3):
        taken = list(grid.nearest_cells(away[0][i], away[1][i]))
        assert len({c for _, c in taken}) == 30 and [d for d, _ in taken] == sorted(d for d, _ in taken)
        assert taken == sorted(taken, key=lambda t: t[0])


def test_no_vector_of_a_cell_is_nearer_than_the_cell():
    """The radius of the threshold itself loses nothing: distances to cells are lower bounds."""
    draw = np.random.default_rng(2)
    points = draw.standard_normal((400, 8))
    grid = vector_dedup.Grid(vector_dedup._fit(points[:, :4], 8, 1), vector_dedup._fit(points[:, 4:], 8, 2))
    a, b = points[:200], points[200:]
    assert (vector_dedup._distances(grid, a, b) <= np.linalg.norm(a - b, axis=1) + 1e-9).all()
