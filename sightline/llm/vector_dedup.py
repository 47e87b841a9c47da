"""Near-duplicate vectors by an inverted multi-index.

The halves of the vectors have codebooks of their own, fitted on a bounded sample; a pair of codes names a cell of the
product grid, in which every vector is listed. A vector visits the cells nearest to it, by the multi-sequence algorithm:
both halves' codes are sorted by their distance, and pairs are taken in rising order of the sum. The distance is that to
the half space behind which the cell lies, so it is never more than the distance to a vector of the cell. Visits end at
a radius at which the target recall is met, for neighbours at the threshold drawn at random and for those that a query
set has in all rows. Vectors that meet are verified by their cosine.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, join_counted, map_columns, small_batches, write_table

#: Different vectors on which the codebooks are fitted at most, those with the least hashes; rounds of the fit.
SAMPLE, ROUNDS = 4_096, 12
#: Vectors of a label and cell that the grid aims at, and codes of a codebook at most.
CELL, CODES = 128, 256
#: Query vectors whose neighbours are sought among all rows, and drawn neighbours of each vector of the sample.
QUERIES, DRAWN = 512, 2
#: Vectors of a cell, or visitors of it, that meet in a task at once.
CHUNK = 1_000
#: Steps in which distances of neighbours' cells are counted.
STEPS = 512


def normal(vector: list | None) -> np.ndarray | None:
    """The unit vector, or None for a vector that is null, empty, zero or holds null or non-finite components."""
    if not vector or None in vector:
        return None
    v = np.array(vector, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v /= most
    return v / math.sqrt(float(v @ v))


def _unpacked(blobs: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors, with zeros after the components of shorter ones: cosines within one length stay."""
    out = np.zeros((len(blobs), dims))
    for i, blob in enumerate(blobs):
        out[i, : len(blob) // 8] = np.frombuffer(blob, np.float64)
    return out


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, key (a digest of label and unit vector; null if it can link with nothing), label and vec (the unit vector)."""

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            out: dict[str, list] = {"vec_id": batch["vec_id"], "key": [], "label": batch["label"], "vec": []}
            for vector, label in zip(batch["embedding"], batch["label"], strict=True):
                unit = None if label is None else normal(vector)
                blob = None if unit is None else unit.tobytes()
                out["vec"].append(blob)
                out["key"].append(None if blob is None else hashlib.blake2b(f"{label}:".encode() + blob, digest_size=16).digest())
            return out

        return work

    columns = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    return map_columns(columns, make, "vec_id long, key binary, label string, vec binary")


def _fit(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Codes of points by rounds of means, from points drawn at random."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(codes, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(0)
    return np.unique(centres, axis=0)


class Grid:
    """Both codebooks, and the radius of visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.half, self.dims = first.shape[1], first.shape[1] + second.shape[1]
        self.radius = 0.0
        self.apart = []
        for book in self.books:
            gap = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-30))
            self.apart.append(gap)

    def codes(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the own code of each vector, and its distances to the half spaces of all codes."""
        own, away = [], []
        for part, book, gap in zip((vectors[:, : self.half], vectors[:, self.half :]), self.books, self.apart, strict=True):
            square = (book**2).sum(1) - 2 * part @ book.T
            nearest = square.argmin(1)
            own.append(nearest)
            away.append((square - square[np.arange(len(part)), nearest][:, None]) / (2 * gap[nearest]))
        return own, away

    def cell(self, own: list[np.ndarray]) -> np.ndarray:
        return own[0] * len(self.books[1]) + own[1]

    def nearest_cells(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """(squared distance, cell) in rising order, by the multi-sequence algorithm: a pair of ranks is reached once the
        pairs before it in both sequences have been taken."""
        a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
        taken = np.zeros(len(a) + 1, np.int64)  # of each rank of the first half, ranks of the second
        reached = [(float(first[a[0]] ** 2 + second[b[0]] ** 2), 0, 0)]
        while reached:
            square, i, j = heapq.heappop(reached)
            yield square, int(a[i]) * len(second) + int(b[j])
            taken[i] = j + 1
            for x, y in ((i + 1, j), (i, j + 1)):
                before = (x == 0 or taken[x - 1] > y) and taken[x] == y
                if x < len(a) and y < len(b) and before:
                    heapq.heappush(reached, (float(first[a[x]] ** 2 + second[b[y]] ** 2), x, y))

    def visits(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        for square, cell in self.nearest_cells(first, second):
            if square > self.radius**2:
                return
            yield cell


def searches(own: np.ndarray | int, other: np.ndarray | int) -> np.ndarray | bool:
    """Whether vectors of the cell own look for those of the cell other: of two cells one does."""
    return (own < other) == ((own + other) % 2 == 0)


def _distances(grid: Grid, vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of pairs of vectors (row by row) the distance at which the visit of the cell of one of them finds the other."""
    (own_a, away_a), (own_b, away_b) = grid.codes(vectors), grid.codes(others)
    row = np.arange(len(vectors))
    from_a = np.hypot(away_a[0][row, own_b[0]], away_a[1][row, own_b[1]])
    from_b = np.hypot(away_b[0][row, own_a[0]], away_b[1][row, own_a[1]])
    a, b = grid.cell(own_a), grid.cell(own_b)
    return np.where(a == b, 0.0, np.where(searches(a, b), from_a, from_b))


def fit(firsts: DataFrame, threshold: float, recall: float) -> tuple[Grid, dict]:
    """The grid of different vectors (label, vec), and what was measured of it.

    Codebooks come from SAMPLE vectors. Each half has as many codes as let a cell of a label hold CELL vectors on average,
    CODES at most; larger cells are compared in chunks.
    """
    labels, count, widest = firsts.agg(F.count_distinct("label"), F.count(F.lit(1)), F.max(F.length("vec"))).first()
    dims = max(2, (widest or 16) // 8)
    drawn = firsts.select("label", "vec", F.xxhash64("vec").alias("h")).orderBy("h", "label").limit(SAMPLE).collect()
    vectors = _unpacked([r["vec"] for r in drawn], dims) if drawn else np.eye(dims)[:1]
    codes = int(min(CODES, max(2, math.ceil(math.sqrt(count / max(labels, 1) / CELL)))))
    half = dims // 2
    grid = Grid(_fit(vectors[:, :half], codes, 1), _fit(vectors[:, half:], codes, 2))

    # Neighbours at the threshold in random directions: all nearer ones lie at smaller distances on average.
    draw = np.random.default_rng(3)
    base = np.repeat(vectors, DRAWN, axis=0)
    aside = draw.standard_normal(base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.maximum(np.sqrt((aside**2).sum(1)), 1e-30)[:, None]
    grid.radius = float(np.quantile(_distances(grid, base, threshold * base + math.sqrt(1 - threshold**2) * aside), recall))

    queries = [(r["label"], r["vec"]) for r in drawn[:QUERIES]]
    seen = _neighbour_distances(firsts, grid, queries, threshold)
    if seen:
        grid.radius = max(grid.radius, _radius_for(seen, recall))
    found = [sum(n for step, n in steps.items() if step <= grid.radius * STEPS) / sum(steps.values()) for steps in seen.values()]
    return grid, {"codes": codes, "radius": grid.radius, "queries": len(queries), "with_neighbours": len(found), "recall": sum(found) / len(found) if found else None}


def _radius_for(seen: dict[int, dict[int, int]], recall: float) -> float:
    """The least radius at which the mean recall of the queries is met; each query counts alike, however many it finds."""
    steps = sorted({s for counts in seen.values() for s in counts})
    for step in steps:
        if sum(sum(n for s, n in c.items() if s <= step) / sum(c.values()) for c in seen.values()) >= recall * len(seen) - 1e-9:
            return step / STEPS
    return steps[-1] / STEPS


def _neighbour_distances(firsts: DataFrame, grid: Grid, queries: list[tuple[str, bytes]], threshold: float) -> dict[int, dict[int, int]]:
    """Of a stated query set against all rows, in blocks: how many neighbours each query has at which distance of visits,
    in steps of 1 / STEPS, rounded up. Counts, QUERIES times the steps up to the farthest at most, come to the driver."""
    by_label: dict[str, list[int]] = {}
    for i, (label, _) in enumerate(queries):
        by_label.setdefault(label, []).append(i)
    units = _unpacked([v for _, v in queries], grid.dims) if queries else np.zeros((0, grid.dims))
    length = np.array([len(v) for _, v in queries])

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            found: dict[tuple[int, int], int] = {}
            vectors, lengths, labels = _unpacked(batch["vec"], grid.dims), np.array([len(v) for v in batch["vec"]]), np.array(batch["label"], object)
            for label in set(batch["label"]):
                q, here = by_label.get(label, []), np.flatnonzero(labels == label)
                hit = np.argwhere((units[q] @ vectors[here].T >= threshold) & (length[q][:, None] == lengths[here])) if q else []
                if len(hit):
                    a, b = np.array(q)[hit[:, 0]], here[hit[:, 1]]
                    step = np.ceil(_distances(grid, units[a], vectors[b]) * STEPS - 1e-9).astype(int)
                    for key in zip(a.tolist(), step.tolist(), strict=True):
                        found[key] = found.get(key, 0) + 1
            return {"query": [k[0] for k in found], "step": [k[1] for k in found], "n": list(found.values())}

        return work

    if not queries:
        return {}
    counted = map_columns(firsts.select("label", "vec"), make, "query int, step int, n long", rows=1_024)
    out: dict[int, dict[int, int]] = {}
    for r in counted.groupBy("query", "step").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["query"], {})[r["step"]] = r["n"]
    # A query finds itself; it is no neighbour.
    for steps in out.values():
        steps[0] = steps.get(0, 1) - 1
    return {q: s for q, s in out.items() if sum(s.values())}


def _entries(firsts: DataFrame, grid: Grid) -> DataFrame:
    """cell (of label, length and codes), listed (in its own cell) or visiting, first, n, vec."""

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            out: dict[str, list] = {"cell": [], "listed": [], "first": [], "n": [], "vec": []}
            own, away = grid.codes(_unpacked(batch["vec"], grid.dims))
            for i, cell in enumerate(grid.cell(own).tolist()):
                for other in (cell, *(c for c in grid.visits(away[0][i], away[1][i]) if c != cell and searches(cell, c))):
                    name = hashlib.blake2b(f"{other}:{len(batch['vec'][i])}:{batch['label'][i]}".encode(), digest_size=8).digest()
                    out["cell"].append(int.from_bytes(name, "little", signed=True))
                    out["listed"].append(other == cell)
                    for c in ("first", "n", "vec"):
                        out[c].append(batch[c][i])
            return out

        return work

    return map_columns(firsts, make, "cell long, listed boolean, first long, n long, vec binary")


def _in_chunks(entries: DataFrame) -> DataFrame:
    """Entries with grp, a number of rows that meet in a task, and role: 0 for a row of the cell's list, 1 and 2 for what
    it meets (of the list, visitors). Each row of a list meets each other and each visitor of its cell in one group."""
    counts = entries.groupBy("cell").agg(F.count_if("listed").alias("n_listed"), F.count(F.lit(1)).alias("n_all"))
    counts = write_table(counts.where("n_listed > 0 and n_all > 1"), "cell-sizes")
    dealt = join_counted(entries, counts, ["cell"], n="n_all")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("int")
    dealt = dealt.withColumn("down", chunks("n_listed")).withColumn("across", F.greatest(chunks("n_listed"), F.ceil((F.col("n_all") - F.col("n_listed")) / CHUNK).cast("int")))
    chunk = lambda of: F.pmod(F.xxhash64("first", "cell"), F.col(of)).cast("int")
    dealt = dealt.withColumn("chunk", F.when(F.col("listed"), chunk("down")).otherwise(chunk("across")))
    block = lambda row, column, role: F.struct(row.cast("int").alias("down_at"), column.cast("int").alias("across_at"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<down_at:int,across_at:int,role:int>>")
    as_rows = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: block(F.col("chunk"), j, 0))
    # Chunks of the list meet once: as columns of the chunks before them.
    as_columns = F.when(F.col("chunk") > 0, F.transform(F.sequence(F.lit(0), F.col("chunk") - 1), lambda i: block(i, F.col("chunk"), 1))).otherwise(none)
    visiting = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: block(i, F.col("chunk"), 2))
    blocks = F.when(F.col("listed"), F.concat(as_rows, as_columns)).otherwise(visiting)
    placed = dealt.select("cell", "first", "n", "vec", F.explode(blocks).alias("b"))
    own = (F.col("b.role") == 0) & (F.col("b.down_at") == F.col("b.across_at"))  # this group compares the chunk with itself
    return placed.select(F.xxhash64("cell", "b.down_at", "b.across_at").alias("grp"), "b.role", own.alias("own"), "first", "n", "vec")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of the rows of each group, of batches sorted by their first column."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        edges = [i for i in range(1, batch.num_rows) if columns[0][i] != columns[0][i - 1]]
        for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if begin == end:
                continue
            part = [c[begin:end] for c in columns]
            if held and held[0][0] == part[0][0]:
                held = [a + b for a, b in zip(held, part, strict=True)]
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def _tied(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the smallest one that links (rows, columns) connect it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[rows], label[columns])
        new = label.copy()
        np.minimum.at(new, rows, least)
        np.minimum.at(new, columns, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(chunks: DataFrame, threshold: float) -> DataFrame:
    """a, n_links: how many vectors a links with in a group; and b, a member that a is connected with in it."""
    fields = "a long, n_links long, b long"
    small_batches(chunks.sparkSession)

    def work(group: list[list]) -> tuple[list, list, list] | None:
        _, role, own, first, n, blobs = group
        role = np.array(role)
        order = np.argsort(role, kind="stable")
        role, first, n = role[order], np.array(first)[order], np.array(n)[order]
        rows = int((role == 0).sum())
        if not rows or len(role) < 2:
            return None
        vectors = np.stack([np.frombuffer(blobs[i], np.float64) for i in order])
        near = vectors[:rows] @ vectors.T >= threshold
        near[:, :rows] &= np.triu(np.ones((rows, rows), bool), 1) if own[int(order[0])] else False
        if not near.any():
            return None
        links = near @ n
        total = np.concatenate((links, np.zeros(len(role) - rows, np.int64))) + n[:rows] @ near
        a, b = np.nonzero(near)
        root = _tied(a, b, len(role))
        hit = np.flatnonzero(total)
        return first[hit].tolist(), total[hit].tolist(), first[root[hit]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for group in _groups(batches):
            for column, values in zip(held, work(group) or ([], [], []), strict=True):
                column += values
            if len(held[0]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], ["a", "n_links", "b"])
                held = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], ["a", "n_links", "b"])

    return chunks.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, fields)


def near_vectors(rows: DataFrame, threshold: float = 0.93, recall: float = 0.9995) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and one length are linked if their cosine, in double precision, is threshold or more. n_links
    counts the other rows linked directly, component_id is the smallest vec_id that links reach, and kept tells whether
    it is the row's own. A null label, or a vector that is null, empty, zero or has null or non-finite components, links
    with nothing. Rows with equal unit vectors and labels are one class and are compared once. A null vec_id takes part
    only through the class of its vector (alone, it has no links and a null component, and is kept); different vectors
    under one vec_id count as one vector whose links are added up. An empty table gives no rows. Other columns are not
    read.
    """
    every = write_table(prepared(rows), "vectors")
    classes = every.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = write_table(classes, "vector-classes")
    firsts = join_counted(every, classes, ["key"]).where("vec_id = first").dropDuplicates(["key"]).select("first", "n", "label", "vec")
    firsts = write_table(firsts, "different-vectors")
    grid, _ = fit(firsts, threshold, recall)
    entries = write_table(_entries(firsts, grid), "cells")
    found = write_table(_compared(_in_chunks(entries), threshold), "vector-links")
    linked = found.groupBy("a").agg(F.sum("n_links").alias("links"))
    tied = components(found.select("a", "b"))
    named = classes.join(linked, classes["first"] == linked["a"], "left").join(tied.select(F.col("vertex"), F.col("component")), F.col("first") == F.col("vertex"), "left")
    named = named.select("key", "first", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    for table in (firsts, entries):
        drop_table(table)
    out = join_counted(every.select("vec_id", "key"), named, ["key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
