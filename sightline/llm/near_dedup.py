"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its word shingles. Some independent trees are grown over all documents: at each node a few
minwise functions are chosen, and each document goes to one child for each of them, named by its minwise token. Nodes
of up to NODE_LIMIT documents are compared exhaustively; larger ones branch on, unless their documents are so alike
that branching cannot part them, in which case they are compared in blocks. Sketches pick the documents of a node that
may have a partner there; only these bring their whole texts, and links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, in_blocks, join_counted, map_columns, text_of, unused, write_table

#: Minwise functions, all of which make the sketch (a byte each). Each tree chooses its paths by COORDINATES of its own.
FUNCTIONS, COORDINATES = 256, 32
BRANCHES = 3
NODE_LIMIT = 2_000
#: A node whose documents match its first document by this much on average is compared, not branched.
DENSE = 0.5
MAX_DEPTH = 6
#: Standard errors by which a sketch may fall short of the threshold before a pair is ruled out.
SLACK = 4.8
#: Ids up to this number (8 MB) are broadcast to select texts; more are joined by shuffle.
BROADCAST_IDS = 500_000

_u = np.uint64
_LOWER = np.arange(256, dtype=_u)
_LOWER[65:91] += _u(32)
_LOWER += _u(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
    return x ^ (x >> _u(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.ones(n, _u)
        done = 1
        while done < n:
            more = min(done, n - done)
            table[done : done + more] = table[:more] * _u(int(table[done - 1]) * base % (1 << 64))
            done += more
        out.append(table)
    return out[0], out[1]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of UTF-8 bytes (A-Z as a-z), by differences of power sums."""
    edge = np.diff(np.concatenate(([1], _BLANK[raw].view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(1 << max(16, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, _u)
    np.cumsum(_LOWER[raw] * power[: len(raw)], out=sums[1:])
    return start, end, _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_u))


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: A-Z lower-cased, words parted by blanks and tabs
    to carriage returns; with fewer words than a shingle the whole sequence is one, and without words there is none."""
    _, _, word = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(word):
        return np.zeros(0, _u)
    size = min(words, len(word))
    out = np.full(len(word) - size + 1, size, _u)
    for j in range(size):
        out = out * _u(0xC2B2AE3D27D4EB4F) + word[j : j + len(out)]
        out ^= out >> _u(29)
    return np.unique(_mix(out))


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The minimal value of each function over a set of shingles."""
    folded = (tokens ^ (tokens >> _u(32))).astype(np.uint32)
    best = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        x = folded[None, at : at + 1024] * _factors()
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        np.minimum(best, x.min(1), out=best)
    return best


def sketches(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a digest of the whole set), coords (path tokens) and sketch of every document."""

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_shingles": [], "h1": [], "h2": [], "coords": [], "sketch": []}
            for text in batch["text"]:
                found = shingles(text, words)
                best = minwise(found)
                out["n_shingles"].append(len(found))
                digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                out["h1"].append(int(digest[0]))
                out["h2"].append(int(digest[1]))
                out["coords"].append(best[: trees * COORDINATES].astype(np.int32))
                out["sketch"].append((best >> np.uint32(7)).astype(np.uint8).tobytes())
            return out

        return work

    return map_columns(docs, make, "doc_id long, n_shingles long, h1 long, h2 long, coords array<int>, sketch binary")


def _child(node: Column, k: Column) -> Column:
    return F.xxhash64(node, k, F.element_at("coords", k + 1))


def _roots(trees: int) -> Column:
    """The nodes of the first level as (tree, node)."""
    return F.inline(F.array(*[F.struct(F.lit(tree).alias("tree"), _child(F.lit(-1 - tree), F.lit(tree * COORDINATES + i)).alias("node")) for tree in range(trees) for i in range(BRANCHES)]))


def _children() -> Column:
    """The nodes below a node, by functions of its tree drawn from its name."""
    drawn = lambda i: F.col("tree") * COORDINATES + F.pmod(F.xxhash64("node", F.lit(i)), F.lit(COORDINATES)).cast("int")
    return F.explode(F.array(*[_child(F.col("node"), drawn(i)) for i in range(BRANCHES)]))


def trees_for(recall: float, threshold: float) -> int:
    """Trees needed to bring together a pair at the threshold with this chance, however deep its path. They share no
    functions, so they miss a pair independently."""
    reached = 1.0
    for _ in range(MAX_DEPTH):
        reached = 1 - (1 - threshold * reached) ** BRANCHES
    return min(FUNCTIONS // COORDINATES, max(1, math.ceil(math.log(1 - recall) / math.log(1 - reached))))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each group, of a partition sorted by its first column."""
    held: dict[str, list] = {n: [] for n in names}
    key = names[0]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            column = {n: part.column(part.schema.get_field_index(n)).to_pylist() for n in names}
            begin = 0
            for i, group in enumerate(column[key]):
                if held[key] and group != held[key][0] if i == begin else group != column[key][begin]:
                    for n in names:
                        held[n] += column[n][begin:i]
                    yield held
                    held, begin = {n: [] for n in names}, i
            for n in names:
                held[n] += column[n][begin:]
    if held[key]:
        yield held


def _by_group(rows: DataFrame, work: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Run work on each group; groups are bounded, so a task holds one at a time."""
    names = rows.columns
    fields = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {f: [] for f in fields.names}
        for group in _runs(batches, names):
            for name, values in (work(group) or {}).items():
                held[name] += values
            if len(held[fields.names[0]]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in held.values()], list(held))
                held = {f: [] for f in fields.names}
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in held.values()], list(held))

    return rows.repartition(names[0]).sortWithinPartitions(names[0]).mapInArrow(run, fields)


def least_equal(threshold: float) -> float:
    """Equal bytes that the sketches of a pair at the threshold have, but for SLACK standard errors. Bytes agree by
    chance as well, so the share of equal ones is at least the likeness on average."""
    return FUNCTIONS * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / FUNCTIONS))


def partnered(group: dict[str, list], threshold: float) -> dict[str, list] | None:
    """The members of a group that may have partners in it, by sizes and sketches, parted into those that such partners
    connect. A part is named by a digest of its members, so that it is one wherever trees and nodes find it."""
    n = len(group["doc_id"])
    if n < 2:
        return None
    size = np.array(group["n_shingles"])
    order = np.argsort(size, kind="stable")
    size = size[order]
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(n, FUNCTIONS)[order]
    least = least_equal(threshold)
    reach = np.searchsorted(size, size / threshold + 1e-9, side="right")
    label, hit = np.arange(n), np.zeros(n, bool)
    for i in range(n - 1):
        near = np.flatnonzero((sketch[i + 1 : reach[i]] == sketch[i]).sum(1, dtype=np.int32) >= least) + i + 1
        if len(near):
            hit[i] = hit[near] = True
            joined = np.unique(np.append(label[near], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    out: dict[str, list] = {"grp": [], "doc_id": []}
    ids = np.array(group["doc_id"], np.int64)[order]
    for part in np.unique(label[hit]):
        members = np.sort(ids[label == part])
        name = int(np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), np.int64)[0])
        out["grp"] += [name] * len(members)
        out["doc_id"] += members.tolist()
    return out if out["doc_id"] else None


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs with 100 * intersection >= percent * union connect.

    Each round holds one set against all others at once. Rounds end when all sets not yet held are connected: the
    links among these add nothing.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(int(flat.max()) + 1, bool)
    label, held, out = np.arange(n), np.zeros(n, bool), []
    while True:
        labels, counts = np.unique(label[~held], return_counts=True)
        if len(labels) <= 1:
            return out
        # of the smaller components first; the first round takes the member with the largest set
        inside = ~held & (label != labels[counts.argmax()]) if held.any() else ~held
        x = int(np.flatnonzero(inside)[size[inside].argmax()])
        own = flat[begin[x] : begin[x] + size[x]]
        marked[own] = True
        both = np.add.reduceat(marked[flat], begin, dtype=np.int64)
        marked[own] = False
        held[x] = True
        hits = np.flatnonzero(100 * both >= percent * (size + size[x] - both))
        new = [int(y) for y in hits if label[y] != label[x]]
        for y in new:
            if label[y] != label[x]:
                out.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]


def near_groups(docs: DataFrame, words: int = 5, percent: int = 75, recall: float = 0.99999) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id that a document reaches, and that document is kept. Texts that are null or have no words have an
    empty set and no links. Documents with equal sets are one class and go through the trees once. A null doc_id takes
    part only through the class of its text (alone, it has a null component and is kept); rows that share a doc_id
    count as one document with several texts. An empty table gives no rows; other columns are not read.
    """
    threshold, trees = percent / 100, trees_for(recall, percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    every = write_table(sketches(texts, words, trees), "sketches")
    same = ["h1", "h2", "n_shingles"]
    classes = write_table(every.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "sets")
    firsts = join_counted(every, classes, same).where("doc_id = first").dropDuplicates(["doc_id", *same])
    firsts = write_table(firsts.select("doc_id", "n_shingles", "coords", "sketch"), "classes")

    groups, kept, deep = _leaves(firsts, trees)
    rows, pivots = _through_pivots(groups, deep, texts, words, percent)
    able = _by_group(firsts.select("doc_id", "n_shingles", "sketch").join(_few(rows), "doc_id").select("grp", "doc_id", "n_shingles", "sketch"), lambda g: partnered(g, threshold), "grp long, doc_id long")
    able = write_table(able.distinct(), "partnered")

    wanted = _few(able)  # few rows go to the texts, else only the texts that are asked for are dealt out
    sent = texts if wanted is not able else texts.join(_few(able.select("doc_id").distinct()), "doc_id", "left_semi")
    bodies = sent.join(wanted, "doc_id").select("grp", "doc_id", "text")

    def confirm(group: dict[str, list]) -> dict[str, list] | None:
        if len(group["doc_id"]) < 2:
            return None
        links = linked(group["doc_id"], [shingles(t, words) for t in group["text"]], percent)
        return {"a": [a for a, _ in links], "b": [b for _, b in links]}

    links = write_table(_by_group(bodies, confirm, "a long, b long").unionByName(pivots), "near-links")
    found = components(links)
    for table in (firsts, *kept, able, links):
        drop_table(table)
    return _results(every, classes, found, same)


def _few(ids: DataFrame) -> DataFrame:
    """The table itself, or marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _results(every: DataFrame, classes: DataFrame, found: DataFrame, same: list[str]) -> DataFrame:
    named = classes.withColumnRenamed("first", "vertex").join(found, "vertex", "left").select(*same, F.coalesce("component", "vertex").alias("component_id"), "n")
    out = join_counted(every.select("doc_id", *same), named, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _leaves(firsts: DataFrame, trees: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The nodes to compare (grp, doc_id, n, first), the tables to delete in the end, and the rows of firsts that are in
    large nodes of the first level: nodes of up to NODE_LIMIT documents, and larger ones that are dense or as deep as can
    be. Levels below read these rows alone."""
    deep = firsts
    entries = firsts.select("doc_id", _roots(trees))
    leaves, tables = [], []
    for depth in range(1, MAX_DEPTH + 1):
        sizes = write_table(entries.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "node-sizes")
        entries = write_table(join_counted(entries, sizes, ["node"]), "nodes")
        tables += [sizes, entries]
        large = entries.where(F.col("n") > NODE_LIMIT)
        if depth == MAX_DEPTH or large.isEmpty():
            leaves.append(entries)
            break
        leaves.append(entries.where(F.col("n") <= NODE_LIMIT))
        if depth == 1:
            deep = write_table(firsts.join(_few(large.select("doc_id").distinct()), "doc_id", "left_semi"), "deep")
            tables.append(deep)
        alike = write_table(_likeness(large, deep), "likeness")
        tables.append(alike)
        leaves.append(large.join(alike.where(F.col("likeness") >= DENSE), "node", "left_semi"))
        branching = large.join(alike.where(F.col("likeness") < DENSE), "node", "left_semi").select("tree", "node", "doc_id")
        entries = deep.select("doc_id", "coords").join(_few(branching), "doc_id").select("doc_id", "tree", _children().alias("node"))
    return reduce(DataFrame.unionByName, [leaf.select(F.col("node").alias("grp"), "doc_id", "n", "first") for leaf in leaves]), tables, deep


def _with_first(large: DataFrame, firsts: DataFrame) -> DataFrame:
    """node or grp, doc_id, n_shingles, sketch of the documents of large nodes, with first_n and of, the size and sketch
    of the node's first document. There are so few large nodes that these are broadcast if their count allows it."""
    key = large.columns[0]
    ids = large.select(key, F.col("first").alias("doc_id")).distinct()
    of = write_table(ids.join(firsts.select("doc_id", "n_shingles", "sketch"), "doc_id").select(key, F.col("n_shingles").alias("first_n"), F.col("sketch").alias("of")), "node-firsts")
    of = F.broadcast(of) if of.count() <= BROADCAST_IDS // 16 else of
    return firsts.select("doc_id", "n_shingles", "sketch").join(_few(large.select(key, "doc_id", "first")), "doc_id").join(of, key)


def _likeness(large: DataFrame, firsts: DataFrame) -> DataFrame:
    """The mean share of equal sketch bytes of each large node's documents with the node's first one."""
    rows = _with_first(large.select("node", "doc_id", "first"), firsts).select("node", "sketch", "of")

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, FUNCTIONS) for c in ("sketch", "of"))
            return {"node": batch["node"], "share": (a == b).mean(1).tolist()}

        return work

    return map_columns(rows, make, "node long, share double").groupBy("node").agg(F.avg("share").alias("likeness"))


def _through_pivots(groups: DataFrame, firsts: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(grp, doc_id) to compare, and links (a, b) that are settled already.

    Documents of a large node that are linked with its first document (confirmed on full sets, both texts in the row)
    are connected through it. They need not meet each other; only the others meet all of the node, in blocks.
    """
    small = groups.where(F.col("n") <= NODE_LIMIT).select("grp", "doc_id")
    large = groups.where(F.col("n") > NODE_LIMIT).select("grp", "doc_id", "first")
    empty = small.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    if large.isEmpty():
        return small, empty
    least, threshold = least_equal(percent / 100), percent / 100

    def make() -> Callable[[dict], dict]:
        def work(batch: dict) -> dict:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, FUNCTIONS) for c in ("sketch", "of"))
            n, m = np.array(batch["n_shingles"]), np.array(batch["first_n"])
            near = ((a == b).sum(1) >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            return {"doc_id": batch["doc_id"], "first": batch["first"], "near": near.tolist()}

        return work

    near = map_columns(_with_first(large, firsts), make, "doc_id long, first long, near boolean").where("near and doc_id <> first")
    near = write_table(near.select("doc_id", "first").distinct(), "pivot-pairs")
    counts = write_table(near.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "pivot-counts")
    shares = F.ceil(F.col("n") / NODE_LIMIT).cast("int")
    near = join_counted(near, counts, ["first"]).withColumn("share", F.pmod(F.xxhash64("doc_id"), shares).cast("int"))
    # The first document's text goes to each share of the documents of its node.
    first_texts = texts.select(F.col("doc_id").alias("first"), F.col("text").alias("of")).join(counts, "first").dropDuplicates(["first"])
    first_texts = first_texts.select("first", "of", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    pairs = texts.join(near.select("doc_id", "first", "share"), "doc_id").join(first_texts, ["first", "share"])

    def confirm() -> Callable[[dict], dict]:
        held: dict[int, np.ndarray] = {}

        def work(batch: dict) -> dict:
            out: dict[str, list] = {"a": [], "b": []}
            for doc_id, first, text, of in zip(batch["doc_id"], batch["first"], batch["text"], batch["of"], strict=True):
                if first not in held:
                    held.clear()
                    held[first] = shingles(of, words)
                own, other = shingles(text, words), held[first]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    out["a"].append(doc_id)
                    out["b"].append(first)
            return out

        return work

    links = write_table(map_columns(pairs.select("doc_id", "first", "text", "of"), confirm, "a long, b long", rows=64), "pivot-links")
    joined = links.select(F.col("a").alias("doc_id"), F.col("b").alias("first"), F.lit(True).alias("done")).distinct()
    marked = large.join(joined, ["doc_id", "first"], "left").select("grp", "doc_id", (F.col("done").isNull() & (F.col("doc_id") != F.col("first"))).alias("open"))
    marked = write_table(marked, "pivoted")
    blocks = in_blocks(marked, "grp", "doc_id", NODE_LIMIT).select(F.xxhash64("grp", "part").alias("grp"), "doc_id")
    return small.unionByName(blocks), links


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The documents that near_groups keeps, one of each group of linked ones; all columns stay.

    Rows are dropped by doc_id: a row without one always stays, and rows that share one go together, also if their texts
    differ, when any of them is a copy of a document with a smaller id. Make ids unique first where that matters. An empty
    table stays empty.
    """
    gone = write_table(near_groups(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    (name,) = unused(docs, "gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)), docs["doc_id"].cast("long") == F.col(name), "left_anti")
