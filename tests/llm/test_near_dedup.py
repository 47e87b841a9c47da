import collections
import random
import re

import numpy as np

from sightline.llm import near_dedup
from sightline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=75):
    """component by document, over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    inverse, parent = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = collections.Counter(j for s in own for j in inverse[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            inverse[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs).collect()}
    assert got == want


def test_all_documents_against_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def variants(draw, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_large_groups_near_the_threshold_branch_and_are_cut(spark, monkeypatch):
    """Small limits force branching, dense nodes and blocks; no link may be lost."""
    draw = random.Random(2)
    line = [f"c{i}" for i in range(40)]
    texts = variants(draw, [f"a{i}" for i in range(90)], 70, 8)
    texts += [" ".join(line + [f"x{k}_{i}" for i in range(60)]) for k in range(60)]
    texts += variants(draw, line + [f"b{i}" for i in range(50)], 40, 5)
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 12)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_documents(odd_documents, no_documents):
    rows = near_dedup.near_groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id in (3, 4, 5):
        assert (by_id[doc_id]["n_shingles"], by_id[doc_id]["component_id"], by_id[doc_id]["kept"]) == (0, doc_id, True)
    assert by_id[7]["component_id"] == 1 and not by_id[7]["kept"]
    assert by_id[10]["component_id"] == 9
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert near_dedup.near_groups(no_documents).count() == 0
    kept = near_dedup.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(11)]  # 7 shingles; one word more at the end: 7 of 8, three more: 7 of 10
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x", "y"])), (3, " ".join([*base, "p", "q", "r"]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_a_long_path_and_of_nothing(spark):
    links = spark.range(0, 60).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long"))
    got = {r["vertex"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_partners_are_one_group_wherever_they_meet():
    """Nodes of other company and order find the same pairs: each is one group, and no larger than its partners."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 256, (4, near_dedup.FUNCTIONS), dtype=np.uint8)
    near = base.copy()
    near[:, :10] = 7
    row = {i: base[i].tobytes() for i in range(4)} | {10 + i: near[i].tobytes() for i in range(3)} | {20: near[0].tobytes()}
    group = lambda grp, ids: {"grp": [grp] * len(ids), "doc_id": ids, "n_shingles": [100 + i % 3 for i in ids], "sketch": [row[i] for i in ids]}
    found = [near_dedup.partnered(group(g, ids), 0.75) for g, ids in enumerate(([0, 10, 1, 11, 3, 20], [3, 11, 20, 2, 1, 10, 0], [1, 11]))]
    parts = [{frozenset(d for d, h in zip(f["doc_id"], f["grp"], strict=True) if h == g) for g in f["grp"]} for f in found]
    assert parts == [{frozenset({0, 10, 20}), frozenset({1, 11})}] * 2 + [{frozenset({1, 11})}]
    assert set(found[0]["grp"]) == set(found[1]["grp"]) > set(found[2]["grp"])
    assert near_dedup.partnered(group(9, [0, 1, 2, 3]), 0.75) is None
