from collections import Counter

from sightline.plans import registry

SF = "/root/testdata/sf0.001"


def following(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").collect()
    by_order, after = {}, {}
    for r in sorted(lines, key=lambda r: tuple(r)):
        by_order.setdefault(r["l_orderkey"], []).append(r)
    for rows in by_order.values():
        parts = [r["l_partkey"] for r in sorted(rows, key=lambda r: (r["l_linenumber"], r["l_partkey"], r["l_suppkey"]))]
        for a, b in zip(parts, parts[1:]):
            if a != b:
                after.setdefault(a, set()).add(b)
    return by_order, after


def levels(after, seeds, most, nodes=None):
    depth, frontier = dict.fromkeys(seeds, 0), set(seeds)
    for d in range(1, most + 1):
        frontier = {b for a in frontier for b in after.get(a, ())} - depth.keys()
        depth.update(dict.fromkeys(frontier, d))
        if not frontier:
            return depth, None
        if nodes and len(depth) >= nodes:
            return depth, "node_limit"
    return depth, "depth_limit"


def test_whole_reach_tree_and_hops(spark):
    by_order, after = following(spark)
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size", "p_brand").collect()
    want, ended = levels(after, [min(r["p_partkey"] for r in parts)], 8, 500)
    got = registry.QUERIES["tree_levels"](spark, SF).collect()
    assert {r["depth"]: r["n"] for r in got} == Counter(want.values()) and max(want.values()) > 1
    assert {r["ended"] for r in got} == {ended}
    want, _ = levels(after, [r["p_partkey"] for r in parts if r["p_size"] == 50 and r["p_brand"] == "Brand#4"], 8)
    assert {r["vertex"]: r["depth"] for r in registry.QUERIES["bounded_reach"](spark, SF).collect()} == want
    hops = Counter(r["l_orderkey"] for r in registry.QUERIES["first_hops"](spark, SF).collect())
    assert hops == {k: min(8, len(rows)) for k, rows in by_order.items()} and max(hops.values()) > 3
