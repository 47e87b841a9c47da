"""Summaries, values of variables, spans and admission, by hand and against brute force."""

import random

from pyspark.sql import functions as F

from sightline.operators import admission, flow, resolution, windows


def test_summaries_against_brute_force(spark):
    """Random calls with cycles and recursion: the closure of all facts, turn by turn."""
    draw = random.Random(4)
    methods = range(40)
    names = {m: [f"p{i}" for i in range(3)] for m in methods}
    calls = [(m, draw.randrange(40), [draw.choice(["p0", "f(p1, x)", "p2.y", "none", "p0 + p1"]) for _ in range(draw.randrange(4))], draw.choice(["a", "b", None])) for m in methods for _ in range(2)]
    returns = [(m, draw.choice(["a", "g(b)", "c"])) for m in methods]
    facts = {(m, draw.choice(flow.CATEGORIES), draw.randrange(3)) for m in methods if draw.random() < 0.3}
    want, grown = set(facts), True
    while grown:
        grown = False
        for m, target, arguments, assigned in calls:
            given = {w for r, e in returns if r == m for w in ("a", "b", "c") if w in e.replace("g(", "")}
            for t, category, slot in list(want):
                if t != target or slot >= len(arguments) or (category == "return" and assigned not in given):
                    continue
                for i, name in enumerate(names[m]):
                    if name in arguments[slot] and (m, category, i) not in want:
                        want.add((m, category, i))
                        grown = True
    frames = (
        spark.createDataFrame([(m, n, i) for m in methods for i, n in enumerate(names[m])], "method int, name string, slot int"),
        spark.createDataFrame(calls, "method int, target int, arguments array<string>, assigned_to string"),
        spark.createDataFrame(returns, "method int, expression string"), spark.createDataFrame(sorted(facts), "method int, category string, slot int"),
    )
    found, status = flow.summaries(*frames)
    assert {(r["method"], r["category"], r["slot"]) for r in found.collect()} == want and status == "converged" and len(want) > len(facts)
    some, status = flow.summaries(*frames, most=1)
    assert status == "limit_reached" and {r["round"] for r in some.collect()} == {0, 1}
    none, status = flow.summaries(*frames[:3], frames[3].limit(0))
    assert none.count() == 0 and status == "converged"


def test_sinks_are_found_through_any_number_of_transfers(spark):
    path = spark.range(0, 50).selectExpr("id as method", "0 as slot", "id + 1 as to_method", "0 as to_slot")
    assert flow.reaching_sinks(path, spark.createDataFrame([(50, 0)], "method long, slot int")).count() == 51


def test_values_of_variables(spark):
    rows = [("m", "f", 1, "define", "A"), ("m", "f", 2, "add", "B"), ("m", "f", 2, "use", None), ("m", "f", 3, "define", None), ("m", "f", 4, "add", "C"), ("m", "f", 5, "use", None), ("m", "f", 6, "kill", "D"), ("m", "f", 7, "use", None),
            ("m", "g", 1, "use", None), ("n", "f", 9, "add", "E"), ("n", "f", 9, "use", None), (None, "f", 1, "define", "F"), (None, "f", 2, "use", None)]
    events = spark.createDataFrame(rows, "method string, variable string, ordinal int, kind string, value string")
    got = {(r["method"], r["variable"], r["ordinal"]): (r["values"], r["known"]) for r in flow.held_values(events, ["method"]).collect()}
    assert got == {("m", "f", 2): (["A", "B"], True), ("m", "f", 5): (["C"], True), ("m", "f", 7): ([], False), ("m", "g", 1): ([], False), ("n", "f", 9): (["E"], False), (None, "f", 2): (["F"], True)}
    assert flow.held_values(events.limit(0), ["method"]).count() == 0


def spans(draw, n, first):
    out = []
    for i in range(n):
        start = draw.randrange(-50, 200)
        out.append((draw.choice("ab"), first + i, start, start + draw.choice([0, 1, 2, 7, 40, 300, -1])))
    return out


def test_overlaps_and_innermost_against_brute_force(spark):
    draw = random.Random(8)
    a, b = spans(draw, 120, 0), spans(draw, 90, 1_000)
    frame = lambda rows, name: spark.createDataFrame(rows, f"k string, {name} int, start int, `end` int")
    got = sorted(tuple(r) for r in resolution.overlapping(frame(a, "x"), frame(b, "y"), "k", "x", "y").collect())
    assert got == sorted((x, y) for k, x, s, e in a for q, y, t, f in b if k == q and s <= e and t <= f and s <= f and t <= e)
    points = [(draw.choice("abc"), i, draw.randrange(-60, 300)) for i in range(80)]
    found = resolution.innermost(spark.createDataFrame(points, "k string, p int, at int"), frame(a, "span_id"), "k", "at", "p")
    for r in found.collect():
        near = sorted((e - s, x) for k, x, s, e in a if k == r["k"] and s <= r["at"] <= e)
        best = [x for size, x in near if size == near[0][0]]
        assert r["span_id"] == (best[0] if len(best) == 1 else None)
    assert resolution.overlapping(frame(a, "x").limit(0), frame(b, "y"), "k", "x", "y").count() == 0


def test_keys_may_clash(spark):
    calls = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "n_first int, k string, id_first int")
    targets = spark.createDataFrame([(7, "a")], "t int, k string")
    assert sorted(tuple(r) for r in resolution.by_key(calls, targets, ["k"], "t").select("n_first", "id_first", "target", "status").collect()) == [(1, 5, 7, "resolved"), (2, 6, None, "pending")]


def test_running_totals_over_parts(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 5 + ["a", None]), i, draw.choice([None, *range(-3, 9)])) for i in range(2_000)]
    got = {r["o"]: r["total"] for r in windows.running_total(spark.createDataFrame(rows, "s string, o int, v int").repartition(7), ["s"], ["o"], F.col("v"), "total").collect()}
    sums, want = {}, {}
    for s, o, v in rows:
        sums[s] = sums.get(s, 0) + (v or 0)
        want[o] = sums[s]
    assert got == want


def greedy(rows, budget):
    used, out = {}, {}
    for s, o, c in rows:
        fits = used.get(s, 0) + (c or 0) <= budget
        used[s] = used.get(s, 0) + ((c or 0) if fits else 0)
        out[s, o] = (fits, used[s])
    return out


def test_admission_against_the_loop(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "a", None]), i, draw.choice([None, 0, 1, 5, 40, 90, 101])) for i in range(500)]
    frame = spark.createDataFrame(rows, "s string, o int, c int")
    assert {(r["s"], r["o"]): (r["admitted"], r["used"]) for r in admission.greedy(frame, "s", "o", "c", 100).collect()} == greedy(rows, 100)
    assert admission.greedy(frame.limit(0), "s", "o", "c", 100).columns == ["s", "o", "c", "admitted", "used"]


def test_contexts_by_hand(spark):
    rows = [(1, 0, "a", 40), (1, 1, "b", 10), (1, 3, "c", 30), (1, 2, "d", 45), (1, 3, "e", 5), (1, 4, "f", 5), (2, 0, "a", 60), (2, 1, "b", 50), (2, 4, "c", 1), (3, 2, "a", None)]
    frame = spark.createDataFrame(rows, "s int, priority int, id string, cost int")
    got = {(r["s"], r["id"]): (r["selected"], r["reason"], r["status"]) for r in admission.contexts(frame, "s", "priority", "id", "cost", 100, 4).collect()}
    first = {"a": (True, None), "b": (True, None), "d": (True, None), "c": (False, "input_token_budget"), "e": (True, None), "f": (False, "context_count_budget")}
    assert got == {**{(1, k): (*v, "trimmed") for k, v in first.items()}, **{(2, k): (True, None, "cannot_trim_safely") for k in "abc"}, (3, "a"): (True, None, "within_budget")}


def test_line_windows(spark):
    cases = [((1, 50, 10, 12, False), ("unchanged", 1, 50)), ((1, 300, None, None, True), ("cannot_trim_safely", 1, 300)), ((1, 300, None, None, False), ("omit", 1, 300)), ((1, 300, 10, 200, True), ("cannot_trim_safely", 1, 300)),
             ((1, 300, 150, 160, True), ("trimmed", 106, 205)), ((1, 300, 2, 3, True), ("trimmed", 1, 100)), ((1, 300, 295, 299, True), ("trimmed", 201, 300))]
    frame = spark.createDataFrame([c for c, _ in cases], "a int, b int, f int, l int, core boolean")
    got = [tuple(r[0]) for r in frame.select(admission.line_window(F.col("a"), F.col("b"), F.col("f"), F.col("l"), 100, F.col("core"))).collect()]
    assert got == [w for _, w in cases]
