"""Targets of calls worked out by hand."""

from sightline.operators import symbols

CALLS = "call int, method_name string, descriptor string, receiver_text string, receiver_type string, caller_class string"


def test_targets(spark):
    methods = spark.createDataFrame(
        [("a", "run", "p.A", "(q.X)"), ("b", "run", "p.B", "(X)"), ("c", "run", "p.B", "(Y)"), ("d", "stop", "p.A", "()"), ("e", "stop", "r.E", ""), ("f", "go", "p.A", "(X)"), ("g", "go", "p.A", "(?)"), ("h", "run", None, "(X)"), ("i", "top", "T", None)],
        "id string, name string, qualified_class string, descriptor string",
    )
    cases = [
        (("run", "(X)", "", None, "p.A"), ("resolved", "a")), (("run", "(X)", "this", "", "p.C"), ("ambiguous", None)), (("run", "(Y)", None, None, "p.C"), ("resolved", "c")), (("run", "(?)", "", "", "p.B"), ("ambiguous", None)),
        (("run", "(X)", "super", "p.A", "p.A"), ("pending", None)), (("run", "(X)", "x", None, "p.A"), ("pending", None)), (("run", "(X)", "x", "B", "p.A"), ("resolved", "b")), (("run", "(X)", "x", "B", "z.A"), ("pending", None)),
        (("stop", "()", "x", "Lr/E;", "p.A"), ("resolved", "e")), (("stop", None, "x", "this", "p.A"), ("resolved", "d")), (("go", "(X)", "", None, "p.A"), ("ambiguous", None)), (("go", "(Z)", "", None, "p.A"), ("resolved", "g")),
        (("run", "(X,X)", "", None, "p.A"), ("pending", None)), (("top", "()", "", None, "T"), ("resolved", "i")), (("top", "()", "x", "this", None), ("pending", None)), ((None, None, None, None, None), ("pending", None)),
    ]
    calls = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], CALLS)
    got = symbols.targets(calls, methods).orderBy("call").collect()
    assert [(r["status"], r["target"]) for r in got] == [w for _, w in cases]
    assert symbols.targets(calls.limit(0), methods).count() == 0
    assert {r["status"] for r in symbols.targets(calls, methods.limit(0)).collect()} == {"pending"}
