"""Identity of candidates, worked out by hand: what makes two of them the same, and what keeps them apart."""

from pyspark.sql import functions as F

from sightline.operators import funnel, identity

E = "struct<path:string,line:int,kind:string,method_id:string,taxonomy:string,text:string,ordinal:int>"
G = "struct<code:string,critical:boolean,line:int>"
SCHEMA = (
    "n int, candidate_id string, rule_id string, component string, component_name string, flow_kind string, entry_points array<string>, entry_method_id string, chain_id string, "
    f"authorization_matrix array<struct<operation:string,path_region:struct<kind:string,value:string>>>, sources array<{E}>, sinks array<{E}>, propagation_paths array<{E}>, "
    f"blocking_gaps array<{G}>, guard_coverage struct<status:string,line:int>, permissions array<string>, tail map<string,string>, elapsed_ms int, ai_score int, "
    f"locations array<{E}>, receiver_flag_tier string, receiver_binding struct<registration:struct<path:string,line:int>,actions:array<string>>, binder_remote_interface boolean, binder_transaction string"
)


def end(path="p", line=1, method_id="m", text="t"):
    return (path, line, "k", method_id, "file", text, 0)


BASE = {
    "candidate_id": None, "rule_id": "R", "component": "activity", "component_name": "a.B", "flow_kind": "source_to_sink", "entry_points": ["x", "y"], "entry_method_id": "m1",
    "chain_id": "c1", "authorization_matrix": [("read", ("exact", "/a")), ("write", ("all", None))], "sources": [end()], "sinks": [end("q")],
    "propagation_paths": [end(method_id="u"), end(method_id="v")], "blocking_gaps": [("A", True, 1)], "guard_coverage": ("absent", 3), "permissions": ["r", "w"], "tail": {"k": "v"},
    "elapsed_ms": 5, "ai_score": 1, "locations": [end()], "receiver_flag_tier": None, "receiver_binding": None, "binder_remote_interface": None, "binder_transaction": None,
}
NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]


def table(spark, *changes):
    rows = [BASE, *({**BASE, **c} for c in changes)]
    return spark.createDataFrame([(i, *(r[c] for c in NAMES[1:])) for i, r in enumerate(rows)], SCHEMA)


def same(spark, *changes):
    """For each changed candidate, whether its scope, chain and facts are those of the first."""
    rows = identity.identified(table(spark, *changes), ("n",)).orderBy("n").select(*identity.KEYS).collect()
    return [tuple(r[k] == rows[0][k] for k in identity.KEYS) for r in rows[1:]]


def test_what_does_not_count(spark):
    assert same(
        spark,
        {"entry_points": ["y", "x", "x"], "permissions": ["w", "r"], "authorization_matrix": BASE["authorization_matrix"][::-1]},
        {"chain_id": "c2", "rule_id": "S", "ai_score": 9, "candidate_id": "z", "locations": None},
        {"sources": [end(text="other")], "propagation_paths": [end("z", 9, "u", "x"), end("z", 8, "v", "y")]},
        {"blocking_gaps": [("A", True, 7), ("A", True, 9)], "guard_coverage": ("absent", 99)},
    ) == [(True, True, True)] * 4


def test_what_counts(spark):
    assert same(
        spark,
        {"propagation_paths": BASE["propagation_paths"][::-1]},
        {"sources": [end(line=2)]},
        {"entry_points": ["x"]},
        {"entry_method_id": "m2"},
        {"blocking_gaps": [("A", False, 1)]},
        {"guard_coverage": ("present", 3)},
        {"tail": {"k": "w"}},
        {"component_name": "a.C"},
        {"authorization_matrix": [("read", ("exact", "/b")), ("write", ("all", None))]},
    ) == [(True, False, True), (True, False, True), (False, True, False), (False, False, True), (True, True, False), (True, True, False), (True, True, False), (False, True, False), (False, True, False)]


def test_without_a_chain_the_rule_counts(spark):
    assert same(spark, {"chain_id": None}, {"chain_id": None, "rule_id": "S"})[0] == (True, True, False)
    rows = identity.identified(table(spark, {"chain_id": None}, {"chain_id": None, "rule_id": "S"}, {"chain_id": ""}), ("n",)).orderBy("n").collect()
    assert rows[1]["fact_key"] != rows[2]["fact_key"] and rows[1]["fact_key"] == rows[3]["fact_key"]


def test_receivers_of_one_owner_and_binder_transactions_of_one_service(spark):
    receiver = {"flow_kind": "receiver_exposure", "receiver_flag_tier": "t", "entry_method_id": "x#M:1", "component_name": "dynamic:a/b/c/D.java", "receiver_binding": (("a/b/c/D.java", 1), ["p", "q"])}
    other = {**receiver, "entry_method_id": "x#M:9", "component_name": "dynamic:a/b/c/E.java", "receiver_binding": (("a/b/c/E.java", 9), ["q", "p", "p"]), "sources": [end(line=44, method_id="n")]}
    binder = {"binder_remote_interface": True, "binder_transaction": "one", "entry_method_id": "m7"}
    rows = identity.identified(table(spark, receiver, other, {**other, "receiver_flag_tier": "u"}, binder, {**binder, "binder_transaction": "two", "sinks": [], "entry_points": []}), ("n",)).orderBy("n").select(*identity.KEYS).collect()
    assert rows[1] == rows[2] and rows[2] != rows[3] and rows[4] == rows[5] and rows[0] != rows[4]


def test_no_two_values_share_a_text(spark):
    rows = [("a|b", ["c"]), ("a", ["b|c"]), ("~", None), (None, ["~"]), (None, None), ("", []), (None, []), ("", None), ("1:a", ["a", "b"]), ("1:a", ["ab"]), ("1:a", ["b", "a"])]
    found = spark.createDataFrame(rows, "a string, b array<string>")
    keys = {r[0] for r in found.select(identity.exact_key(found)).collect()}
    assert len(keys) == len(rows)


def test_exact_groups(spark):
    changes = ({"elapsed_ms": 9, "ai_score": None}, {"permissions": ["w", "w", "r"]}, {"tail": {"k": "v", "seen_at": "now"}}, {"propagation_paths": BASE["propagation_paths"][::-1]}, {"rule_id": "S"}, {})
    rows = {r["n"]: (r["first"], r["n_same"]) for r in identity.exact_groups(table(spark, *changes), "n").collect()}
    assert rows == {0: (0, 5), 1: (0, 5), 2: (0, 5), 3: (0, 5), 4: (4, 1), 5: (5, 1), 6: (0, 5)}
    assert identity.exact_groups(table(spark).limit(0), "n").count() == 0


def test_ids(spark):
    made = [r[0] for r in identity.identified(table(spark, {"candidate_id": "own"}, {"candidate_id": ""}, {"locations": [end(), end("z")]}, {"locations": [end("z"), end()]}), ("n",)).orderBy("n").select("candidate_id").collect()]
    assert made[1] == "own" and made[0] == made[2] != made[3] == made[4] and len(made[0]) == len("candidate_") + 20


def test_few_columns(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "component_name string, x int")
    keys = [tuple(r) for r in identity.identified(rows).select(*identity.KEYS).collect()]
    assert keys[0][:2] == keys[1][:2] and keys[0][2] != keys[1][2] and keys[0] != keys[2]


def test_results_go_to_sound_members_only(spark):
    rows = table(spark, {"risk": 1}, {}, {}, {"component": "service"}).drop("candidate_id")
    rows = identity.identified(rows, ("n", "result", "guard_blocked")).withColumns({"needs": F.col("n") == 1, "risk": F.lit(None).cast("int"), "guard_blocked": F.lit(None).cast("boolean"), "result": F.concat(F.lit("r"), "n")})
    rows = rows.withColumn("rule_version", F.when(F.col("n") == 2, "changed")).withColumn("flag", F.when(F.col("n") == 2, True))
    got = {r["n"]: (r["representative"], r["result"], r["result_source"]) for r in funnel.propagated(rows, "n", "result", "locations", ("result", "guard_blocked")).collect()}
    assert got == {0: (1, "r1", 1), 1: (1, "r1", None), 2: (1, "r2", None), 3: (1, "r1", 1), 4: (4, "r4", None)}
    groups = sorted((r["representative"], r["n_members"], r["group_needs"]) for r in funnel.groups(rows, "n", "locations").collect())
    assert groups == [(1, 4, True), (4, 1, False)]


def test_keys_of_one_content_are_made_once(spark, monkeypatch):
    """Ids, texts, places and the chain's id do not part contents; nulls, empty lists and a rule without a chain do. Keys,
    results and sources are those of rows that make their own keys."""
    step = {"sources": [end(text="u")], "chain_id": "c2", "locations": []}
    changes = [
        step, {"sources": None}, {"sources": []}, {"sources": [end(), None]}, {"sources": [None, end()]}, {"propagation_paths": [end(method_id=None, path="")]}, {"propagation_paths": [end(method_id=None, path="", text="u")]},
        {"blocking_gaps": None}, {"blocking_gaps": []}, {"guard_coverage": None}, {"guard_coverage": (None, 1)}, {"permissions": [None, "r"]}, {"permissions": ["r", None]}, {"chain_id": None}, {"chain_id": "", "rule_id": "S"},
        {"flow_kind": "receiver_exposure", "receiver_binding": (("a/b/c/d", 2), ["y", "x"])}, {"flow_kind": "receiver_exposure", "receiver_binding": (None, ["x"])}, {"binder_remote_interface": True}, {"tail": {"k": None}},
    ]
    rows = table(spark, *changes, *[step] * 9)
    sort = lambda frame: sorted(map(str, frame.collect()))
    columns = ["n", *identity.KEYS, "candidate_id"]
    want = sort(identity.identified(rows, ("n",)).select(*columns))
    made, once = [], identity.keys_once
    monkeypatch.setattr(identity, "keys_once", lambda *a: made.append(once(*a)) or made[-1])
    assert sort(identity.identified(rows, ("n",), "n").select(*columns)) == want
    assert made[0].count() < len(changes) + 1 < rows.count()
    recorded = identity.identified(rows, ("n",)).withColumns({"needs": F.col("n") == 3, "risk": F.col("n") % 5, "result": F.col("n") * 2}).withColumn("component", F.when(F.col("n") % 4 == 1, "x").otherwise(F.col("component")))
    got = sort(funnel.propagated(recorded, "n", "result", "locations", ("result",), ()))
    monkeypatch.setattr(identity, "CONTENTS", 0)
    assert sort(identity.identified(rows, ("n",), "n").select(*columns)) == want and made[-1] is None
    assert sort(funnel.propagated(recorded, "n", "result", "locations", ("result",), ())) == got
