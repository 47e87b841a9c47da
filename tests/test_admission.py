from sightline.operators import admission, graph
from sightline.plans import registry

SF = "/root/testdata/sf0.001"


def test_greedy_against_brute_force(spark):
    turns = sorted((r["conv_id"], r["turn"], len(r["text"] or "")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    want, used = {}, {}
    for conv, turn, n in turns:
        fits = used.get(conv, 0) + n <= 600
        used[conv] = used.get(conv, 0) + (n if fits else 0)
        want[conv, turn] = (fits, used[conv])
    got = {(r["conv_id"], r["turn"]): (r["admitted"], r["used"]) for r in registry.QUERIES["context_admission"](spark, SF).collect()}
    assert got == want and {f for f, _ in got.values()} == {True, False}


def test_greedy_with_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1, 4), (None, 2, 9), (None, 3, 6), ("a", 1, None), ("a", 2, 11)], "s string, o int, c int")
    got = {(r["s"], r["o"]): r["admitted"] for r in admission.greedy(rows, "s", "o", "c", 10).collect()}
    assert got == {(None, 1): True, (None, 2): False, (None, 3): True, ("a", 1): True, ("a", 2): False}
    assert admission.greedy(rows.limit(0), "s", "o", "c", 10).count() == 0


def test_walk_up_ends(spark):
    chain = [(i, i + 1) for i in range(20)] + [(20, None), (30, 31), (31, 30), (40, 99)]
    found = {r["vertex"]: (r["top"], r["steps"], r["gap"]) for r in graph.walk_up(spark.createDataFrame(chain, "vertex long, parent long")).collect()}
    assert len(found) == len(chain)
    assert found[18] == (20, 2, None) and found[0] == (8, 8, "depth_limit") and found[40] == (99, 1, None)
    assert found[30][2] == found[31][2] == "cycle"
