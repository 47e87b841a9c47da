"""Growth of a taxonomy, worked out by hand."""

from sightline.operators import taxonomy

ENTRIES = "place int, method string, leaves array<string>, prefixes array<string>, exact array<string>, arities array<int>, taxonomy string, severity string, source string"
PROPOSALS = "proposal int, method string, leaves array<string>, prefixes array<string>, exact array<string>, taxonomy string, severity string"


def frames(spark):
    entries = spark.createDataFrame([(0, "a", ["X", "Y"], None, None, [1], "old", "high", "base"), (1, "a", None, None, None, None, "free", None, "manual"), (5, "b", None, ["p.", "q."], None, None, "old", None, "base")], ENTRIES)
    proposals = spark.createDataFrame(
        [(1, "a", ["Y", "X"], [], None, "new", None), (2, "a", None, None, None, "other", "low"), (3, "b", None, ["q.", "p."], None, "swapped", "low"), (4, "c", ["Z"], None, None, "added", None), (5, "c", ["Z"], None, None, "again", None)], PROPOSALS
    )
    return entries, proposals


def test_promotion_and_doing_it_again(spark):
    entries, proposals = frames(spark)
    grown, told = taxonomy.promoted(entries, proposals)
    assert {r["proposal"]: r["status"] for r in told.collect()} == {1: "upgraded", 2: "skipped", 3: "appended", 4: "appended", 5: "skipped"}
    rows = {r["place"]: (r["method"], r["arities"], r["taxonomy"], r["severity"], r["source"]) for r in grown.collect()}
    assert rows == {0: ("a", [1], "new", "high", "manual"), 1: ("a", None, "free", None, "manual"), 5: ("b", None, "old", None, "base"), 6: ("b", None, "swapped", "low", "manual"), 7: ("c", None, "added", None, "manual")}
    again, told = taxonomy.promoted(grown, proposals)
    assert {r["status"] for r in told.collect()} == {"skipped"} and sorted(map(str, again.collect())) == sorted(map(str, grown.collect()))
    first, _ = taxonomy.promoted(entries.limit(0), proposals)
    assert sorted((r["place"], r["taxonomy"]) for r in first.collect()) == [(0, "new"), (1, "other"), (2, "swapped"), (3, "added")]
    same, told = taxonomy.promoted(entries, proposals.limit(0))
    assert same.count() == 3 and told.count() == 0


def test_only_what_changed_is_judged_anew(spark):
    entries, proposals = frames(spark)
    grown, _ = taxonomy.promoted(entries, proposals)
    calls = spark.createDataFrame([(1, "a", "X", 1), (2, "a", "Q", 2), (3, "b", "p.T", 0), (4, "c", "q.Z", 0), (5, "d", "X", 0), (6, None, None, None)], "call int, method string, receiver string, arity int")
    got = sorted(tuple(r) for r in taxonomy.judged_anew(calls, entries, grown).collect())
    assert got == [(1, "old", "new"), (4, None, "added")]
    assert taxonomy.judged_anew(calls, entries, entries).count() == 0


def test_versions():
    assert [taxonomy.next_version(v, 1) for v in ("1.0.0", "2.5", "x", "", "1.2.3.4")] == ["1.0.1", "2.5.1", "1.0.1", "1.0.1", "1.2.4"]
    assert taxonomy.next_version("1.0.8", 3) == "1.0.11"
