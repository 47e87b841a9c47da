"""Evidence against files and methods, worked out by hand."""

from pyspark.sql import functions as F

from sightline.operators import evidence

ITEMS = "item int, candidate int, field string, artifact string, path string, line int, scope_id string, expected_scope string, method_id string, symbol_key string, quoted_text string"


def test_the_first_code_that_applies(spark):
    files = spark.createDataFrame([("a", 4, "one\r\ntwo\nthree\rfour"), ("b", 2, None)], "path string, line_count int, content string")
    methods = spark.createDataFrame([("m", "a", 1, 2, "s"), ("n", "a", 3, 4, "t"), ("o", "b", 1, 2, "s")], "id string, path string, start int, `end` int, symbol_key string")
    cases = [
        (("sources", None, "a", 2, None, None, None, None, None), None), (("sources", None, "a", 2, "S", "T", None, None, None), "SCOPE_ID_MISMATCH"), (("sources", None, "a", 2, "S", None, None, None, None), None),
        (("locations", "manifest", evidence.MANIFEST, None, None, None, None, None, None), None), (("locations", "manifest", "a", 1, None, None, None, None, None), "MANIFEST_LOCATION_INVALID"), (("sinks", "manifest", evidence.MANIFEST, 1, None, None, None, None, None), "LOCATION_NOT_INDEXED"),
        (("locations", "manifest", evidence.MANIFEST, 0, None, None, None, None, None), "MANIFEST_LOCATION_INVALID"), (("sources", None, "a", 5, None, None, None, None, None), "LOCATION_NOT_INDEXED"), (("sources", None, None, 1, None, None, None, None, None), "LOCATION_NOT_INDEXED"),
        (("sources", None, "a", 1, None, None, "x", None, None), "METHOD_ID_NOT_FOUND"), (("sources", None, "a", 1, None, None, None, "x", None), "SYMBOL_KEY_NOT_FOUND"), (("sources", None, "a", 1, None, None, "m", "t", None), "METHOD_SYMBOL_MISMATCH"),
        (("sources", None, "a", 4, None, None, None, "s", None), "SYMBOL_LOCATION_MISMATCH"), (("sources", None, "a", 4, None, None, "m", None, None), "METHOD_LOCATION_MISMATCH"), (("sources", None, "a", 1, None, None, "m", "s", None), None),
        (("sources", None, "b", 1, None, None, "o", None, None), "INDEX_CONTENT_UNAVAILABLE"), (("sources", None, "a", 1, None, None, None, None, "three"), "QUOTED_TEXT_MISMATCH"), (("sources", None, "a", 2, None, None, None, None, "one\ntwo"), None),
        (("sources", None, "a", 4, None, None, None, None, "four"), None), (("sources", None, "a", 4, None, None, None, None, ""), None),
    ]
    items = spark.createDataFrame([(i, 1, *c) for i, (c, _) in enumerate(cases)], ITEMS)
    got = evidence.verified(items, files, methods).orderBy("item")
    assert [r["reason"] for r in got.collect()] == [w for _, w in cases] and got.columns == [*items.columns, "reason"]
    assert evidence.verified(items.limit(0), files, methods).count() == 0
    assert evidence.verified(items, files.limit(0), methods.limit(0)).count() == len(cases)


def test_promotion_needs_everything(spark):
    fields = "n_locations int, n_sources int, n_sinks int, bad_locations int, bad_sources int, bad_sinks int, evidence_level string, deterministic_chain_verified boolean, dataflow_status string, guard_status string, authorization_status string, dynamic_validation_status string, promotion_requested boolean, gap boolean"
    whole = (1, 1, 1, 0, 0, 0, "L2", True, "verified", "absent", "unprotected", None, True, False)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip([f.split(" ")[0] for f in fields.split(", ")], whole, strict=True))
    cases = [
        (whole, ("verified", "closed", "statically_gradeable", "L3")), (change(promotion_requested=None), ("verified", "closed", "statically_gradeable", "L2")), (change(promotion_requested=None, evidence_level="L3"), ("verified", "closed", "statically_gradeable", "L3")),
        (change(gap=True), ("verified", "closed", "pending", "L2")), (change(bad_sinks=1), ("invalid", "closed", "pending", "L2")), (change(n_sinks=None), ("incomplete", "not_proven", "pending", "L2")), (change(evidence_level="L1", n_sinks=0, n_sources=0), ("verified", "not_applicable", "pending", "L1")),
        (change(dataflow_status="not_proven"), ("verified", "not_proven", "pending", "L2")), (change(guard_status="present_partial"), ("verified", "closed", "pending", "L2")), (change(authorization_status="protected"), ("verified", "closed", "pending", "L2")),
        (change(dynamic_validation_status="passed", gap=True), ("verified", "closed", "dynamically_confirmed", "L2")),
    ]
    got = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, " + fields).select("i", evidence.statuses(F.col("gap")).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"])[:4] for r in got] == [w for _, w in cases]
