"""Text rules on rows whose columns have the names that the operators use."""

from sightline.operators import text_rules


def test_hits_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a@b\nx\n c@d", "own", 7, "at", "held"), (2, None, "own", 7, "at", "held"), (3, "", "own", 7, "at", "held")], "id int, text string, line string, pos int, at string, held string")
    found = text_rules.hits(rows, {"mail": r"^\s?\w@\w$", "x": "x$"})
    assert sorted((r["id"], r["line_no"], r["rule_id"], r["line"], r["pos"], r["at"], r["held"]) for r in found.collect()) == [
        (1, 1, "mail", "own", 7, "at", "held"), (1, 2, "x", "own", 7, "at", "held"), (1, 3, "mail", "own", 7, "at", "held"),
    ]


def test_whole_tokens(spark):
    rows = spark.createDataFrame([(1, "a foo.bar"), (2, "xfoo $foo foo_"), (3, "FOO"), (4, None), (5, "")], "id int, text string")
    assert [r["id"] for r in rows.where(text_rules.has_token(rows["text"], ["foo", "$x"])).collect()] == [1, 3]
