import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from sightline.llm import conversations as c
from sightline.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, id int, said string, `n` int"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """Turns (turn, role, text) of each conversation after damage, in order."""
    spaced, out = lambda v: " " if v is None else str(v), collections.defaultdict(list)
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if how == 4 else spaced(role), {1: "", 2: re.sub("[.!?]", "", spaced(text))}.get(how, spaced(text))
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    for conv, turns in out.items():
        whole = lambda t: ":".join("null" if x is None else str(x) for x in (conv, t[0], len(t[1]), t[1], t[2]))  # noqa: E731, B023
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(whole(t).encode()).hexdigest()))
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = VISIBLE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(found):
    out = {}
    for state, way in found:
        if state not in out or way[:2] < out[state][:2]:
            out[state] = way
    return out


def walked(turns, found):
    """cost, audit and lines of the cheapest repair, turn by turn over all ways to each state."""

    def inserted(best):
        for _ in range(4):
            more = [(NEXT[s, r[0]], (k + 2, a + "I", [*lines, r + ":"])) for s, (k, a, lines) in best.items() for r in ("user", "assistant") if (s, r[0]) in NEXT]
            best = least([*best.items(), *more])
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(turns, found, strict=True):
        ways = []
        for s, (k, a, lines) in inserted(best).items():
            ways.append((s, (k + 3, a + "D", lines)))
            for letter, r, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if fault in ("", "truncated") and (s, r[:1]) in NEXT:
                    ways.append((NEXT[s, r[:1]], (k + price + (fault == "truncated"), a + letter, [*lines, f"{r}:{text}"])))
        best = least(ways)
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])


def brute(rows):
    out = {}
    for conv, turns in damage(rows).items():
        found, when = faults(turns), [t for t, _, _ in turns if t is not None]
        cost, audit, lines = walked(turns, found)
        gaps = max(when) - min(when) + 1 - len(set(when)) if when else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(frame):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in frame.collect()}


def odd(seed, n=400):
    """Nulls in every column, ties, repeats, roles of every kind, one conversation with a third of all rows."""
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "ustad"], ["Hi.", "What? ", "so", "Well!\n", " ", "", None, "a b", "\x85", "ok. ", "漢!"]
    rows = [(draw.choice([None, *[1] * 4, *range(2, 9)]), draw.choice([None, *range(40)]), draw.choice(roles), draw.choice(texts)) for _ in range(n)]
    return rows + rows[:40]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_query_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    got = result(queries.op11_conversation_repair(spark, sf))
    assert got == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duck.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.ORACLE_SQL['op11_conversation_repair']})").fetchall()
    assert got == {r[0]: r[1:] for r in want}


def test_odd_rows_in_small_blocks_and_many_levels(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 3)
    monkeypatch.setattr(c, "FAN", 2)
    rows = odd(5)
    assert result(c.repair_damaged(frame(spark, rows))) == brute(rows)


def test_a_long_conversation_is_the_same_in_blocks_and_parts(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(1, i, draw.choice(["user", "assistant"]), f"Turn {i}{draw.choice('.,')}") for i in range(3_000)]
    monkeypatch.setattr(c, "BLOCK", 100)
    assert result(c.repair_damaged(frame(spark, rows))) == brute(rows)


def test_no_rows_and_conversations_of_which_nothing_is_left(spark):
    assert c.repair_damaged(frame(spark, [(1, 1, "user", "x.")]).limit(0)).count() == 0
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(c.repair_damaged(frame(spark, [(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    """Worked out by hand: a leading assistant turn costs as much to rerole as to put a user turn before; I sorts first."""
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Yes?"), (1, 3, "user", " "), (1, 4, "assistant", "No."), (2, 1, "tool", "run")]
    reports, turns = c.repair(frame(spark, rows))
    found = {r["conv_id"]: (r["cost"], r["audit"], r["blank"], r["truncated"]) for r in reports.collect()}
    assert found == {1: (5, "IKKDK", 1, 0), 2: (3, "D", 0, 1)}
    lines = [tuple(r) for r in turns.select("place", "edit", "role", "text").orderBy("place").collect()]
    assert lines == [(0, "I", "user", ""), (1, "K", "assistant", "Hello."), (2, "K", "user", "Yes?"), (3, "K", "assistant", "No.")]


@pytest.mark.parametrize("seed", range(4))
def test_products_are_associative(seed):
    draw = random.Random(seed)
    turns = [(draw.choice("suax"), draw.choice(["", "", "blank", "duplicate", "truncated"]), draw.randint(1, 3)) for _ in range(40)]
    whole = c.of_turns(turns)
    for cut in (1, 7, 39):
        assert c.product(c.of_turns(turns[:cut]), c.of_turns(turns[cut:])) == whole
    assert c.power(c.turn("u", "duplicate"), 5) == c.reduced([c.turn("u", "duplicate")] * 5)
