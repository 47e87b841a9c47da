"""Repair of the structure of conversations by a min-plus matrix scan.

A repaired conversation has the role initials (s?(ua)+)?: four states. Each turn is a 4x4 matrix over (cost, audit):
its cheapest edits between two states, inserts before it among them. Products of matrices are associative, so a
conversation is cut into blocks at will: blocks are multiplied in tasks of their own, and the products of blocks by a
tree, 16 at a time. Costs add and audits are joined; of equal costs the audit that is least in ASCII wins. Two audits
of the same turns with equal costs never begin with one another, so joining keeps their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, join_counted, map_columns, small_batches, write_table

#: States: nothing yet, after s, after u, after a. The next state by the initial of a turn; the first and last are ends.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Turns of a block; products that one step of the tree takes together.
BLOCK, FAN = 2_048, 16
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Matrix = list  # 16 elements, row by row: (cost, audit), or None where no edits lead from one state to the other


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in STATES:
        row = [(k, a[4 * i + k]) for k in STATES if a[4 * i + k]]
        for j in STATES:
            least = None
            for k, x in row:
                y = b[4 * k + j]
                if y and (least is None or x[0] + y[0] <= least[0]):
                    found = (x[0] + y[0], x[1] + y[1])
                    if least is None or found < least:
                        least = found
            out.append(least)
    return out


def power(a: Matrix, n: int) -> Matrix:
    out, square = IDENTITY, a
    while n:
        if n & 1:
            out = product(out, square)
        n >>= 1
        if n:
            square = product(square, square)
    return out


IDENTITY: Matrix = [(0, "") if i == j else None for i in STATES for j in STATES]


def _closure() -> Matrix:
    """Any number of inserts: the sum of the powers of one insert. More than three turns of it never pay."""
    once: Matrix = [None] * 16
    for (i, role), j in NEXT.items():
        if role != "s":
            once[4 * i + j] = (INSERT, "I")
    out = IDENTITY
    for _ in range(3):
        out = [min([x for x in pair if x], default=None) for pair in zip(product(out, once), IDENTITY, strict=True)]
    return out


INSERTS = _closure()


@lru_cache(maxsize=64)
def turn(initial: str, fault: str) -> Matrix:
    """The edits of one turn, after inserts. fault: blank or duplicate (it must go), truncated, or none."""
    edits: Matrix = [(DELETE, "D") if i == j else None for i in STATES for j in STATES]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for (i, role), j in NEXT.items():
            ways = ([(more, "K")] if role == initial else []) + ([(REROLE + more, "R")] if role != "s" else [])
            edits[4 * i + j] = min([*ways, *([edits[4 * i + j]] if edits[4 * i + j] else [])], default=None)
    return product(INSERTS, edits)


@lru_cache(maxsize=100_000)
def _few(turns: tuple[tuple[str, str, int], ...]) -> Matrix:
    out = IDENTITY
    for initial, fault, n in turns:
        if n:
            out = product(out, turn(initial, fault))
        if n > 1:
            out = product(out, power(turn(initial, "blank" if fault == "blank" else "duplicate"), n - 1))
    return out


def reduced(matrices: list[Matrix]) -> Matrix:
    """The product of matrices, by a balanced tree."""
    while len(matrices) > 1:
        matrices = [product(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


def of_turns(turns: list[tuple[str, str, int]]) -> Matrix:
    return reduced([_few(tuple(turns[i : i + 8])) for i in range(0, len(turns), 8)])


def cheapest(whole: Matrix) -> tuple[int, str]:
    closed = product(whole, INSERTS)
    return min(closed[j] for j in ENDS if closed[j])


def edits_of(audit: str) -> Iterator[tuple[int, str, str]]:
    """(number of the turn that it is about, letter, role) for each letter of an audit but D; the role follows from the
    place in the repaired conversation, since its shape is fixed. A K leaves the turn's own role."""
    left = len(audit) - audit.count("D")
    at, place = 0, -(left % 2)  # an odd number of turns begins with s, at place -1
    for letter in audit:
        if letter != "D":
            yield at, letter, "assistant" if place % 2 else "user"
            place += 1
        at += letter != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of rows damaged by the checksum of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(part("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text")).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )


def _named(rows: DataFrame) -> DataFrame:
    """Rows with id and said: digests of the whole row and of its conversation, role and text."""
    of = lambda *c: F.sha2(F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in c], F.length("role").cast("string"), "role", "text"), 256)
    long = lambda c: F.col(c).cast("long").alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = long("copies") if "copies" in rows.columns else F.lit(1).cast("long").alias("copies")
    rows = rows.select(long("conv_id"), long("turn"), text("role"), text("text"), copies)
    return rows.withColumn("id", of("conv_id", "turn")).withColumn("said", of("conv_id"))


def _placed(rows: DataFrame) -> DataFrame:
    """The different rows of each conversation in order: n (how often a row is there), fault, row (its number), start (the
    number of its first copy), and alone: whether its conversation is in one block."""
    ended = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(ended == "", "blank").when(~F.substring(ended, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    small = rows.select("conv_id", "turn", "role", "id", "said", fault.alias("fault"), "copies")
    small = write_table(small.groupBy(*small.columns[:-1]).agg(F.sum("copies").alias("n")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    again = small.where("n > 0").groupBy("said").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = write_table(again, "said-again")
    late = F.coalesce(F.struct(F.col("turn").isNotNull().alias("set"), "turn") > F.col("first"), F.lit(False))
    marked = join_counted(small, again, ["said"], "left", "times")
    marked = marked.select("conv_id", "turn", "role", "id", "n", F.when((F.col("fault") != "blank") & late, "duplicate").otherwise(F.col("fault")).alias("fault"))
    # By ranges, so that a long conversation is dealt to many tasks; part rises along it.
    order = ["turn", "role", "id"]
    ranged = marked.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    ranged = ranged.withColumn("row", F.row_number().over(inside).cast("long")).withColumn("start", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranged = write_table(ranged.withColumn("in_part", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "part"))), "ranged-turns")
    # A part can continue one conversation at most, so there are no more of these rows than two for each part.
    along = Window.partitionBy("conv_id").orderBy("part")
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("copies"))
    ahead = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("parts"), ahead("rows").alias("rows"), ahead("copies").alias("copies"))
    parts = F.broadcast(parts.where("parts > 1"))
    found = ranged.join(parts, ranged["conv_id"].eqNullSafe(parts["of"]) & (ranged["part"] == parts["at"]), "left")
    more = lambda c, by: (F.col(c) + F.coalesce(F.col(by), F.lit(0))).alias(c)
    alone = F.col("parts").isNull() & (F.col("in_part") <= BLOCK)
    found = write_table(found.select("conv_id", "turn", "role", "id", "n", "fault", more("row", "rows"), more("start", "copies"), alone.alias("alone")), "placed-turns")
    for table in (small, again, ranged):
        drop_table(table)
    return found


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
LEGAL = {"su", "ua", "au"}
_PIECE = ", ".join(["cost array<int>", "audit array<string>", *[f"{c} long" for c in COUNTS], "low long", "high long", "first string", "last string"])


def _piece_of(turns: list[tuple]) -> dict:
    """What is known of successive rows (row, turn, initial, fault, n) of a conversation."""
    out = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "first": None, "last": None}
    kinds = []
    for _, turn_no, initial, fault, n in turns:
        if not n:
            continue
        kinds.append((initial, fault, n))
        if fault:
            out[fault] += n if fault in ("blank", "duplicate") else 1
        if fault in ("", "truncated"):
            out["duplicate"] += n - 1
        out["illegal"] += (n - 1) * (initial + initial not in LEGAL) + (out["last"] is not None and out["last"] + initial not in LEGAL)
        if out["first"] is None:
            out["first"] = initial
        out["last"] = initial
        if turn_no is not None and turn_no != out["high"]:
            out["turns"] += 1
            out["high"] = turn_no
            out["low"] = turn_no if out["low"] is None else out["low"]
    return out | _split(of_turns(kinds))


def _split(m: Matrix) -> dict:
    return {"cost": [x[0] if x else None for x in m], "audit": [x[1] if x else None for x in m]}


def _joined(pieces: list[dict]) -> dict:
    """What is known of successive pieces of a conversation together."""
    out = dict(pieces[0])
    for p in pieces[1:]:
        for c in COUNTS:
            out[c] += p[c]
        out["illegal"] += out["last"] is not None and p["first"] is not None and out["last"] + p["first"] not in LEGAL
        out["turns"] -= out["high"] is not None and out["high"] == p["low"]
        out["first"] = p["first"] if out["first"] is None else out["first"]
        out["last"] = out["last"] if p["last"] is None else p["last"]
        out["low"] = p["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if p["high"] is None else p["high"]
    matrices = [[None if c is None else (c, a) for c, a in zip(p["cost"], p["audit"], strict=True)] for p in pieces]
    return out | _split(reduced(matrices))


def _mapped(rows: DataFrame, keys: str, work: Callable[[dict], dict]) -> DataFrame:
    """rows (keys, list) with the columns of a piece in place of the list."""
    names = [k.split()[0] for k in keys.split(", ")]

    def make() -> Callable[[dict], dict]:
        def run(batch: dict) -> dict:
            pieces = [work(x) for x in batch["list"]]
            return {k: batch[k] for k in names} | {c: [p[c] for p in pieces] for c in [x.split()[0] for x in _PIECE.split(", ")]}

        return run

    return map_columns(rows, make, f"{keys}, {_PIECE}", rows=64)


def _pieces(placed: DataFrame) -> DataFrame:
    """One row per conversation: what is known of all its rows."""
    listed = F.sort_array(F.collect_list(F.struct("row", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n"))).alias("list")
    blocks = placed.groupBy("conv_id", "alone", F.expr(f"(row - 1) div {BLOCK}").alias("seq")).agg(listed)
    keys = "conv_id long, alone boolean, seq long"
    done = write_table(_mapped(blocks, keys, lambda x: _piece_of([tuple(t.values()) for t in x])), "pieces")
    last = done.where("not alone").agg(F.max("seq")).first()[0]
    if last is None:
        return done
    short, rest = done.where("alone"), done.where("not alone")
    columns = [f.name for f in done.schema.fields if f.name not in ("conv_id", "alone")]
    while last > 0:
        last //= FAN
        groups = rest.groupBy("conv_id", "alone", F.expr(f"seq div {FAN}").alias("next")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("list"))
        rest = write_table(_mapped(groups.withColumnRenamed("next", "seq"), keys, _joined), "pieces")
    return short.unionByName(rest)


def _reports(pieces: DataFrame) -> DataFrame:
    def make() -> Callable[[dict], dict]:
        def run(batch: dict) -> dict:
            found = [cheapest([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]) for costs, audits in zip(batch["cost"], batch["audit"], strict=True)]
            gaps = [0 if low is None else high - low + 1 - turns for low, high, turns in zip(batch["low"], batch["high"], batch["turns"], strict=True)]
            return {c: batch[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": [x[0] for x in found], "audit": [x[1] for x in found]}

        return run

    return map_columns(pieces, make, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string", rows=64)


def _edits(reports: DataFrame) -> DataFrame:
    fields = reports.sparkSession.createDataFrame([], "conv_id long, at long, place long, edit string, new_role string").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for conv_id, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, (at, letter, role) in enumerate(edits_of(audit)):
                    held.append((conv_id, at, place, letter, role))
                    if len(held) >= 10_000:
                        yield _batch(held, fields.names)
                        held = []
        if held:
            yield _batch(held, fields.names)

    return reports.select("conv_id", "audit").mapInArrow(run, fields)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reports and the repaired turns of conversations, from rows (conv_id, turn, role, text; copies is optional: how
    often a row is there, 0 for one of which only the conversation counts).

    Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired turns: conv_id, place (0, 1, ...),
    edit (K, R or I), role, text. Rows are taken by turn, null first; rows with one turn by role, then by a digest of the
    whole row, so equal rows are neighbours. A null role or text is one space; a null conv_id is a conversation of its
    own. A role that does not begin with s, u or a cannot be kept, nor an empty one. No rows give no reports. Other
    columns are not read. Audits are as long as their conversations.
    """
    named = _named(rows)
    placed = _placed(named)
    reports = write_table(_reports(_pieces(placed)), "reports")
    edits = write_table(_edits(reports), "edits")
    own = placed.where("n > 0").select(F.col("conv_id").alias("of"), F.col("start").alias("begins"), "id", "role")
    kept = edits.where("edit <> 'I'").join(own, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("begins")))
    texts = named.where("copies > 0").select("id", "text").dropDuplicates(["id"])
    role = F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role"))
    kept = kept.join(texts, "id").select("conv_id", "place", "edit", role.alias("role"), "text")
    added = edits.where("edit = 'I'").select("conv_id", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return reports, kept.unionByName(added)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines role:text of each conversation. A digest takes its bytes in order: a conversation's
    turns pass through one task, batch by batch, whatever its length; none is held as a whole."""
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []
        for batch in batches:
            for conv_id, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if held is None or conv_id != now:
                    if held:
                        out.append((now, held.hexdigest()))
                    now, held = conv_id, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            if out:
                yield _digest_batch(out)
                out = []
        if held:
            yield _digest_batch([(now, held.hexdigest())])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair_damaged(rows: DataFrame) -> DataFrame:
    """The reports of conversations that were damaged by a rule, with the digest of the repaired text: one row for each
    conv_id of rows, also for those of which no turn is left. Nulls, ties and empty tables: see repair and damaged."""
    reports, turns = repair(damaged(rows))
    found = digests(turns).withColumnRenamed("conv_id", "of")
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return reports.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*reports.columns, digest.alias("repaired_sha256"))
