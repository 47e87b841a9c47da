"""Identity of candidates: a canonical text of nested columns, and keys of what makes candidates the same.

The text of a value says its kind and its length, so no two different values share one. Structs and maps are written by
the names of their fields, lists in their order, lists that are sets sorted and without repeats; a null is one sign, and
a field that is null counts as absent. The expressions follow the table's schema: Spark evaluates them row by row inside
its own code, whatever nests in what.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import join_spread, unused, written

#: Fields whose lists are sets.
SETS = frozenset("actions authorization_matrix binder_return_types duplicate_authorities entry_points operation_modes path_regions permission_set permissions requested_permissions rule_ids unresolved_action_expressions".split())
#: Fields of runs, at any depth; and at the top fields that analyses and reviews write, by name, beginning or end.
RUNTIME = frozenset("elapsed_ms last_error runtime_error timestamp transient_error transient_errors".split())
RUNTIME_ENDS, RUNTIME_BEGINNING = ("_at", "_timestamp", "_timestamp_ms"), "timestamp"
MUTABLE = frozenset(
    "analysis_incomplete analysis_status analysis_track candidate_id candidate_verdict chain_key deterministic_fact_hash evidence_decision evidence_variants "
    "false_positive_basis funnel_disposition is_ai_representative member_candidate_ids representative_candidate_id review_state scope_key confidence_tier "
    "context_requests duration_ms error errors final_analysis promotion_requested protocol_version review_status risk_score runtime severity severity_hint "
    "severity_reason severity_version slice_id slice_refs related_candidate_ids explorer_candidate_id".split()
)
MUTABLE_BEGINNINGS = ("ai_", "slice_", "transient_", "severity_")
MUTABLE_ENDS = ("_slice_id", "_slice_ids", "_analysis_status", "_review_status", "_severity")
#: Fields that are no facts of a candidate: results, texts for people, what the other two keys hold, traces.
NO_FACTS = MUTABLE | frozenset(
    "rule_id rule_ids rule_version title description review_priority locations limitations ai_required chain_id entry_method_id path_model flow_kind demotion_reason "
    "flow_evidence_tier receiver_semantics sources sinks propagation_paths method_summaries reaching_definitions validation_transitions slot_overwrites "
    "router_validation_bypass summary_fixpoint fragment_reflection started_service_state_machine receiver_binding".split()
) - frozenset("duration_ms error errors final_analysis protocol_version runtime severity severity_version".split())
#: What else is no fact of a candidate that stands for the whole Binder surface of a service.
NO_BINDER_FACTS = frozenset(
    "entry_points impact_status deterministic_chain_verified dataflow_status operation_taxonomy binder_transaction binder_transactions binder_return_types "
    "binder_inheritance_chain binder_remote_interface implementation_method_id implementation_class entry_descriptor guard_coverage guard_summary".split()
)
KEYS = ("scope_key", "chain_key", "fact_key")
#: What the keys of scope and chain read beside facts and the ends, steps and bindings of a chain.
READ = frozenset("component component_kind component_name entry_points entry_method_id flow_kind path_model binder_remote_interface authorization_operation authorization_matrix receiver_flag_tier operation_taxonomy taxonomy".split())
ENDS = ("path", "line", "method_id", "kind", "taxonomy", "operation_taxonomy")
#: Different contents up to which their keys are made once and broadcast; with more, every row makes its own.
CONTENTS = 100_000
#: Columns of the funnel itself.
HELPERS = (*KEYS, "needs", "risk")


def of_a_run(name: str) -> bool:
    return name in RUNTIME or name.endswith(RUNTIME_ENDS) or name.startswith(RUNTIME_BEGINNING)


def written_by_analyses(name: str) -> bool:
    return name in MUTABLE or name.startswith(MUTABLE_BEGINNINGS) or name.endswith(MUTABLE_ENDS)


def _named(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"{len(name)}:{name}="), text)


def canonical(value: Column, kind: T.DataType, name: str = "", drop: Callable[[str], bool] = lambda _: False) -> Column:
    """The canonical text of a column of any type. name: of the field that it is in; drop: whether a field of a struct, or
    a key of a map, is left out at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if not drop(f.name)), key=lambda f: f.name)
        parts = [F.when(value.getField(f.name).isNotNull(), _named(f.name, canonical(value.getField(f.name), f.dataType, f.name, drop))) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws("", *parts) if parts else F.lit(""), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: canonical(x, kind.elementType, name, drop))
        items = F.array_sort(F.array_distinct(items)) if name in SETS else items
        text = F.concat(F.lit("["), F.array_join(items, ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        kept = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull() & ~_drops(e["key"], drop))
        items = F.transform(kept, lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), canonical(e["value"], kind.valueType, "", drop)))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(items), ""), F.lit("}"))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        text = F.concat(F.lit("s"), F.length(value).cast("string"), F.lit(":"), value.cast("string"))
    else:
        tag = "i" if isinstance(kind, T.IntegralType) else kind.typeName()
        text = F.concat(F.lit(tag), value.cast("string"), F.lit(";"))
    return F.coalesce(text, F.lit("~"))


def _drops(key: Column, drop: Callable[[str], bool]) -> Column:
    """drop for the keys of a map, which only the rows know."""
    if drop is not of_a_run:
        return F.lit(False)
    ends = [key.endswith(e) for e in RUNTIME_ENDS]
    out = key.isin(*RUNTIME) | key.startswith(RUNTIME_BEGINNING)
    for e in ends:
        out |= e
    return out


def digest(value: Column, kind: T.DataType, name: str = "") -> Column:
    return F.sha2(canonical(value, kind, name), 256)


def exact_key(rows: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A digest of all columns but those of runs, at any depth, and those that analyses and reviews write. leave_out: more
    columns that are no part of a candidate, such as the number of its row."""
    fields = [f for f in rows.schema.fields if f.name not in leave_out and not of_a_run(f.name) and not written_by_analyses(f.name)]
    parts = [F.when(F.col(f"`{f.name}`").isNotNull(), _named(f.name, canonical(F.col(f"`{f.name}`"), f.dataType, f.name, of_a_run))) for f in sorted(fields, key=lambda f: f.name)]
    return F.sha2(F.concat_ws("", F.lit("candidate"), *parts), 256)


def exact_groups(rows: DataFrame, order: str) -> DataFrame:
    """rows with exact_key, first (the least value of order among the rows of one key) and n_same. Groups are counted
    before they meet their rows; see join_spread for large ones."""
    keyed = written(rows.withColumn("exact_key", exact_key(rows, (order,))))
    return join_spread(keyed, keyed.groupBy("exact_key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_same")), "exact_key")


class _Fields:
    """The columns of a table by name, with nulls for those that it lacks, and the texts of them."""

    def __init__(self, rows: DataFrame, leave_out: tuple[str, ...] = ()):
        self.kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in leave_out}

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.kinds else F.lit(None).cast("string")

    def text(self, name: str) -> Column:
        return canonical(self[name], self.kinds.get(name, T.StringType()), name)

    def within(self, name: str) -> set[str]:
        """The fields of a list of structs, or of a struct."""
        kind = self.kinds.get(name)
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return set(kind.names) if isinstance(kind, T.StructType) else set()

    def items(self, name: str, shape: Callable[[Column, set[str]], Column]) -> Column:
        """The texts of a list's elements in order; a list that is null or missing is empty."""
        if not isinstance(self.kinds.get(name), T.ArrayType):
            return F.array().cast("array<string>")
        return F.coalesce(F.transform(self[name], lambda x: shape(x, self.within(name))), F.array().cast("array<string>"))


def _some(value: Column) -> Column:
    """A text, or null for an empty one."""
    return F.when(value.cast("string") != "", value)


def _string(value: Column) -> Column:
    return canonical(value.cast("string"), T.StringType())


def _listed(*texts: Column) -> Column:
    return F.concat(F.lit("["), *texts, F.lit("]"))


def _whole(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ""), F.lit("]"))


def semantic_keys(rows: DataFrame, leave_out: tuple[str, ...] = ()) -> tuple[Column, Column, Column]:
    """Keys of where a candidate can be entered, of the chain from source to sink, and of its facts.

    The chain is the kinds and places of its ends and the order of its methods, without lines and texts of the calls
    between. Of gaps only code and weight count, of guards only the status. Receivers registered in code are one for
    each owner (the first three parts of the registering path), flag and actions; Binder transactions of one service are
    one. Columns that the table lacks count as null, columns that it has beyond the known ones are facts, but for those
    of leave_out, such as the number of a row.
    """
    f = _Fields(rows, HELPERS + leave_out)
    receiver = F.coalesce(f["flow_kind"] == "receiver_exposure", F.lit(False))
    binder = F.coalesce(f["binder_remote_interface"].cast("boolean"), F.lit(False))
    binding = f.within("receiver_binding")
    registered = f["receiver_binding"].getField("registration").getField("path") if "registration" in binding else F.lit(None).cast("string")
    path = F.regexp_replace(F.coalesce(_some(registered), f["component_name"], F.lit("")), "^dynamic:", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.coalesce(_some(path), F.lit("owner_unknown")))
    unlined = lambda c: F.substring_index(c, ":", 1)
    name = F.when(receiver, owner).otherwise(f["component_name"])
    method = F.when(binder, F.coalesce(f["component_name"], F.lit(""))).when(receiver, F.coalesce(unlined(f["entry_method_id"]), F.lit(""))).otherwise(f["entry_method_id"])
    regions = f.kinds.get("authorization_matrix")
    if isinstance(regions, T.ArrayType) and "path_region" in f.within("authorization_matrix"):
        kind = regions.elementType["path_region"].dataType
        region_texts = f.items("authorization_matrix", lambda x, _: canonical(x.getField("path_region"), kind))
    else:
        region_texts = F.array().cast("array<string>")
    entries = F.when(binder, _listed(_string(F.coalesce(f["component_name"], F.lit(""))))).otherwise(f.text("entry_points"))
    scope = F.concat(
        _string(F.coalesce(_some(f["component"]), f["component_kind"])), _string(name), entries, _string(method),
        _string(F.coalesce(_some(f["authorization_operation"]), F.lit("component_entry"))), _whole(F.array_sort(F.array_distinct(region_texts))),
    )

    def of(x: Column, has: set[str], *fields: str) -> Column:
        return _string(F.coalesce(*[_some(x.getField(c)) if len(fields) > 1 else x.getField(c) for c in fields if c in has], F.lit(None).cast("string")))

    end = lambda x, has: F.concat(*[of(x, has, c) for c in ("path", "line", "method_id", "kind")], of(x, has, "taxonomy", "operation_taxonomy"))
    sources = F.when(binder, F.lit("binder_transaction")).when(receiver, _whole(f.items("sources", lambda x, has: F.concat(of(x, has, "path"), of(x, has, "kind"))))).otherwise(_whole(f.items("sources", end)))
    sinks = F.when(binder, F.lit("binder_impl_effect")).otherwise(_whole(f.items("sinks", end)))
    taxonomy = F.when(binder, F.lit("binder_surface")).otherwise(F.concat(f.text("operation_taxonomy"), f.text("taxonomy"), _whole(f.items("sinks", lambda x, has: F.concat(of(x, has, "taxonomy", "operation_taxonomy"), of(x, has, "kind"))))))
    steps = f.kinds.get("propagation_paths")
    shape = F.when(binder, F.lit("[]")).otherwise(_whole(f.items("propagation_paths", lambda x, has: _step(x, has, steps))))
    actions = f["receiver_binding"].getField("actions") if "actions" in binding else F.array().cast("array<string>")
    exposure = F.when(receiver, F.concat(_string(F.coalesce(_some(f["receiver_flag_tier"]), F.lit("tier_unknown"))), _string(owner), F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(actions, F.array().cast("array<string>")), _string))), ""))).otherwise(F.lit(""))
    chain = F.concat(_string(method), _string(f["path_model"]), _string(F.when(binder, "binder_dispatch").otherwise(f["flow_kind"])), sources, sinks, taxonomy, shape, exposure)
    return F.sha2(scope, 256), F.sha2(chain, 256), F.sha2(_facts(f, receiver, binder, owner), 256)


def _step(x: Column, has: set[str], steps: T.DataType | None) -> Column:
    """A step of a path: its method, else its file, else all of it."""
    named = [F.when(_some(x.getField(c)).isNotNull(), F.concat(F.lit("m"), _string(x.getField(c)))) for c in ("method_id", "path") if c in has]
    return F.coalesce(*named, canonical(x, steps.elementType)) if named else canonical(x, steps.elementType)


def _facts(f: _Fields, receiver: Column, binder: Column, owner: Column) -> Column:
    parts = []
    for name in sorted(f.kinds):
        if name in NO_FACTS or name.startswith("ai_"):
            continue
        text = f.text(name)
        if name in ("blocking_gaps", "coverage_gaps") and "code" in f.within(name):
            weight = lambda x, has: F.coalesce(x.getField("critical"), F.lit(False)) if "critical" in has else F.lit(False)
            codes = f.items(name, lambda x, has: F.concat(_string(F.coalesce(x.getField("code"), F.lit("None"))), weight(x, has).cast("string")))
            text = _whole(F.array_sort(F.array_distinct(codes)))
        elif name in ("guard_coverage", "guard_summary") and isinstance(f.kinds[name], T.StructType):
            text = _string(f[name].getField("status")) if "status" in f.within(name) else F.lit("~")
        elif name == "component_name":
            text = F.when(receiver, _string(owner)).otherwise(text)
        elif name == "entry_points" and f.kinds[name] == T.ArrayType(T.StringType()):
            text = F.when(receiver, _whole(F.array_sort(F.array_distinct(f.items(name, lambda x, _: _string(F.substring_index(x, ":", 1))))))).otherwise(text)
        elif name == "entry_method_name":
            text = F.when(receiver, F.lit("registerReceiver")).otherwise(text)
        there = F.col(f"`{name}`").isNotNull()
        parts.append(F.when(there & ~binder if name in NO_BINDER_FACTS else there, _named(name, text)))
    no_chain = F.when(_some(f["chain_id"]).isNull(), F.concat(F.lit("rule="), _string(f["rule_id"]), _string(f["rule_version"])))
    return F.concat_ws("", F.lit("facts"), *parts, no_chain)


def _exact_in_json(kind: T.DataType) -> bool:
    """Whether different values of a type have different JSON."""
    if isinstance(kind, T.StructType):
        return all(_exact_in_json(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _exact_in_json(kind.elementType)
    if isinstance(kind, T.MapType):
        return kind.keyType == T.StringType() and _exact_in_json(kind.valueType)
    return kind == T.StringType() or isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType, T.DoubleType))


def content(rows: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A digest of all that semantic_keys reads of a row, cheaper than the keys: rows of one content have the same keys."""
    f = _Fields(rows, HELPERS + leave_out)
    no_chain = _some(f["chain_id"]).isNull()
    parts = [no_chain, F.when(no_chain, f["rule_id"].cast("string")), F.when(no_chain, f["rule_version"].cast("string"))]
    for name, kind in sorted(f.kinds.items()):
        value, has, listed = f[name], f.within(name), isinstance(kind, T.ArrayType)
        inside = lambda *fields, v=value, h=has: [v.getField(c) for c in fields if c in h]
        if name in ("sources", "sinks", "propagation_paths", "receiver_binding") or name in READ or not (name in NO_FACTS or name.startswith("ai_")):
            if not _exact_in_json(kind):
                parts.append(f.text(name))
            elif name in ("sources", "sinks"):
                parts += [F.size(value), *inside(*ENDS)] if listed else []
            elif name == "propagation_paths" and listed and has & {"method_id", "path"}:
                named = lambda x, h=has: F.coalesce(*[_some(x.getField(c)) for c in ("method_id", "path") if c in h]).isNotNull()
                parts += [*inside("method_id", "path"), F.filter(value, lambda x: ~named(x))]
            elif name == "receiver_binding":
                parts += [value.getField("registration").getField("path")] if "registration" in has else []
                parts += inside("actions")
            elif name in ("blocking_gaps", "coverage_gaps") and listed and "code" in has:
                parts += [value.isNotNull(), *inside("code", "critical")]
            elif name in ("guard_coverage", "guard_summary") and isinstance(kind, T.StructType):
                parts += [value.isNotNull(), *inside("status")]
            else:
                parts.append(value)
    # never null, and known to be: else joins by it would ask for that and make it twice
    return F.coalesce(F.unhex(F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)), F.lit(b""))


def keys_once(rows: DataFrame, row_id: str, of: DataFrame, same: str, names: tuple[str, str, str], leave_out: tuple[str, ...]) -> DataFrame | None:
    """One row for each content (column same of the table of, beside row_id): same and the keys under names, made from one
    row of it. None if there are more than CONTENTS."""
    firsts = written(of.groupBy(same).agg(F.min(row_id).alias(row_id)))
    if firsts.limit(CONTENTS + 1).count() > CONTENTS:
        return None
    few = rows.where(F.col(row_id).isin(firsts.select(row_id))).withColumn(same, content(rows, leave_out))
    made = few.join(F.broadcast(firsts), [row_id, same]).select(same, *[c.alias(n) for n, c in zip(names, semantic_keys(rows, leave_out), strict=True)])
    return written(made.dropDuplicates([same]))


def keyed_once(rows: DataFrame, row_id: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """rows with KEYS, made once for each content where there are few. row_id is not null."""
    rows = rows.drop(*[k for k in KEYS if k in rows.columns])
    (same,) = unused(rows.columns + list(KEYS), "content")
    digests = rows.withColumn(same, content(rows, leave_out))
    keys = keys_once(rows, row_id, digests.select(row_id, same), same, KEYS, leave_out)
    return rows.withColumns(dict(zip(KEYS, semantic_keys(rows, leave_out), strict=True))) if keys is None else digests.join(F.broadcast(keys), same).drop(same)


def identified(rows: DataFrame, leave_out: tuple[str, ...] = (), row_id: str | None = None) -> DataFrame:
    """rows with scope_key, chain_key, fact_key and candidate_id: the own one, else one made of the keys, the chain's id,
    the rule and the locations in any order. Columns of these names are replaced. With row_id, the number of a row, the
    keys of rows of one content are made once."""
    keyed = keyed_once(rows, row_id, leave_out) if row_id else rows.withColumns(dict(zip(KEYS, semantic_keys(rows, leave_out), strict=True)))
    f = _Fields(rows)
    places = f.kinds.get("locations")
    sorted_places = _whole(F.array_sort(f.items("locations", lambda x, _: canonical(x, places.elementType))))
    made = F.concat(F.lit("candidate_"), F.substring(F.sha2(F.concat(*KEYS, _string(f["chain_id"]), _string(f["rule_id"]), sorted_places), 256), 1, 20))
    return keyed.withColumn("candidate_id", F.coalesce(_some(f["candidate_id"]), made))
