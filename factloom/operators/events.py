"""Raw journal entries as typed columns, and the rules of every generation over them.

An entry's JSON is parsed once, into a VARIANT; its members become typed columns,
null where a member is missing or of another type, and the rules are expressions
over these, so that classes and the first broken rule of each entry come from the
JVM alone.  What depends on earlier entries is left to the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import rules as R
from ..functions.text import canonical_key, utf16_length

NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def kind_of(value: Column) -> Column:
    """Type of a variant, without its parameters; null for a missing one."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def member(value: Column, name: str) -> Column:
    """A member as variant: null if it is missing, a variant null if it is null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text_of(value: Column) -> Column:
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number_of(value: Column) -> Column:
    return F.when(kind_of(value).isin(*NUMBERS), F.try_variant_get(value, "$", "double"))


def truth_of(value: Column) -> Column:
    return F.when(kind_of(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def items_of(value: Column) -> Column:
    return F.when(kind_of(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def fact_of(value: Column) -> Column:
    """A fact's members as a struct."""
    said = lambda name: member(value, name)
    return F.struct(
        text_of(said("id")).alias("id"), text_of(said("type")).alias("type"), text_of(said("text")).alias("text"), number_of(said("createdAt")).alias("created_at"), number_of(said("updatedAt")).alias("updated_at"),
        truth_of(said("hot")).alias("hot"), number_of(said("priority")).alias("priority"), truth_of(said("priorityExplicit")).alias("priority_explicit"), number_of(said("revision")).alias("revision"),
        said("revision").isNotNull().alias("has_revision"),
    )


def tombstones_of(value: Column) -> Column:
    """id, revision and time of every member of a record; an empty list is a record without members."""
    names = F.try_variant_get(value, "$", "map<string,variant>")
    one = lambda e: F.struct(e["key"].alias("id"), number_of(member(e["value"], "revision")).alias("revision"), number_of(member(e["value"], "at")).alias("at"))
    none = F.expr("cast(array() as array<struct<id:string,revision:double,at:double>>)")
    return F.when(kind_of(value) == "OBJECT", F.transform(F.map_entries(names), one)).when(F.size(items_of(value)) == 0, none)


def typed(entries: DataFrame, data: str = "data") -> DataFrame:
    """``entries`` with the members of the JSON in ``data``; text that is no JSON has shape null."""
    rows = entries.withColumn("doc", F.try_parse_json(data))
    said = lambda name: member(F.col("doc"), name)
    rows = rows.withColumns({
        "shape": kind_of(F.col("doc")), "version": number_of(said("version")), "op": text_of(said("op")), "event_id": text_of(said("id")), "at": number_of(said("at")),
        "has_reason": said("reason").isNotNull(), "reason": text_of(said("reason")), "own": F.struct(text_of(said("type")).alias("type"), text_of(said("text")).alias("text"), number_of(said("timestamp")).alias("timestamp")),
    })
    return rows.withColumns({
        "body": fact_of(F.when(F.col("op") == "add", said("fact")).when(F.col("op") == "supersede", said("replacement"))),
        "facts": F.when(F.col("op") == "snapshot", F.transform(items_of(said("facts")), fact_of)),
        "revoked": F.when(F.col("op") == "snapshot", tombstones_of(said("revoked"))),
        "revoked_ids": F.when(F.col("op") == "snapshot", F.transform(items_of(said("revokedIds")), text_of)),
    }).drop("doc")


Rules = list[tuple[str, Column]]


def first_broken(*parts: Rules | Column) -> Column:
    """Name of the first rule that does not hold, null if all do; a part may be such a name found before."""
    found = []
    for part in parts:
        found += [part] if isinstance(part, Column) else [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in part]
    return F.coalesce(*found, F.lit(None).cast("string"))


def all_hold(rules: Rules) -> Column:
    out = F.lit(True)
    for _, holds in rules:
        out = out & F.coalesce(holds, F.lit(False))
    return out


def whole(x: Column) -> Column:
    return F.floor(x) == x


def timed(f: Column) -> Rules:
    return [("time", R.valid_time(f["created_at"]) & R.valid_time(f["updated_at"])), ("order", f["updated_at"] >= f["created_at"])]


def ranked(f: Column) -> Rules:
    return [("hot", f["hot"].isNotNull()), ("priority", whole(f["priority"]) & f["priority"].between(0, 100)), ("explicit", f["priority_explicit"].isNotNull())]


def strict(f: Column) -> Rules:
    """A fact as version 3 has it."""
    return [("fact-id", R.valid_id(f["id"])), ("type", f["type"].isin(*C.FACT_TYPES)), ("text", R.valid_text(f["text"])), *timed(f), *ranked(f), ("revision", whole(f["revision"]) & (f["revision"] >= 1))]


def long_text(text: Column) -> Column:
    return (text != "") & (utf16_length(text) <= C.MAX_LEGACY_CHARS)


def first_of_two(f: Column) -> Rules:
    """A fact of the first form of version 2: longer texts as they were typed, and no revision."""
    return [("fact-id", R.valid_id(f["id"])), ("type", f["type"].isin(*C.FACT_TYPES)), ("text", long_text(f["text"])), *timed(f), *ranked(f), ("revision", ~f["has_revision"])]


def first_version(f: Column) -> Rules:
    return [("fact-id", R.valid_id(f["id"])), ("type", f["type"].isin(*C.FACT_TYPES, C.LEGACY_TYPE[0])), ("text", long_text(f["text"])), *timed(f)]


def said_reason() -> Rules:
    return [("reason", ~F.col("has_reason") | (F.col("reason").isNotNull() & R.valid_reason(F.col("reason"))))]


def snapshot_rules() -> Rules:
    facts, revoked, at = F.col("facts"), F.col("revoked"), F.col("at")
    ids = F.transform(facts, lambda f: f["id"])
    key = lambda f: canonical_key(f["type"], f["text"])
    dead = F.transform(revoked, lambda t: t["id"])
    sound = lambda t: F.coalesce(R.valid_id(t["id"]) & whole(t["revision"]) & (t["revision"] >= 1) & R.valid_time(t["at"]), F.lit(False))
    return [
        ("at", R.valid_time(at)), ("facts", F.col("facts_sound")), ("too-many", F.size(facts) <= C.MAX_FACTS),
        ("too-long", F.aggregate(facts, F.lit(0), lambda n, f: n + utf16_length(f["text"])) <= C.MAX_TOTAL_CHARS), ("revoked", revoked.isNotNull()),
        ("fact-ids", F.size(F.array_distinct(ids)) == F.size(ids)), ("later", F.forall(facts, lambda f: f["updated_at"] <= at)), ("duplicates", F.size(F.array_distinct(F.transform(facts, key))) == F.size(facts)),
        ("tombstones", F.forall(revoked, sound)), ("both", ~F.arrays_overlap(ids, dead)), ("tombstone-later", F.forall(revoked, lambda t: t["at"] <= at)),
    ]


def classified(rows: DataFrame) -> DataFrame:
    """``typed`` rows with ``kind``, the generation that takes the entry (v3, v2b, v2a, v1, future, invalid), and ``broken``, the rule an invalid one breaks first."""
    body, version, op, at = F.col("body"), F.col("version"), F.col("op"), F.col("at")
    changes = op.isin("add", "supersede")
    rows = rows.withColumns({
        "facts_sound": F.when(op == "snapshot", F.col("facts").isNotNull() & F.forall("facts", lambda f: all_hold(strict(f)))),
        "not_strict": F.when(changes & (version >= 2), first_broken(strict(body))), "not_two": F.when(changes & (version == 2), first_broken(first_of_two(body))), "not_one": F.when(changes & (version == 1), first_broken(first_version(body))),
        "no_id": first_broken([("id", R.valid_id(F.col("event_id")))]), "no_time": first_broken([("at", R.valid_time(at))]), "no_reason": first_broken(said_reason()),
    })
    same, not_later = [("replacement-id", body["id"] == F.col("event_id"))], [("later", body["updated_at"] <= at)]
    revoking = first_broken(F.col("no_id"), F.col("no_time"), F.col("no_reason"))
    superseding = lambda fact, *more: first_broken(F.col("no_id"), F.col(fact), same, F.col("no_time"), *more, F.col("no_reason"))
    by_op = lambda add, supersede: F.when(op == "add", add).when(op == "supersede", supersede).when(op == "revoke", revoking)
    change = by_op(first_broken(F.col("not_strict"), [("first-revision", body["revision"] == 1)]), superseding("not_strict", not_later))
    older = [("facts", F.col("facts_sound")), ("revoked", F.col("revoked_ids").isNotNull() & F.forall("revoked_ids", lambda i: R.valid_id(i)))]
    rows = rows.withColumns({
        "broken_3": F.when(version == 3, change.when(op == "snapshot", first_broken(snapshot_rules())).otherwise("op")),
        "broken_2b": F.when(version == 2, change.when(op == "snapshot", first_broken(F.col("no_time"), older)).otherwise("op")),
        "broken_2a": F.when(version == 2, by_op(F.col("not_two"), superseding("not_two", not_later)).otherwise("op")),
        "broken_1": F.when(version == 1, by_op(F.col("not_one"), superseding("not_one")).otherwise("op")),
    })
    record = F.coalesce(F.col("shape").isin("OBJECT", "ARRAY"), F.lit(False))
    holds = lambda v, name: (version == v) & F.col(name).isNull()
    kind = F.when(~record, "invalid").when(version > C.SCHEMA_VERSION, "future").when(holds(3, "broken_3"), "v3").when(holds(2, "broken_2b"), "v2b").when(holds(2, "broken_2a"), "v2a").when(holds(1, "broken_1"), "v1").otherwise("invalid")
    second = F.when(body["has_revision"] | (F.col("op") == "snapshot"), F.col("broken_2b")).otherwise(F.col("broken_2a"))
    why = F.when(~record, "no-object").when(version == 3, F.col("broken_3")).when(version == 2, second).when(version == 1, F.col("broken_1")).otherwise("version")
    out = rows.withColumn("kind", kind).withColumn("broken", F.when(F.col("kind") == "invalid", why))
    return out.drop("broken_3", "broken_2b", "broken_2a", "broken_1", "facts_sound", "not_strict", "not_two", "not_one", "no_id", "no_time", "no_reason")


def valid_standalone() -> Column:
    """A single fact of the first releases."""
    own = F.col("own")
    return F.coalesce(own["type"].isin(*C.FACT_TYPES, C.LEGACY_TYPE[0]) & long_text(own["text"]) & R.valid_time(own["timestamp"]), F.lit(False))


def class_of(rows: DataFrame, data: str) -> DataFrame:
    """``rows`` with ``kind`` and ``broken`` of the events in column ``data``."""
    out = classified(typed(rows, data))
    return out.select(*rows.columns, "kind", "broken")
