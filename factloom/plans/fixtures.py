"""Facts, journal, messages, lineage and scores derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    # labels tell the hot facts among every tenth document; the texts of the others are not shuffled for them
    tenth = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    good = table(spark, sf_dir, "labels").where(tenth & (F.col("quality") == 1)).select("doc_id", F.lit(True).alias("good")).distinct()
    rows = docs.where(~tenth).withColumn("good", F.lit(False)).unionByName(docs.where(tenth).join(good, "doc_id", "left"))
    return rows.select(
        F.concat(F.lit("b_"), "source").alias("branch_id"),
        F.concat(F.lit("cf_doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.element_at(F.array(*map(F.lit, C.FACT_TYPES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("type"),
        F.regexp_replace("text", r"\A[ \n\t]+|[ \n\t]+\z", "").alias("text"),
        (F.col("doc_id") + 1_800_000_000_000).alias("created_at"),
        (F.col("doc_id") + F.col("n_chars") + 1_800_000_000_000).alias("updated_at"),
        F.coalesce("good", F.lit(False)).alias("hot"),
        (F.col("doc_id") * 37 % 101).cast("int").alias("priority"),
        F.lit(True).alias("priority_explicit"),
        F.lit(1).alias("revision"),
    )


def journal(events: DataFrame) -> DataFrame:
    """The ordered events of each user's branch; works on batches and streams."""
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type").isin("signup", "click"), "add").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "revoke").otherwise("supersede")
    return events.select(
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("branch_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.concat(F.lit("cf_k"), (k % 24).cast("string")).alias("id"),
        F.concat(F.lit("v"), ((k * 7 + F.col("event_id")) % 40).cast("string")).alias("text"),
        F.when(op == "add", 1).otherwise(1 + F.col("event_id") % 3).cast("int").alias("revision"),
        at.alias("at"),
        (at - (F.col("event_id") % 7) * 3_600_000).alias("updated_at"),
    )


def snapshot_journal(events: DataFrame) -> DataFrame:
    """The journal with one event in 31 a snapshot, half of them invalid: a fact newer than its snapshot."""
    rows = journal(events)
    snap = F.col("seq") % 31 == 7
    fact = lambda id_, text, revision, later: F.struct(F.lit(id_).alias("id"), F.lit("finding").alias("type"), text.alias("text"), F.col("at").alias("created_at"), (F.col("at") + later).alias("updated_at"), F.lit(False).alias("hot"), F.lit(50).alias("priority"), F.lit(False).alias("priority_explicit"), F.lit(revision).alias("revision"))
    facts = F.array(fact("cf_k1", F.concat(F.lit("s"), F.col("seq").cast("string")), 2, F.lit(0)), fact("cf_k2", F.lit("v5"), 1, F.col("seq") % 2))
    revoked = F.create_map(F.lit("cf_k3"), F.struct(F.lit(4).alias("revision"), F.col("at").alias("at")))
    text = F.to_json(F.struct(facts.alias("facts"), revoked.alias("revoked")))
    blank = lambda c, value: F.when(snap, F.lit(value)).otherwise(F.col(c)).alias(c)
    return rows.select("branch_id", "seq", blank("op", "snapshot"), blank("id", ""), blank("text", None), blank("revision", None), "at", blank("updated_at", None), F.when(snap, text).alias("snapshot"))


def _object(**parts) -> F.Column:
    """JSON object of members given as JSON; null ones are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v.cast("string")) for k, v in parts.items())), F.lit("}"))


def _quoted(text) -> F.Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def generations(events: DataFrame) -> DataFrame:
    """A raw journal of every generation: sound events, events that break one rule, snapshots of two generations, standalone facts, later schemas, and entries that are no events."""
    n = F.col("seq")
    rows = journal(events).select("branch_id", "seq", "op", "id", "text", "at", "updated_at")
    form = F.when(n % 31 == 7, "v3").when(n % 31 == 20, "v2b").when(n % 10 < 4, "v3").when(n % 10 < 6, "v2b").when(n % 10 < 8, "v2a").when(n % 10 == 8, "v1").when(n % 30 == 9, "future").when(n % 30 == 19, "standalone").otherwise("odd")
    bad = F.when(n % 23 == 11, F.floor(n / 23) % 8)
    rows = rows.withColumns({"form": form, "bad": bad, "op": F.when(n % 31 == 7, "snapshot").when(n % 31 == 20, "snapshot").otherwise(F.col("op"))})
    is_, bad, at = lambda x: F.coalesce(F.col("bad") == x, F.lit(False)), F.col("bad"), F.col("at")
    first, old = F.col("form") == "v1", F.col("form").isin("v2a", "v1")
    type_ = F.when(is_(1), "rumour").when(first, F.when(n % 3 == 0, C.LEGACY_TYPE[0]).otherwise("finding")).when(n % 2 == 0, "finding").otherwise("decision")
    text = F.when(is_(2), "").when(old & (n % 37 == 5), "   ").when(old & (n % 4 == 0), F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.col("text"))
    updated = F.when(first & (n % 41 == 8), at + 5).otherwise(F.col("updated_at"))
    body = _object(
        id=_quoted(F.when(is_(0), "bad id").otherwise(F.col("id"))), type=_quoted(type_), text=_quoted(text), createdAt=F.when(is_(6), F.lit("null")).when(is_(3), (updated + 1).cast("string")).otherwise((updated - 1000).cast("string")), updatedAt=updated,
        hot=F.when(~first, F.when(is_(5), '"yes"').when(n % 3 == 0, "true").otherwise("false")), priority=F.when(~first, F.when(is_(4), 101).otherwise(n % 101)), priorityExplicit=F.when(~first, F.when(n % 5 == 0, "true").otherwise("false")),
        revision=F.when(~old, F.when(F.col("op") == "add", 1).otherwise(1 + n % 3)),
    )
    version = F.when(F.col("form") == "v3", 3).when(first, 1).when(F.col("form") == "future", 4).otherwise(2)
    revoke = F.col("op") == "revoke"
    reason = F.when(revoke & (bad % 2 == 1), F.lit("null")).when((F.col("op") == "supersede") & is_(7), _quoted(F.repeat(F.lit("x"), 501))).when(n % 2 == 0, F.lit('"why"'))
    event = _object(version=version, op=_quoted(F.col("op")), id=F.when(F.col("op") != "add", _quoted(F.col("id"))), fact=F.when(F.col("op") == "add", body), replacement=F.when(F.col("op") == "supersede", body), at=F.when(F.col("op") != "add", F.when(revoke & (bad % 2 == 0), 0).otherwise(at)), reason=reason)
    fact = lambda id_, said, revision, later: _object(id=_quoted(F.lit(id_)), type=F.lit('"finding"'), text=_quoted(said), createdAt=at, updatedAt=at + later, hot=F.lit("false"), priority=F.lit("50"), priorityExplicit=F.lit("false"), revision=F.lit(str(revision)))
    listed = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    own = F.concat(F.lit("s"), n.cast("string"))
    newest = _object(version=F.lit("3"), op=F.lit('"snapshot"'), facts=listed(fact("cf_k1", own, 2, F.lit(0)), fact("cf_k2", F.lit("v5"), 1, n % 2)), revoked=F.concat(F.lit('{"cf_k3":{"revision":4,"at":'), at.cast("string"), F.lit("}}")), at=at)
    older = _object(version=F.lit("2"), op=F.lit('"snapshot"'), facts=listed(fact("cf_k1", own, 1, F.lit(0)), fact("cf_k2", F.lit("v6"), 3, n % 2), fact("cf_k2", F.lit("v7"), 3, F.lit(0))), revokedIds=F.lit('["cf_k3","cf_k1","cf_k3"]'), at=at)
    k = F.floor(n / 30)
    alone = _object(type=_quoted(F.when(k % 2 == 0, C.LEGACY_TYPE[0]).otherwise("milestone")), text=_quoted(F.when(k % 9 == 3, "  ").otherwise(F.concat(F.lit("alone "), (n % 7).cast("string")))), timestamp=F.when(k % 5 == 4, F.lit("null")).otherwise(at.cast("string")))
    odd = F.element_at(F.array(F.lit("not json"), F.lit("[]"), F.lit('{"version":0}'), F.lit('"text"')), (k % 4 + 1).cast("int"))
    data = F.when(F.col("op") == "snapshot", F.when(F.col("form") == "v3", newest).otherwise(older)).when(F.col("form") == "standalone", alone).when(F.col("form") == "odd", odd).otherwise(event)
    kind = F.when((F.col("form") == "standalone"), "fact").otherwise("fact-event")
    return rows.select("branch_id", "seq", kind.alias("entry_type"), data.alias("data"))


def commands(events: DataFrame) -> DataFrame:
    """Write commands of each user: adds, and revisions and revocations of what one to three events before made."""
    n = F.col("event_id")
    branch, k = F.concat(F.lit("u_"), F.col("user_id").cast("string")), F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("user_id").orderBy("event_id")
    before = F.when(n % 3 == 0, F.lag(n, 1).over(order)).when(n % 3 == 1, F.lag(n, 2).over(order)).otherwise(F.lag(n, 3).over(order))
    name = F.when(n % 29 == 0, "merge").when(n % 5 == 0, "revise").when(n % 10 == 1, "forget").otherwise("add")
    made = F.concat(F.lit("cf_"), F.left(F.sha2(F.concat(branch, F.lit("#"), before.cast("string")), 256), F.lit(32)))
    type_ = F.when(n % 11 == 0, "rumour").otherwise(F.element_at(F.array(*map(F.lit, C.FACT_TYPES)), (n % 4 + 1).cast("int")))
    text = F.when(n % 37 == 0, F.repeat(F.lit("y"), 2001)).otherwise(F.concat(F.lit("v"), ((k * 7 + n) % 40).cast("string"), F.lit(" "), F.repeat(F.lit("x"), 600)))
    return events.select(
        branch.alias("branch_id"), n.alias("seq"), name.alias("command"),
        F.when(name == "add", None).when(n % 17 == 0, "bad id").otherwise(made).alias("id"),
        F.when((name != "revise") | (n % 2 == 0), type_).alias("type"),
        F.when((n % 13 != 0) & ((name != "revise") | (n % 10 != 5)), text).alias("text"),
        F.when(n % 3 == 0, n % 101).cast("int").alias("priority"), F.when(n % 4 < 2, n % 4 == 1).alias("hot"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("turn") % 5 != 4, F.concat(F.lit("m"), (F.col("turn") % 3).cast("string"))).alias("id"),
        "role",
        F.col("text").alias("content"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary forest of sessions, and two that name each other as parent."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    name = lambda c: F.concat(F.lit("s_"), c.cast("string"))
    tree = rows.select(name(F.col("conv_id")).alias("id"), F.when(F.col("conv_id") > 0, name(F.floor(F.col("conv_id") / 2))).alias("parent"), F.col("conv_id").alias("modified"), "n_messages", F.concat(F.lit("/w"), (F.col("conv_id") % 3).cast("string")).alias("cwd"))
    cycle = spark.range(2).select(F.when(F.col("id") == 0, "x").otherwise("y").alias("id"), F.when(F.col("id") == 0, "y").otherwise("x").alias("parent"), F.lit(-1).cast("long").alias("modified"), F.lit(0).cast("long").alias("n_messages"), F.lit("/w0").alias("cwd"))
    return tree.unionByName(cycle)


#: Multipliers of the generated scores, one a metric.
PRIMES = (7919, 6101, 4969, 3571, 2741, 1597, 1009, 557)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight metric scores of each conversation, in long form."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(p).alias("prime")) for m, p in zip(C.METRICS, PRIMES))))
    return ids.select("conv_id", pairs.alias("m")).select("conv_id", F.col("m.metric").alias("metric"), ((F.col("conv_id") * F.col("m.prime")) % 10001 / 100.0).alias("score"))
