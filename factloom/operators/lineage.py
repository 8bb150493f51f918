"""Session lineage: roots of parent pointers, resolution of names, previous sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .ordering import numbered

#: Most lengths of targets that are looked up at once.
MAX_LENGTHS = 200


def roots(sessions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """id, root, depth of every session by pointer doubling.

    After k rounds each session points 2**k parents up, so depth d takes log d
    joins.  A session on or below a cycle of parents has no root.  The pointer
    table is cut from its lineage by a checkpoint each round.
    """
    known = sessions.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    start = sessions.select("id", "parent").join(known, sessions["parent"] == F.col("up"), "left")
    table = start.select("id", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    table = table.withColumn("root", F.when(F.col("up").isNull(), F.col("id")))
    n = table.count()
    for k in range(max_rounds):
        open_ = table.where("root is null").count()
        if open_ == 0 or 2**k > n:
            break
        above = table.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("found"))
        joined = table.join(above, table["up"] == above["at"], "left")
        table = settled(joined.select("id", F.when(F.col("root").isNull(), F.col("next")).alias("up"), F.when(F.col("root").isNull(), F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"), F.coalesce("root", "found").alias("root")))
    return table.select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def cycles(sessions: DataFrame) -> DataFrame:
    """id, leader of every session on a cycle of parents; the leader is the smallest of its cycle.

    Of the sessions without a root, pointers as many steps up as there are
    sessions end on cycles, at every session there; the smallest id they pass
    is found on the way.
    """
    lost = sessions.select("id", "parent").join(roots(sessions).where("root is null").select("id"), "id")
    table = settled(lost.select("id", F.col("parent").alias("up"), F.least("id", "parent").alias("low")))
    n, steps = table.count(), 1
    while steps < 2 * n:
        above = table.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("low").alias("lower"))
        table = settled(table.join(above, table["up"] == above["at"]).select("id", F.col("next").alias("up"), F.least("low", "lower").alias("low")))
        steps *= 2
    return table.join(table.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("leader"))


def _tour(forest: DataFrame) -> DataFrame:
    """e, next of the walk around each tree: a session is entered (>id) and left (<id); ``next`` is null where a walk ends."""
    listed = numbered(forest.where("parent is not null"), "parent", "id")
    after = listed.select((F.col("place") - 1).alias("place"), F.col("parent").alias("of"), F.col("id").alias("sibling"))
    siblings = listed.join(after, "place", "left").select("id", F.when(F.col("of") == F.col("parent"), F.col("sibling")).alias("sibling"))
    first = listed.groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    rows = forest.join(siblings, "id", "left").join(first, "id", "left")
    enter, leave = (lambda c: F.concat(F.lit(">"), F.col(c))), (lambda c: F.concat(F.lit("<"), F.col(c)))
    steps = F.array(
        F.struct(enter("id").alias("e"), F.coalesce(enter("child"), leave("id")).alias("next")),
        F.struct(leave("id").alias("e"), F.coalesce(enter("sibling"), leave("parent")).alias("next")),
    )
    return rows.select(F.inline(steps))


def intervals(sessions: DataFrame) -> DataFrame:
    """id, tree, enter, low, high: a session is below another of its tree if its ``enter`` lies between the other's ``low`` and ``high``.

    The numbers rank a walk around each tree, found by pointer doubling in log
    rounds.  A cycle of parents is cut above its leader; as its sessions are
    all below each other, each gets the numbers of the whole tree.
    """
    known = sessions.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    looped = settled(cycles(sessions))
    heads = looped.where("id = leader").select("id", F.lit(True).alias("head"))
    forest = sessions.select("id", "parent").join(known, "parent", "left").join(heads, "id", "left")
    forest = settled(forest.select("id", F.when(F.col("known") & F.col("head").isNull(), F.col("parent")).alias("parent")))
    walk = _tour(forest).select("e", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("ahead"), F.when(F.col("next").isNull(), F.col("e")).alias("last"))
    walk = settled(walk)
    while not walk.where("next is not null").isEmpty():
        further = walk.select(F.col("e").alias("at"), F.col("next").alias("then"), F.col("ahead").alias("more"), F.col("last").alias("end"))
        joined = walk.join(further, walk["next"] == further["at"], "left")
        walk = settled(joined.select("e", F.col("then").alias("next"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.coalesce("last", "end").alias("last")))
    id_, side = F.substring("e", 2, 1 << 30), F.substring("e", 1, 1)
    number = lambda s: F.max(F.when(side == s, -F.col("ahead")))
    labels = walk.groupBy(id_.alias("id"), F.substring("last", 2, 1 << 30).alias("tree")).agg(number(">").alias("enter"), number("<").alias("leave"))
    whole = labels.where("id = tree").select(F.col("id").alias("head"), F.col("enter").alias("first"), F.col("leave").alias("last"))
    rows = labels.join(looped.select("id", F.col("leader").alias("of")), "id", "left").join(whole, F.col("of") == F.col("head"), "left")
    wide = F.col("of").isNotNull()
    return rows.select("id", "tree", "enter", F.when(wide, F.col("first")).otherwise(F.col("enter")).alias("low"), F.when(wide, F.col("last")).otherwise(F.col("leave")).alias("high"))


def sizes(labels: DataFrame) -> DataFrame:
    """id, n_below: how many sessions are below each, from its numbers alone."""
    return labels.select("id", ((F.col("high") - F.col("low") - 1) / 2).cast("long").alias("n_below"))


def below(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id of every session below each of ``targets`` (column target), which are what users asked for."""
    asked = targets.join(labels.select(F.col("id").alias("target"), "tree", "low", "high"), "target").select("target", F.col("tree").alias("in"), "low", "high")
    rows = labels.select("id", "tree", "enter")
    inside = (F.col("tree") == F.col("in")) & (F.col("enter") >= F.col("low")) & (F.col("enter") < F.col("high")) & (F.col("id") != F.col("target"))
    return rows.join(asked, inside).select("target", "id")


def in_folder(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id of every session whose file lies in the folder named like the target's file; ``sessions`` and ``targets`` have ids or targets that are paths."""
    parts = F.split("id", "/")
    folders = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = sessions.select("id", F.explode(F.when(F.size(parts) > 2, folders)).alias("folder"))
    stems = targets.select("target", F.regexp_replace("target", r"(?i)\.jsonl$", "").alias("folder"))
    return rows.join(stems, "folder").where("id != target").select("target", "id")


def children(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, modified of the sessions below each target: by their parents, or by the folder they lie in."""
    labels = settled(intervals(sessions))
    found = below(labels, targets).unionByName(in_folder(sessions, targets)).distinct()
    return found.join(sessions.select("id", "modified"), "id").select("target", "id", "modified")


def resolved(targets: DataFrame, sessions: DataFrame) -> DataFrame:
    """target, id, how: by place in the newest-first list, exact id or path, or a unique prefix.

    A prefix that fits several sessions is ambiguous and gives no id.  Places
    come from a range-partitioned sort.  Targets are what users typed, of few lengths:
    each id is cut to these, so that prefixes are looked up by equality.
    """
    listed = numbered(sessions.select("id", "modified"), F.col("modified").desc(), F.col("id"))
    asked = targets.select("target").distinct()
    place = asked.where("try_cast(target as int) is not null").select("target", F.expr("try_cast(target as int)").alias("place"))
    by_place = place.join(listed.select("place", "id"), "place").select("target", "id", F.lit(1).alias("rank"), F.lit("place").alias("how"))
    exact = asked.join(sessions.select("id"), F.col("target") == F.col("id")).select("target", "id", F.lit(2).alias("rank"), F.lit("id").alias("how"))
    lengths = [r[0] for r in asked.select(F.length("target").alias("n")).where("n > 0").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"targets of more than {MAX_LENGTHS} lengths; ask for them in parts")
    cut = F.explode(F.array(*(F.when(F.length("id") >= n, F.left("id", F.lit(n))) for n in lengths)) if lengths else F.expr("cast(array() as array<string>)"))
    heads = sessions.select("id", cut.alias("prefix")).where("prefix is not null")
    found = heads.join(asked, F.col("prefix") == F.col("target")).groupBy("target").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    by_prefix = found.select("target", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.lit(3).alias("rank"), F.when(F.col("n") == 1, "prefix").otherwise("ambiguous").alias("how"))
    both = by_place.unionByName(exact).unionByName(by_prefix)
    best = both.groupBy("target").agg(F.min_by(F.struct("id", "how"), "rank").alias("b")).select("target", "b.*")
    return targets.join(best, "target", "left").select("target", "id", F.coalesce("how", F.lit("none")).alias("how"))


def previous(sessions: DataFrame) -> DataFrame:
    """For each session, the newest earlier one of the same folder that has messages."""
    order = Window.partitionBy("cwd").orderBy("modified", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n_messages") > 0, F.col("id")), ignorenulls=True).over(order)
    return sessions.select("id", "cwd", last.alias("previous"))


def link(value: Column, folder: Column) -> Column:
    """Absolute path of a session link, read from ``folder`` if it is relative."""
    parts = F.split(F.when(value.startswith("/"), value).otherwise(F.concat_ws("/", folder, value)), "/")
    kept = F.aggregate(
        F.filter(parts, lambda x: ~x.isin("", ".")),
        F.expr("cast(array() as array<string>)"),
        lambda found, x: F.when(x == "..", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(F.array_append(found, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def comparisons(sessions: DataFrame, targets: list[str], cwd: str, folder: str, current: str | None = None) -> DataFrame:
    """target, path, how: the session each target names, for a user working in ``cwd``.

    ``sessions``: path, cwd, modified, n_messages, all in ``folder``.  A target
    is the word previous (the newest other session of the same folder with
    messages), a file, or a part of a file's name (the first by name).  ``how``
    is previous, path or match, or tells why there is none: missing,
    other-folder, no-messages.  Targets are what a user typed, so they travel
    as literals and every session is looked at once.
    """
    spark = sessions.sparkSession
    name = F.substring_index("path", "/", -1)
    state = F.when(~F.col("cwd").eqNullSafe(cwd), "other-folder").when(F.coalesce("n_messages", F.lit(0)) == 0, "no-messages").otherwise("ok")
    rows = sessions.withColumns({"name": name, "state": state})
    asked = F.explode(F.array(*(F.struct(F.lit(x).alias("target"), (F.lit(x) if x.endswith(".jsonl") else F.lit(f"{folder}/{x}")).alias("file")) for x in dict.fromkeys(targets))))
    rows = rows.select("path", "name", "state", "modified", asked.alias("t")).withColumn("file", link(F.col("t.file"), F.lit(cwd)))
    newest = F.lower("t.target") == "previous"
    rank = (
        F.when(newest, F.when((F.col("state") == "ok") & ~F.col("path").eqNullSafe(F.lit(current)), 1))
        .when((F.col("path") == F.col("file")), F.when(F.col("state") == "ok", 2).otherwise(4))
        .when(F.col("name").endswith(".jsonl") & F.contains("name", F.col("t.target")), 3)
    )
    # a match that fails its own checks stands before the file that failed
    rows = rows.withColumn("rank", rank).where("rank is not null")
    matches = rows.where((F.col("rank") == 4) & F.contains("name", F.col("t.target"))).withColumn("rank", F.lit(3))
    rows = rows.unionByName(matches)
    order = F.struct("rank", F.when(F.col("rank") == 1, -F.col("modified")), "name", "path")
    best = rows.groupBy("t.target").agg(F.min_by(F.struct("path", "state", "rank"), order).alias("b")).select("target", "b.*")
    how = F.when(F.col("state") != "ok", F.col("state")).when(F.col("rank") == 1, "previous").when(F.col("rank") == 2, "path").otherwise("match")
    wanted = spark.createDataFrame([(x,) for x in dict.fromkeys(targets)], "target string")
    return wanted.join(best.select("target", F.when(F.col("state") == "ok", F.col("path")).alias("path"), how.alias("how")), "target", "left").select("target", "path", F.coalesce("how", F.lit("missing")).alias("how"))
