"""Reading journals and dialogues; appending events once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate


def entries(spark: SparkSession, path: str) -> DataFrame:
    """branch_id, seq, entry_type, data of JSON lines, in order of ``seq``."""
    return spark.read.schema("branch_id string, seq long, entry_type string, data string").json(path)


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of each dialogue file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def optional_text(spark: SparkSession, paths: list[str], limit: int) -> DataFrame:
    """path, text cut to ``limit``, truncated, source_chars of each file named; no file, no row."""
    found = []
    for path in paths:
        files, make = _storage(spark, path)
        if files.exists(make(path)):
            found.append(path)
    rows = spark.read.text(found, wholetext=True) if found else spark.createDataFrame([], "value string, _metadata struct<file_path:string>")
    source = F.col("_metadata.file_path").alias("path")
    return rows.select(source, truncate(F.col("value"), limit).alias("text"), (F.length("value") > limit).alias("truncated"), F.length("value").cast("long").alias("source_chars"))


def json_objects(rows: DataFrame, raw: str) -> DataFrame:
    """Rows with ``document`` (variant) and ``problem``: no-json or no-object; empty text has neither."""
    parsed = F.try_parse_json(raw)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    blank = F.coalesce(F.col(raw), F.lit("")) == ""
    problem = F.when(blank, F.lit(None)).when(parsed.isNull(), "no-json").when(~is_object, "no-object")
    return rows.withColumns({"document": F.when(~blank & is_object, parsed), "problem": problem})


#: Columns of a journal's entries.
ENTRY = ("branch_id", "seq", "entry_type", "data")


def canonical(data) -> Column:
    """JSON with the members of every object in order of their names; other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(data)), data)


def _storage(spark: SparkSession, path: str):
    """File system of ``path``, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def last_commit(spark: SparkSession, path: str) -> int:
    """Number of a journal's latest commit; 0 if there is none."""
    files, make = _storage(spark, path)
    log = make(f"{path}/_commits/log")
    return max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(log)), default=0) if files.exists(log) else 0


def claim(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Make commit ``number`` of ``batch``, whole or not at all; false if another writer has it.

    The file is written elsewhere and then given its name in one step that fails
    where the name is taken: a hard link on a local disk, a rename elsewhere.
    """
    files, make = _storage(spark, path)
    written, name = make(f"{path}/_commits/open/{batch}-{number}.json"), make(f"{path}/_commits/log/{number:020d}.json")
    files.mkdirs(name.getParent())
    out = files.create(written, True)
    out.write(bytearray(f'{{"number":{number},"batch":"{batch}"}}\n'.encode()))
    out.close()
    if files.getUri().getScheme() == "file":
        try:
            os.link(written.toUri().getPath(), name.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(written, False)
    won = not files.exists(name) and files.rename(written, name)
    if not won:
        files.delete(written, False)
    return won


def committed(spark: SparkSession, path: str) -> DataFrame:
    """Committed entries of a journal, each with its digest and the number of its commit."""
    if not last_commit(spark, path):
        return spark.createDataFrame([], "branch_id string, seq long, entry_type string, data string, digest string, number long")
    commits = spark.read.schema("number long, batch string").json(f"{path}/_commits/log")
    # folders that no commit names may go at any time, so only the others are looked at; a name a commit goes through the driver
    folders = [f"{path}/batch={row['batch']}" for row in commits.collect()]
    return spark.read.option("basePath", path).parquet(*folders).join(F.broadcast(commits), "batch").drop("batch")


def append(entries: DataFrame, path: str) -> DataFrame:
    """Append entries that the journal does not hold yet, known by a digest of their columns, JSON in ``data`` in canonical form; returns these.

    Entries are written as a batch that nobody reads until a numbered commit names
    it.  Of several writers one wins a number; the others look at what has come
    meanwhile and try the next, so every entry is there once.  Running the same
    batch again adds nothing.
    """
    spark = entries.sparkSession
    files, make = _storage(spark, path)
    said = [canonical(F.col(c)).alias(c) if c == "data" else F.col(c) for c in sorted(entries.columns)]
    rows = entries.withColumn("digest", F.sha2(F.to_json(F.struct(*said)), 256)).dropDuplicates(["digest"])
    while True:
        number = last_commit(spark, path) + 1
        batch = uuid.uuid4().hex
        folder = f"{path}/batch={batch}"
        rows.join(committed(spark, path).select("digest"), "digest", "left_anti").select(*rows.columns).write.parquet(folder)
        mine = spark.read.schema(rows.schema).parquet(folder)
        if mine.isEmpty():
            files.delete(make(folder), True)
            return spark.createDataFrame([], rows.schema)
        if claim(spark, path, number, batch):
            return mine
        files.delete(make(folder), True)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a row."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
