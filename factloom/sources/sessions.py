"""Session files of several roots: a data source whose partitions are folders.

A task lists one folder of a root and whatever lies below it, and reads no more
than a file's head.  Folders are reached through Arrow's file systems, so roots may
be local paths or URIs that Arrow knows.
"""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders below a root that are looked into, files taken of a root, and bytes read of a file.
DEPTH, PER_ROOT, HEAD_BYTES = 5, 2_000, 128 * 1024

FILE = "root string, place array<string>, path string, modified long, header string"


def storage(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a local path or a URI."""
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(place))


def listed(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds, by name; nothing if it cannot be read.  Links are passed over."""
    try:
        found = files.get_file_info(fs.FileSelector(folder))
    except OSError:
        return []
    local = isinstance(files, fs.LocalFileSystem)
    return sorted((f for f in found if not (local and os.path.islink(f.path))), key=lambda f: f.base_name)


def first_line(files: fs.FileSystem, path: str) -> str | None:
    """The first line of a file's head, trimmed; null if the file cannot be read."""
    try:
        with files.open_input_file(path) as f:
            return f.read(HEAD_BYTES).split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    except OSError:
        return None


class Folder(InputPartition):
    """A folder of a root; ``deep`` is false if only its own files are wanted."""

    def __init__(self, root: str, folder: str, depth: int, deep: bool):
        self.root, self.folder, self.depth, self.deep = root, folder, depth, deep


class SessionReader(DataSourceReader):
    def __init__(self, options):
        n = int(options.get("roots", 0))
        self.roots = list(dict.fromkeys(options[f"root{k}"] for k in range(n)))
        self.depth, self.limit = int(options.get("depth", DEPTH)), int(options.get("limit", PER_ROOT))
        self.suffix = options.get("suffix", ".jsonl")

    def partitions(self):
        out = []
        for root in self.roots:
            files, top = storage(root)
            out.append(Folder(root, top, 0, False))
            below = [f.path for f in listed(files, top) if f.type == fs.FileType.Directory and not f.base_name.startswith(".")]
            out += [Folder(root, path, self.depth - 1, True) for path in below if self.depth > 0]
        return out or [Folder("", "", 0, False)]

    def read(self, part):
        if not part.folder:
            return
        files, top = storage(part.root)
        taken, stack = 0, [(part.folder, part.depth)]
        while stack and taken < self.limit:
            path, depth = stack.pop()
            info = None if isinstance(path, str) else path
            if info is None or info.type == fs.FileType.Directory:
                inner = listed(files, path if info is None else info.path)
                deeper = [f for f in inner if f.type == fs.FileType.Directory and not f.base_name.startswith(".")] if part.deep and depth > 0 else []
                wanted = {f.path for f in deeper} | {f.path for f in inner if f.type == fs.FileType.File and f.base_name.endswith(self.suffix)}
                stack += [(f, depth - 1) for f in reversed(inner) if f.path in wanted]
                continue
            taken += 1
            place = info.path[len(top) :].strip("/").split("/")
            yield part.root, place, info.path, int(info.mtime.timestamp() * 1000), first_line(files, info.path)


class SessionSource(DataSource):
    """Options: ``roots`` (how many), ``root0``, ``root1``..., ``depth``, ``limit``, ``suffix``."""

    @classmethod
    def name(cls):
        return "session_files"

    def schema(self):
        return FILE

    def reader(self, schema):
        return SessionReader(self.options)


def session_files(spark: SparkSession, *roots: str, depth: int = DEPTH, limit: int = PER_ROOT, suffix: str = ".jsonl") -> DataFrame:
    """root, path, modified (epoch ms) and header of the session files of ``roots``, each path once.

    Folders down to ``depth`` below a root are looked into, dotted ones are not, and
    unreadable or missing ones count as empty.  Of each root the first ``limit``
    files in the order of a walk by name are taken.
    """
    spark.dataSource.register(SessionSource)
    source = spark.read.format("session_files").options(roots=len(roots), depth=depth, limit=limit, suffix=suffix)
    for k, root in enumerate(roots):
        source = source.option(f"root{k}", root)
    # a partition gives ``limit`` rows at most, and the window keeps no more of a root
    rows = source.load().withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("place")))
    first = F.min_by(F.struct("root", "modified", "header"), F.array_position(F.array(*map(F.lit, roots)), F.col("root"))) if roots else F.first(F.struct("root", "modified", "header"))
    return rows.where(F.col("n") <= limit).groupBy("path").agg(first.alias("f")).select("path", "f.*")


def session_headers(files: DataFrame) -> DataFrame:
    """path, id, cwd, parent, modified of files whose first line is a session header: an object of that type with a text as id."""
    doc = F.col("document")
    rows = files.withColumn("document", F.try_parse_json("header"))
    kind = lambda name: F.schema_of_variant(F.variant_get(doc, f"$.{name}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))
    sound = F.schema_of_variant(doc).startswith("OBJECT") & (text("type") == "session") & text("id").isNotNull()
    return rows.where(sound).select("path", text("id").alias("id"), text("cwd").alias("cwd"), text("parentSession").alias("parent"), "modified")
