"""Runs of an evaluating model over many prompts, each request answered once.

A model is a function from the messages of a request (the prompt, or the prompt,
its first answer and a plea for JSON) to a text.  Requests are known by a digest
and dealt by it; a task calls the model for a bounded window of requests at a time
and stores the window's outcomes under a name made from the digests in it, so that a
task that is tried again finds them instead of calling again, and so does a later run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import constants as C
from ..sources.sessions import storage
from .transcript import first_json_object

#: Characters of an answer that a problem quotes.
QUOTED = 600

OUTCOME = "digest string, n_calls int, recovered boolean, evaluation string, problem string"

Model = Callable[[list[str]], str]


def ask(model: Model, digest: str, prompt: str) -> dict:
    """One request: an answer with a JSON object in it, else one more call that asks for nothing but JSON."""
    first = model([prompt]) or ""
    found = first_json_object(first)
    if found is not None:
        return {"digest": digest, "n_calls": 1, "recovered": False, "evaluation": found, "problem": None}
    second = model([prompt, first, C.RECOVERY_PROMPT]) or ""
    found = first_json_object(second)
    if found is not None:
        return {"digest": digest, "n_calls": 2, "recovered": True, "evaluation": found, "problem": None}
    shown = " ".join(second.split())[:QUOTED]
    return {"digest": digest, "n_calls": 2, "recovered": False, "evaluation": None, "problem": f"no JSON object; answer: {shown or '<empty>'}"}


def stored(files: fs.FileSystem, name: str) -> list[dict] | None:
    """Outcomes of a window, if they are there."""
    if files.get_file_info(name).type != fs.FileType.File:
        return None
    with files.open_input_file(name) as f:
        return [json.loads(line) for line in f.read().splitlines()]


def store(files: fs.FileSystem, folder: str, name: str, found: list[dict], attempt: str) -> None:
    """Whole or not at all: written under a name that readers pass over, then moved."""
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/_{attempt}-{name}") as f:
        f.write("".join(json.dumps(x) + "\n" for x in found).encode())
    files.move(f"{folder}/_{attempt}-{name}", f"{folder}/{name}")


def answered(prompts: DataFrame, folder: str) -> DataFrame:
    """Outcomes that earlier runs have left in ``folder``."""
    spark = prompts.sparkSession
    files, inside = storage(folder)
    if files.get_file_info(inside).type != fs.FileType.Directory:
        return spark.createDataFrame([], OUTCOME)
    return spark.read.schema(OUTCOME).json(folder).dropDuplicates(["digest"])


def outcomes(prompts: DataFrame, model: Model, path: str, name: str = "model", prompt: str = "prompt", window: int = 16, at_once: int = 4) -> DataFrame:
    """``prompts`` without the prompts, with digest, n_calls, recovered, evaluation (JSON text) and problem.

    ``path`` is a folder that all executors share; ``name`` tells models apart in it.
    Equal prompts are one request.  A task holds ``window`` requests and calls the
    model for ``at_once`` of them together.  If a call fails the task fails and is
    tried again, with the windows before it kept.  A null prompt is not asked:
    its columns are null.
    """
    folder = f"{path}/outcomes"

    def run(batches):
        files, inside = storage(folder)
        rows = (pair for b in batches for pair in zip(b.column("digest").to_pylist(), b.column("prompt").to_pylist()))
        attempt = str(TaskContext.get().taskAttemptId())
        with ThreadPoolExecutor(at_once) as pool:
            while part := list(islice(rows, window)):
                file = hashlib.sha256("".join(digest for digest, _ in part).encode()).hexdigest() + ".json"
                done = stored(files, f"{inside}/{file}")
                if done is None:
                    done = list(pool.map(lambda p: ask(model, *p), part))
                    store(files, inside, file, done, attempt)
                yield pa.RecordBatch.from_pylist(done, schema=target)

    target = to_arrow_schema(_parse_datatype_string(OUTCOME))
    asked = prompts.withColumn("digest", F.sha2(F.concat(F.lit(name + "\0"), F.col(prompt)), 256))
    requests = asked.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first(prompt).alias("prompt"))
    known = answered(prompts, folder)
    # a part is in order of digests, so a second try meets the same windows; prompts are shuffled once, to find equal ones
    new = requests.join(known, "digest", "left_anti").sortWithinPartitions("digest").mapInArrow(run, OUTCOME)
    return asked.drop(prompt).join(known.unionByName(new), "digest", "left")
