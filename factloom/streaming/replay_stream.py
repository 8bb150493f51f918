"""Replay as a stream: the same rules, a branch's state kept as maps between batches.

Facts, tombstones and the keys that tell duplicates are map states, so a batch
reads and writes only the ids and keys that its events name; what a branch holds
besides is not touched, however much it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import VERDICTS, Branch, active, broken, words_of
from ..plans import fixtures
from ..sources.shared import shared_path

#: The store that keeps map states; it holds them on the executors' disks.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stored:
    """What a dictionary is to a branch, over a map state: entries are read once a batch and written back when it ends."""

    def __init__(self, state, pack, unpack):
        self.state, self.pack, self.unpack = state, pack, unpack
        self.held: dict = {}  # None where the state has no such key
        self.changed: set = set()

    def get(self, key, default=None):
        if key not in self.held:
            value = self.state.getValue(key if isinstance(key, tuple) else (key,))
            self.held[key] = None if value is None else self.unpack(value[0])
        found = self.held[key]
        return default if found is None else found

    __getitem__ = get

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __setitem__(self, key, value) -> None:
        self.held[key] = value
        self.changed.add(key)

    def pop(self, key, default=None):
        value = self.get(key, default)
        self[key] = None
        return value

    def clear(self) -> None:
        self.state.clear()
        self.held, self.changed = {}, set()

    def items(self) -> list:
        """All entries; asked for only behind a snapshot, which brings them in."""
        self.flush()
        return [(key[0], self.unpack(value[0])) for key, value in self.state.iterator()]

    def flush(self) -> None:
        for key in self.changed:
            at = key if isinstance(key, tuple) else (key,)
            if self.held[key] is None:
                self.state.removeKey(at)
            else:
                self.state.updateValue(at, (self.pack(self.held[key]),))
        self.changed = set()


class StoredBranch(Branch):
    """A branch over stored maps."""

    def __init__(self, facts, tombs, keys, mutations: int):
        self.facts, self.tombs, self.keys, self.mutations = facts, tombs, keys, mutations

    def load(self, facts: dict, tombs: dict) -> None:
        for held in (self.facts, self.tombs, self.keys):
            held.clear()
        for id_, fact in facts.items():
            self._put(id_, fact)
        for id_, tomb in tombs.items():
            self.tombs[id_] = tomb


class Judge(StatefulProcessor):
    """Verdicts on a branch's new events, in sequence order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getMapState("facts", "id string", "fact string")
        self.tombs = handle.getMapState("tombs", "id string", "tomb string")
        self.keys = handle.getMapState("keys", "type string, text string", "id string")
        self.mutations = handle.getValueState("mutations", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        maps = Stored(self.facts, json.dumps, json.loads), Stored(self.tombs, json.dumps, json.loads), Stored(self.keys, str, str)
        branch = StoredBranch(*maps, self.mutations.get()[0] if self.mutations.exists() else 0)
        out = []
        for row in pd.concat(rows).sort_values("seq", kind="stable").to_dict("records"):
            # pandas turns whole numbers beside nulls into floats
            row |= {k: None if pd.isna(row[k]) else int(row[k]) for k in ("seq", "revision", "updated_at", "at")}
            row |= {k: None if pd.isna(row[k]) else row[k] for k in ("text", "snapshot", "broken") if k in row}
            out += words_of(key[0], branch, row)
        for held in maps:
            held.flush()
        self.mutations.update((branch.mutations,))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])
        yield frame.astype({"revision": "Int32", "updated_at": "Int64", "tomb_revision": "Int32"})

    def close(self) -> None:
        pass


def words(journal: DataFrame) -> DataFrame:
    """Streaming journal to streaming verdicts and snapshot contents.

    No watermark: late events are judged by revision and time, and tombstones
    stay for good.
    """
    return journal.withColumn("broken", broken(journal.columns)).groupBy("branch_id").transformWithStateInPandas(Judge(), VERDICTS, "append", "none")


def state(spark: SparkSession, sf_dir: str, journal=fixtures.journal) -> DataFrame:
    """Current facts after the events table has run through the stream."""
    table = fixtures.table(spark, sf_dir, "events")
    reader = spark.readStream.schema(table.schema).format("parquet")
    single = any(f.endswith("/events.parquet") for f in table.inputFiles()[:1])
    # a stream reads folders: a table of one file is found in its folder by name
    events = reader.option("pathGlobFilter", "events.parquet").load(sf_dir) if single else reader.load(f"{sf_dir}/events.parquet")
    out = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    run(words(journal(events)), out)
    return active(spark.read.parquet(f"{out}/verdicts"))


def run(verdicts: DataFrame, out: str) -> None:
    """Write what has come so far to ``out``; run again, it goes on where it stopped."""
    conf = verdicts.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        started = verdicts.writeStream.format("parquet").option("path", f"{out}/verdicts").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)
