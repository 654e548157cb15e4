"""Ordered events of state machines: each event is a function on states, and functions compose.

Events are put in order by (key, order) over the whole corpus, so a key with millions of events lies in many blocks. Within
a block the functions are composed by a prefix scan, for every state that the block may begin with; the last function of a key in a block is
one small row, those rows are folded key by key, and every event then looks up what it does from the state its block began with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TASK_MOVES, WRITEBACK_MOVES
from ..functions.shared import new_folder


@dataclass(frozen=True)
class Machine:
    """``states``, the first of which a key begins in; ``moves``: (state, event) to (state, attempts added); ``silent``: (state, event) that change nothing and aren't refused.

    Whatever else happens is refused: the state stays.
    """

    states: tuple[str, ...]
    events: tuple[str, ...]
    moves: dict[tuple[str, str], tuple[str, int]]
    silent: frozenset[tuple[str, str]] = frozenset()

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, attempts, refused) by event and state; a last row for events that the machine doesn't know."""
        n = len(self.states)
        to = np.tile(np.arange(n), (len(self.events) + 1, 1))
        adds, refused = np.zeros_like(to), np.ones_like(to)
        for (state, event), (target, more) in self.moves.items():
            at = self.events.index(event), self.states.index(state)
            to[at], adds[at], refused[at] = self.states.index(target), more, 0
        for state, event in self.silent:
            refused[self.events.index(event), self.states.index(state)] = 0
        return to, adds, refused


_TARGETS = tuple(dict.fromkeys(b for _, b in TASK_MOVES))
#: Statuses of a task, by the moves that are allowed; an event names the status to move to.
TASKS = Machine(("pending", *(t for t in _TARGETS if t != "pending")), _TARGETS, {(a, b): (b, 0) for a, b in TASK_MOVES})
_FINISH = {"success": "ok", "failed": "error"}
#: A write-back: ``start`` begins an attempt (again, where moves allow it), is quiet while one runs, and is refused once it is written.
WRITEBACKS = Machine(
    ("none", *dict.fromkeys(x for move in WRITEBACK_MOVES for x in move)),
    ("start", *_FINISH.values()),
    {("none", "start"): ("writing", 1)} | {(a, _FINISH.get(b, "start")): (b, int(b == "writing")) for a, b in WRITEBACK_MOVES},
    frozenset({("writing", "start")}),
)


def scan(to: np.ndarray, adds: np.ndarray, refused: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composed functions (event x state) of each run of rows up to each row; ``first``: where a row's run begins."""
    to, adds, refused, at, step = to.copy(), adds.copy(), refused.copy(), np.arange(len(to)), 1
    while step < len(to):
        later = at[at - step >= first]
        if not len(later):
            break
        before = to[later - step]
        take = lambda x: np.take_along_axis(x[later], before, 1)
        a, r, t = adds[later - step] + take(adds), refused[later - step] + take(refused), take(to)
        adds[later], refused[later], to[later] = a, r, t
        step *= 2
    return to, adds, refused


def _composed(machine: Machine):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tables, code = machine.tables(), {e: i for i, e in enumerate(machine.events)}
        for block, pdf in enumerate(it):
            if not len(pdf):
                continue
            event = pdf["event"].map(code).fillna(len(code)).to_numpy(np.int64)
            key = pdf["key"].to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            own = [t[event] for t in tables]
            to, adds, refused = scan(*own, first)
            # the state before an event is what the one before it has made
            before = np.where(new[:, None], np.arange(len(machine.states)), np.roll(to, 1, 0))
            out = pdf.assign(block=(TaskContext.get().partitionId() << 32) + block, last=np.append(new[1:], True))
            for name, x in (("to", to), ("adds", adds), ("refused", refused), ("no", np.take_along_axis(own[2], before, 1))):
                out[name] = list(x.astype(np.int32 if name in ("to", "no") else np.int64))
            yield out

    return run


def run_sequences(events: DataFrame, machine: Machine, key: str = "key", order: str = "seq", event: str = "event") -> tuple[DataFrame, DataFrame]:
    """(events, keys) of (key, seq, event): each event with ``verdict`` and the ``state`` after it; each key with its last state, ``attempts`` and ``refused``.

    Events with equal order go by their name; a null key is a key of its own (no machine: its events are left out), an unknown event is refused.
    """
    spark = events.sparkSession
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("seq"), F.col(event).alias("event"))
    ordered = rows.repartitionByRange("key", "seq", "event").sortWithinPartitions("key", "seq", "event")
    path = new_folder(spark, "sequences")
    schema = "key long, seq long, event string, block long, last boolean, to array<int>, adds array<long>, refused array<long>, no array<int>"
    ordered.mapInPandas(_composed(machine), schema).write.parquet(path)
    composed = spark.read.schema(schema).parquet(path)

    lasts = composed.where("last").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "to", "adds", "refused"))).alias("blocks"))  # a row a block of a key
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<block:long,s:int>>").alias("seen"))
    fold = lambda acc, b: F.struct(F.get(b["to"], acc["s"]).alias("s"), (acc["a"] + F.get(b["adds"], acc["s"])).alias("a"), (acc["r"] + F.get(b["refused"], acc["s"])).alias("r"), F.concat(acc["seen"], F.array(F.struct(b["block"].alias("block"), acc["s"].alias("s")))).alias("seen"))
    folded = lasts.select("key", F.aggregate("blocks", start, fold).alias("f"))
    names = F.array(*(F.lit(s) for s in machine.states))
    finals = folded.select("key", F.get(names, F.col("f.s")).alias("state"), F.col("f.a").alias("attempts"), F.col("f.r").alias("refused"))
    entry = folded.select("key", F.explode("f.seen").alias("e")).select("key", "e.block", F.col("e.s").alias("s"))
    met = composed.join(entry, ["key", "block"])
    verdict = F.when(F.get("no", F.col("s")) == 1, "INVALID_STATE_TRANSITION").otherwise("OK")
    return met.select("key", "seq", "event", verdict.alias("verdict"), F.get(names, F.get("to", F.col("s"))).alias("state")), finals
