"""Event sequences against one event after the other."""

import random

import pytest

from clausegrid.operators import sequences
from clausegrid.operators.sequences import TASKS, WRITEBACKS


def brute(rows, machine):
    state, attempts, refused, out = {}, {}, {}, []
    for k, s, e in sorted(x for x in rows if x[0] is not None):
        now = state.setdefault(k, machine.states[0])
        target, more = machine.moves.get((now, e), (now, 0))
        no = (now, e) not in machine.moves and (now, e) not in machine.silent
        state[k], attempts[k], refused[k] = target, attempts.get(k, 0) + more, refused.get(k, 0) + no
        out.append((k, s, e, "INVALID_STATE_TRANSITION" if no else "OK", target))
    return sorted(out), sorted((k, state[k], attempts[k], refused[k]) for k in state)


@pytest.mark.parametrize(("machine", "parts"), [(TASKS, 5), (WRITEBACKS, 3), (WRITEBACKS, 1)])
def test_like_one_after_the_other(spark, machine, parts):
    r = random.Random(parts)
    rows = [(r.choice([1, 1, 1, 2, 3, 50, None]), r.randrange(3000), r.choice([*machine.events, *machine.events, "?"])) for _ in range(4000)]  # a key with half of all events
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        df = spark.createDataFrame(rows, "key long, seq long, event string").repartition(4)
        events, finals = sequences.run_sequences(df, machine)
        want = brute(rows, machine)
        assert sorted(map(tuple, events.collect())) == want[0] and sorted(map(tuple, finals.collect())) == want[1]
        made = spark.read.parquet(events.inputFiles()[0].rsplit("/", 1)[0]).where("key = 1")
        assert made.select("block").distinct().count() > 5  # its events lie in many blocks
        none = sequences.run_sequences(df.limit(0), machine)
        assert none[0].count() == none[1].count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_machines():
    assert WRITEBACKS.moves == {("none", "start"): ("writing", 1), ("not_written", "start"): ("writing", 1), ("failed", "start"): ("writing", 1), ("writing", "ok"): ("success", 0), ("writing", "error"): ("failed", 0)}
    assert TASKS.states[0] == "pending" and ("completed", "pending") not in TASKS.moves and TASKS.moves["reviewing", "reviewing"] == ("reviewing", 0)
