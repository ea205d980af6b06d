"""The event fold and the bounded queue: batch, stream and a plain loop agree."""

import json
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from stratiform.streaming import fold as E, queue as Q

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def some_event(r):
    kind = r.choice([*E.KINDS, "dimension_start", "dimension_delta", "dimension_delta", "dimension_delta", "dimension_complete", "unknown"])
    d = {"layer": r.choice([1, 2, None]), "dimension_key": r.choice(["a", "b", "c", "d", "e", ""])}
    text = "x" * r.randrange(0, 60)
    extra = {
        "accumulated": text, "full_content": text, "is_revision": r.random() < 0.2, "word_count": r.choice([None, 7]), "dimension_count": r.choice([None, 2]), "task_id": "t1", "pause_after_step": r.choice([None, True, False]),
        "previous_layer": r.choice([None, 0, 1]), "current_layer": r.choice([None, 2]), "checkpoint_id": r.choice(["", "c1", "c2"]), "checkpoint_type": r.choice(["key", "x"]), "dimension_reports": r.choice([None, {}, {"a": "r", "z": "rr"}]),
        "tool_name": r.choice(["", "gis", "rag"]), "stage": r.choice([None, "s"]), "status": r.choice([None, "error", "success"]), "progress": r.choice([None, 0, 5]), "query": r.choice([None, "q"]), "documents": [1, 2],
        "trigger_dim": "a", "impacted_dimensions": ["b"], "phase": r.choice([None, "layer2"]), "current_wave": 2, "layers": r.choice([None, [], [1]]), "rag_layer_config": r.choice([None, {"1": True}]), "error": r.choice([None, "bad"]),
    }
    d |= {k: v for k, v in extra.items() if r.random() < 0.7}
    return kind, json.dumps(d) if r.random() < 0.97 else None


def histories(seed, sessions=12, most=120):
    r = random.Random(seed)
    return {s: [(n + 1, *some_event(r)) for n in range(r.randrange(1, most))] for s in range(sessions)}


def plain(history):
    state = E.new_state()
    for event in history:
        E.apply(state, *event)
    return E.summary(state)


def rows_of(histories, r=None, repeats=0.0):
    rows = [(s, *e) for s, h in histories.items() for e in h]
    if r:
        rows += [x for x in rows if r.random() < repeats]
        r.shuffle(rows)
    return rows


SCHEMA = "session_id long, seq long, type string, data string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_fold_equals_a_plain_loop(spark, seed):
    h = histories(seed)
    rows = rows_of(h, random.Random(seed), 0.3) + [(0, None, "completed", None), (0, 0, "completed", None)]
    got = {r[0]: tuple(r)[1:] for r in E.fold_sessions(spark.createDataFrame(rows, SCHEMA), "session_id").collect()}
    assert got == {s: plain(e) for s, e in h.items()}
    assert E.fold_sessions(spark.createDataFrame([], SCHEMA), "session_id").count() == 0


def test_compaction_leaves_the_state_and_drops_deltas(spark):
    h = {s: [(1, "layer_started", '{"layer": 1}')] + [(n, "dimension_delta", json.dumps({"layer": 1, "dimension_key": "ab"[n % 2], "accumulated": "x" * n})) for n in range(2, 300)] for s in range(3)}
    events = spark.createDataFrame(rows_of(h), SCHEMA)
    assert E.compacted(events, "session_id").count() == 3 * 5
    assert {r[0]: tuple(r)[1:] for r in E.fold_sessions(events, "session_id").collect()}[1][1:] == plain(h[1])[1:]


def test_golden_session():
    say = lambda **d: json.dumps(d)
    s = E.new_state()
    steps = [
        ("connected", say(task_id="t"), {"status": "planning", "session": "t"}),
        ("layer_started", say(layer=2, dimension_count=2), {"phase": "layer2", "sizes": {"2": 2}, "messages": {"layer_2": "report"}}),
        ("dimension_start", say(layer=2, dimension_key="a"), {"executing": ["2_a"]}),
        ("dimension_delta", say(layer=2, dimension_key="a", accumulated="text"), {"reports": {"2_a": "text"}}),
        ("dimension_complete", say(layer=2, dimension_key="a"), {"executing": [], "progress": {"2_a": {"status": "completed", "words": 4, "revision": False}}, "status": "planning"}),
        ("dimension_complete", say(layer=2, dimension_key="b", full_content="long", word_count=9), {"status": "paused", "pause": True, "previous_layer": 2}),
        ("checkpoint_saved", say(layer=2, checkpoint_id="c", checkpoint_type="key"), {"checkpoints": {"2": {"id": "c", "kind": "key", "revision": False}}}),
        ("resumed", None, {"status": "planning", "pause": False, "previous_layer": 0}),
        ("dimension_reset", say(layer=2, dimension_key="a"), {"resetting": ["2_a"], "versions": {"2_a": 1}}),
        ("dimension_reset_complete", say(layer=2, dimension_key="a"), {"resetting": []}),
        ("completed", None, {"status": "completed"}),
    ]
    for n, (kind, data, want) in enumerate(steps, 1):
        E.apply(s, n, kind, data)
        assert {k: s[k] for k in want} == want, kind
        before = json.dumps(s)
        E.apply(s, n, "connected", None)  # a repeat
        assert json.dumps(s) == before


def waited(query, done, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not done():
        if query.exception():
            raise query.exception()
        time.sleep(0.5)


def test_stream_agrees_with_batch_when_events_repeat_and_come_out_of_order(rocks, tmp_path):
    h = histories(7, sessions=6, most=60)
    rows = rows_of(h, random.Random(7), 0.4)
    for i in range(3):
        rocks.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = E.fold_stream(stream, "session_id")
    q = out.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = rocks.table("folded").groupBy("session_id").agg(F.max_by(F.struct(*E.NAMES), "last_seq").alias("s"))
    assert {r["session_id"]: tuple(r["s"]) for r in last.collect()} == {s: plain(e) for s, e in h.items()}


def rounds(arrived, capacity):
    out = []
    for n, a in enumerate(arrived):
        out.append(max(a, out[n - capacity] + 1) if n >= capacity else a)
    return out


def test_delivery_rounds_equal_a_queue(spark):
    r = random.Random(3)
    rows, want = [], {}
    for s in range(5):
        arrived = sorted(r.randrange(0, 30) for _ in range(r.randrange(1, 200)))
        rows += [(s, n + 1, a) for n, a in enumerate(arrived)]
        want |= {(s, n + 1): d for n, d in enumerate(rounds(arrived, 4))}
    events = spark.createDataFrame(rows, "s int, n long, a int")
    got = {(x["s"], x["n"]): x["round"] for x in Q.delivery_rounds(events, "s", "n", F.col("a"), 4).collect()}
    assert got == want and max(want.values()) > 30


def test_queue_stream_loses_nothing_at_ten_times_its_capacity(rocks, tmp_path):
    rows = [(s, n, f"e{s}.{n}") for s in (1, 2) for n in range(1, 41 if s == 1 else 7)]
    rocks.createDataFrame(rows, "s long, n long, p string").coalesce(1).write.json(str(tmp_path / "in"))
    rocks.createDataFrame(rows[5:9], "s long, n long, p string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))  # repeats
    stream = rocks.readStream.schema("s long, n long, p string").json(str(tmp_path / "in"))
    out = Q.queue_stream(stream, "s", "n", "p", capacity=4, millis=50)
    q = out.writeStream.outputMode("append").format("memory").queryName("queued").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        waited(q, lambda: rocks.table("queued").count() >= len(rows))
        got = [tuple(x) for x in rocks.table("queued").collect()]
    finally:
        q.stop()
        shutil.rmtree(tmp_path / "cp", ignore_errors=True)
    assert sorted((s, n, p) for s, n, p, _ in got) == sorted(rows)
    for s in (1, 2):
        mine = sorted((t, n) for k, n, _, t in got if k == s)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
        assert all(sum(t == turn for t, _ in mine) <= 4 for turn in range(20))
