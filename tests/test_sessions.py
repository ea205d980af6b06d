"""Golden tables of session transitions, worked by hand from the rules."""

from stratiform.operators import sessions as T

FIELDS = "session_id int, phase string, step_mode boolean, is_revision boolean, execution_paused boolean, pause_after_step boolean, previous_layer int, finished array<string>, expected array<string>, impacted array<string>, revised array<string>"
AB = ["a", "b"]


def test_every_completion(spark):
    rows = [
        (1, "layer1", False, False, None, None, None, ["b", "a"], AB, None, None),
        (2, "layer1", True, False, False, False, 0, AB, AB, None, None),
        (3, "layer3", False, False, True, True, 2, AB, AB, None, None),
        (4, "layer2", None, None, False, False, 1, ["a"], AB, None, None),
        (5, "layer2", False, False, False, False, 1, ["a", "b", "c"], AB, None, None),
        (6, "completed", False, False, False, False, 3, AB, AB, None, None),
        (7, "layer1", False, False, False, False, 0, [], [], None, None),
        (8, "layer1", False, True, False, False, 0, AB, AB, AB, ["b", "a"]),
        (9, "layer1", False, True, False, False, 0, AB, AB, AB, ["a"]),
        (10, "odd", False, False, False, False, 0, AB, AB, None, None),
        (11, "layer3", True, False, False, False, 0, AB, AB, None, None),
        (12, "init", False, False, False, False, 0, AB, AB, None, None),
    ]
    got = {r["session_id"]: r for r in T.completion(spark.createDataFrame(rows, FIELDS)).collect()}
    want = {
        # outcome, phase, execution_paused, pause_after_step, previous_layer, is_revision, clear_pending, events
        1: ("advanced", "layer2", False, False, 1, False, True, ["layer_completed", "layer_started"]),
        2: ("paused", "layer1", True, True, 1, False, True, ["layer_completed", "layer_paused"]),
        3: ("completed", "completed", True, True, 2, False, True, ["layer_completed"]),
        4: ("incomplete", "layer2", False, False, 1, False, False, []),
        5: ("incomplete", "layer2", False, False, 1, False, False, []),
        6: ("ended", "completed", False, False, 3, False, False, []),
        7: ("incomplete", "layer1", False, False, 0, False, False, []),
        8: ("revision_complete", "layer1", False, False, 0, False, True, []),
        9: ("revising", "layer1", False, False, 0, True, False, []),
        10: ("ended", "odd", False, False, 0, False, False, []),
        11: ("paused", "layer3", True, True, 3, False, True, ["layer_completed", "layer_paused"]),
        12: ("advanced", "layer1", False, False, 0, False, True, ["layer_completed", "layer_started"]),
    }
    names = ["outcome", "phase", "execution_paused", "pause_after_step", "previous_layer", "is_revision", "clear_pending", "events"]
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want
    assert got[8]["last_revised"] == AB and got[1]["last_revised"] is None
    pending = spark.createDataFrame([(s, n, d) for s in (1, 2, 3, 4, 8, 9) for n in (1, 3) for d in "abz"], "session_id int, layer int, dimension_key string")
    kept = {(r[0], r[1], r[2]) for r in T.flushed(T.completion(spark.createDataFrame(rows, FIELDS)), pending).collect()}
    assert kept == {(s, 1, d) for s in (1, 2) for d in "abz"} | {(3, 3, d) for d in "abz"} | {(s, n, d) for s in (8, 9) for n in (1, 3) for d in AB}


def test_reviews(spark):
    s = spark.createDataFrame([(i, p, True, 2, 3, False, "paused", "broken") for i, p in ((1, "layer1"), (2, "layer1"), (3, "layer1"), (4, "layer1"), (5, "completed"))], "session_id int, phase string, pause_after_step boolean, previous_layer int, current_wave int, is_revision boolean, status string, error string")
    d = spark.createDataFrame([(1, "approve", None, None), (2, "reject", "shorter", ["a"]), (3, "reject", "", ["a"]), (5, "approve", None, None)], "session_id int, action string, feedback string, dimensions array<string>")
    names = ["answer", "phase", "pause_after_step", "previous_layer", "current_wave", "is_revision", "status", "error", "feedback", "revision_targets"]
    got = {r["session_id"]: tuple(r[n] for n in names) for r in T.decided(s, d).collect()}
    same = ("layer1", True, 2, 3, False, "paused", "broken", None, None)
    assert got == {
        1: ("approved", "layer2", False, 0, 1, False, "running", "broken", None, None),
        2: ("rejected", "layer1", False, 2, 3, True, "revising", None, "shorter", ["a"]),
        3: ("feedback required", *same),
        4: (None, *same),
        5: ("approved", "completed", False, 0, 1, False, "running", "broken", None, None),
    }


def test_status_of_stored_sessions(spark):
    stored = spark.createDataFrame([(i, f"t{i}", name) for i, name in ((1, "p"), (2, None), (3, "q"), (4, "r"))], "session_id int, created_at string, project_name string")
    states = spark.createDataFrame([(1, "layer2", False, None), (2, "completed", True, 50.0), (3, "layer1_x", True, None), (9, "layer1", False, None)], "session_id int, phase string, execution_paused boolean, progress double")
    got = {r["session_id"]: (r["project_name"], r["phase"], r["current_layer"], r["status"], round(r["progress"], 2), r["execution_complete"]) for r in T.status_view(states, stored).collect()}
    assert got == {1: ("p", "layer2", 2, "running", 66.67, False), 2: ("", "completed", 3, "completed", 50.0, True), 3: ("q", "layer1_x", 1, "paused", 33.33, False), 4: ("r", "init", 0, "pending", 0.0, False)}


def test_rebuilt_events_and_history(spark):
    s = spark.createDataFrame([(1, "layer2", True, 2), (2, "layer1", False, None), (3, "completed", None, None)], "session_id int, phase string, pause_after_step boolean, previous_layer int")
    done = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "c"), (1, 3, "d"), (1, 3, "e"), (2, 1, "a"), (3, 1, "a"), (3, 1, "b")], "session_id int, layer int, dimension_key string")
    reports = spark.createDataFrame([(1, 1, "b", "x" * 51), (1, 1, "a", "x" * 50), (1, 2, "c", "x" * 99), (3, 1, "a", "x" * 70)], "session_id int, layer int, dimension_key string, content string")
    layers = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "layer int, expected int")
    out = T.rebuilt(s, done, reports, layers)
    got = sorted((r["session_id"], r["position"], r["type"], r["layer"], r["dimension_key"], r["report_count"], r["total_chars"]) for r in out.collect())
    assert got == [
        (1, 1, "layer_completed", 1, None, 2, 101),
        (1, 2, "dimension_complete", 1, "b", None, None),
        (1, 3, "pause", 2, None, None, None),
        (3, 1, "layer_completed", 1, None, 0, 0),
    ]
    stored = spark.createDataFrame([(1, 4, "resumed", 1), (1, 5, "resumed", 1), (1, 6, "x", 1), (3, 1, "layer_completed", 1)], "session_id int, seq int, type string, layer int")
    history = sorted((r["session_id"], r["position"], r["type"]) for r in T.restored_history(stored, out, most=2).collect())
    assert history == [(1, 1, "resumed"), (1, 2, "x"), (1, 3, "layer_completed"), (1, 4, "dimension_complete"), (1, 5, "pause"), (3, 1, "layer_completed")]


def test_cache_after_a_change_of_layer(spark):
    kinds = ["layer_started", "dimension_start", "dimension_complete", "layer_completed", "layer_started", "dimension_start", "layer_started", "dimension_complete"]
    layers = [1, 1, 1, 1, 2, 2, 3, 3]
    e = spark.createDataFrame([(1, n, k, x) for n, (k, x) in enumerate(zip(kinds, layers))] + [(2, 0, "dimension_start", 1)], "s int, seq int, type string, layer int")
    got = sorted((r["s"], r["seq"]) for r in T.cached_events(e, "s", "seq", "type", "layer").collect())
    assert got == [(1, 3), (1, 6), (1, 7), (2, 0)]


def test_events_of_sessions_are_dealt_in_fixed_shares(spark):
    from stratiform.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = plan("rebuilt_events")
    assert "REPARTITION_BY_NUM" in dealt and str(T.SHARES) in dealt
    # the texts of reports are measured where they are read
    assert "AS content#" not in dealt
    assert "REPARTITION_BY_NUM" in plan("restored_history")
