"""Idempotent fold of a session's events into its state: in order over a table, and as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Dimensions of each layer, which an event may override (fixed values).
LAYER_SIZES = {1: 12, 2: 4, 3: 12}

State = dict[str, Any]
Data = dict[str, Any]


def new_state() -> State:
    """A session before its first event. Scalars, small lists and maps; no text but the reports'."""
    return {
        "session": None, "last_seq": 0, "status": "idle", "phase": "init", "wave": 1, "pause": False, "previous_layer": 0, "execution_paused": False,
        "executing": [], "sizes": {}, "checkpoints": {}, "tools": {}, "rag": {}, "cascade": None, "resetting": [], "versions": {}, "gis": {}, "rag_layers": {},
        "messages": {}, "progress": {}, "reports": {},
    }


def _place(d: Data) -> tuple[int, str, str]:
    layer, dim = d.get("layer") or 1, d.get("dimension_key") or ""
    return layer, dim, f"{layer}_{dim}"


def _message(s: State, name: str, kind: str) -> bool:
    """Note a message once; whether it is new."""
    new = name not in s["messages"]
    if new:
        s["messages"][name] = kind
    return new


def _pause(s: State, **now: Any) -> None:
    s.update(status="paused", **now)


def _connected(s: State, d: Data) -> None:
    s["status"] = "planning"
    s["session"] = s["session"] or d.get("task_id")


def _dimension_error(s: State, d: Data) -> None:
    _, _, key = _place(d)
    s["progress"][key] = {"status": "failed", "words": 0, "error": d.get("error") or "Unknown error"}
    s["executing"] = [k for k in s["executing"] if k != key]


def _dimension_start(s: State, d: Data) -> None:
    _, dim, key = _place(d)
    revision = bool(d.get("is_revision"))
    s["executing"].append(key)
    s["progress"][key] = {"status": "streaming", "words": 0, "revision": revision}
    if revision and dim:
        _message(s, f"revision_{key}", "streaming")


def _dimension_delta(s: State, d: Data) -> None:
    _, dim, key = _place(d)
    text = d.get("accumulated")
    if not text:
        return
    progress = s["progress"].get(key)
    if d.get("is_revision") and dim:  # a revision's text is shown apart until it is complete
        if progress:
            progress["words"] = len(text)
        return
    if dim:
        s["reports"][key] = text
    if progress:
        progress["words"] = len(text)
    else:  # a listener that came late
        s["progress"][key] = {"status": "streaming", "words": len(text)}
        if key not in s["executing"]:
            s["executing"].append(key)


def _dimension_complete(s: State, d: Data) -> None:
    layer, dim, key = _place(d)
    text = d.get("full_content") or s["reports"].get(key, "")
    revision = bool(d.get("is_revision"))
    s["progress"][key] = {"status": "completed", "words": d.get("word_count") or len(text), "revision": revision}
    s["executing"] = [k for k in s["executing"] if k != key]
    s["reports"][key] = text
    if revision and dim:
        if f"revision_{key}" in s["messages"]:
            s["messages"][f"revision_{key}"] = "completed"
        return
    s["phase"] = f"layer{layer}"
    done = sum(k.startswith(f"{layer}_") for k in s["reports"])
    size = s["sizes"].get(str(layer)) or LAYER_SIZES.get(layer, 0)
    if 0 < size <= done and not s["pause"] and s["status"] != "paused":
        _pause(s, pause=True, previous_layer=layer)


def _layer_started(s: State, d: Data) -> None:
    layer = d.get("layer") or d.get("layer_number") or 1
    s["phase"] = f"layer{layer}"
    if d.get("dimension_count"):
        s["sizes"][str(layer)] = d["dimension_count"]
    s["progress"] = {k: v for k, v in s["progress"].items() if not k.startswith(f"{layer}_")}
    s["executing"] = [k for k in s["executing"] if not k.startswith(f"{layer}_")]
    _message(s, f"layer_{layer}", "report")


def _layer_completed(s: State, d: Data) -> None:
    layer = d.get("layer") or 1
    s["session"] = s["session"] or d.get("task_id")
    given = d.get("dimension_reports")
    for dim, text in (given or {}).items():
        s["reports"][f"{layer}_{dim}"] = text
        s["progress"][f"{layer}_{dim}"] = {"status": "completed", "words": len(text or "")}
    if given is not None:
        s["executing"] = [k for k in s["executing"] if not k.startswith(f"{layer}_")]
    s["phase"] = d.get("phase") or s["phase"]
    pick = lambda name, old: old if d.get(name) is None else d[name]
    _pause(s, pause=pick("pause_after_step", s["pause"]), previous_layer=pick("previous_layer", s["previous_layer"]))


def _pause_event(s: State, d: Data) -> None:
    layer = d.get("current_layer") or d.get("previous_layer") or 0
    s["session"] = s["session"] or d.get("task_id")
    _pause(s, pause=True, previous_layer=layer or s["previous_layer"])
    if d.get("checkpoint_id") and layer > 0 and str(layer) not in s["checkpoints"]:
        s["checkpoints"][str(layer)] = {"id": d["checkpoint_id"], "kind": "key"}


def _checkpoint_saved(s: State, d: Data) -> None:
    layer, ident = d.get("layer") or 0, d.get("checkpoint_id") or ""
    if str(layer) in s["checkpoints"] or (ident and layer > 0):
        s["checkpoints"][str(layer)] = {"id": ident, "kind": "key" if d.get("checkpoint_type") == "key" else "regular", "revision": bool(d.get("is_revision"))}


def _tool(s: State, d: Data) -> Data | None:
    return s["tools"].get(d.get("tool_name") or "")


def _tool_call(s: State, d: Data) -> None:
    if d.get("tool_name"):
        s["tools"][d["tool_name"]] = {"status": "running", "stage": d.get("stage"), "message": d.get("description")}


def _tool_started(s: State, d: Data) -> None:
    if d.get("tool_name"):
        _message(s, f"tool_{d['tool_name']}_{s['last_seq']}", "tool")
        s["tools"][d["tool_name"]] = {"status": "running", "message": d.get("description")}


def _tool_progress(s: State, d: Data) -> None:
    if tool := _tool(s, d):
        tool.update(stage=d.get("stage") or tool.get("stage"), progress=d.get("progress"), message=d.get("message"))


def _tool_result(s: State, d: Data) -> None:
    if tool := _tool(s, d):
        tool.update(status="error" if d.get("status") == "error" else "success", summary=d.get("summary"))


def _tool_status(s: State, d: Data) -> None:
    if tool := _tool(s, d):
        tool["status"] = d["status"] if d.get("status") in ("error", "success") else "running"
        tool.update({name: d[source] for name, source in (("stage", "stage"), ("message", "stage_message"), ("summary", "summary")) if d.get(source)})
        if d.get("progress") is not None:
            tool["progress"] = d["progress"]


def _rag_query(s: State, d: Data) -> None:
    _, dim, key = _place(d)
    if dim and d.get("query"):
        s["rag"][key] = {"query": d["query"], "documents": s["rag"].get(key, {}).get("documents", 0)}


def _rag_result(s: State, d: Data) -> None:
    _, dim, key = _place(d)
    if dim:
        s["rag"][key] = {"query": d.get("query") or "", "documents": len(d.get("documents") or [])}


def _cascade_impact(s: State, d: Data) -> None:
    if d.get("trigger_dim") and d.get("impacted_dimensions") is not None:
        s["cascade"] = {"trigger": d["trigger_dim"], "impacted": d["impacted_dimensions"]}


def _dimension_reset(s: State, d: Data) -> None:
    _, dim, key = _place(d)
    if dim:
        if key not in s["resetting"]:
            s["resetting"].append(key)
        s["versions"][key] = s["versions"].get(key, 0) + 1


def _dimension_reset_complete(s: State, d: Data) -> None:
    s["resetting"] = [k for k in s["resetting"] if k != _place(d)[2] or not d.get("dimension_key")]


def _state_sync(s: State, d: Data) -> None:
    s["phase"], s["wave"] = d.get("phase") or s["phase"], d.get("current_wave") or s["wave"]
    s.update({name: d[source] for name, source in (("pause", "pause_after_step"), ("previous_layer", "previous_layer")) if d.get(source) is not None})


def _gis_result(s: State, d: Data) -> None:
    if d.get("dimension_key"):
        _message(s, f"gis_{d['dimension_key']}_{s['last_seq']}", "gis")


def _gis_layer_update(s: State, d: Data) -> None:
    if d.get("layers") is not None:
        s["gis"][f"{d.get('layer')}_{d.get('dimension_key')}"] = len(d["layers"])


#: What each kind of event does; kinds that are not here leave the state as it is.
KINDS: dict[str, Callable[[State, Data], None]] = {
    "connected": _connected,
    "completed": lambda s, d: s.update(status="completed"),
    "dimension_error": _dimension_error,
    "dimension_start": _dimension_start,
    "dimension_delta": _dimension_delta,
    "dimension_complete": _dimension_complete,
    "layer_started": _layer_started,
    "layer_completed": _layer_completed,
    "layer_paused": lambda s, d: _pause(s, execution_paused=True, pause=True),
    "execution_resumed": lambda s, d: s.update(execution_paused=False, pause=False, status="planning"),
    "tool_call": _tool_call,
    "tool_progress": _tool_progress,
    "tool_result": _tool_result,
    "tool_started": _tool_started,
    "tool_status": _tool_status,
    "gis_result": _gis_result,
    "ai_response_complete": lambda s, d: _message(s, f"ai_{s['last_seq']}", "text"),
    "pause": _pause_event,
    "resumed": lambda s, d: s.update(pause=False, previous_layer=0, status="planning"),
    "revision_completed": lambda s, d: _pause(s, pause=True, previous_layer=d.get("previous_layer") or d.get("layer") or 0),
    "checkpoint_saved": _checkpoint_saved,
    "rag_query": _rag_query,
    "rag_result": _rag_result,
    "cascade_impact": _cascade_impact,
    "cascade_complete": lambda s, d: s.update(cascade=None),
    "dimension_reset": _dimension_reset,
    "dimension_reset_complete": _dimension_reset_complete,
    "state_sync": _state_sync,
    "gis_layer_update": _gis_layer_update,
    "rag_config_updated": lambda s, d: s.update(rag_layers=d["rag_layer_config"]) if d.get("rag_layer_config") else None,
}


def apply(s: State, seq: int, kind: str, data: str | None) -> None:
    """Fold one event into a state; one whose number is not beyond the last is a repeat and does nothing."""
    if seq <= s["last_seq"]:
        return
    s["last_seq"] = seq
    if kind in KINDS:
        KINDS[kind](s, json.loads(data) if data else {})


def summary(s: State) -> tuple:
    """What is told of a state: its main fields, derived ones, and all of it as JSON with sorted names."""
    paused = s["pause"] or s["status"] == "paused"
    waiting = s["previous_layer"] if paused and s["previous_layer"] > 0 else None
    phase = s["phase"][5:6] if s["phase"].startswith("layer") else ""
    layer = waiting or (int(phase) if phase.isdigit() else None)
    done = [sum(k.startswith(f"{n}_") for k in s["reports"]) for n in LAYER_SIZES]
    told = s | {"executing": sorted(s["executing"])}  # a set in effect: its order tells nothing
    return s["last_seq"], s["status"], s["phase"], paused, waiting, layer, len(set(s["executing"])), *done, json.dumps(told, sort_keys=True, ensure_ascii=False)


COLUMNS = "last_seq long, status string, phase string, is_paused boolean, review_layer int, current_layer int, executing int, done_1 int, done_2 int, done_3 int, state string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def compacted(events: DataFrame, session: str) -> DataFrame:
    """Events without deltas that a later one of the same dimension replaces before anything else happens to it.

    The first delta of a dimension stays, as from it on the dimension counts as begun, and so does
    the last of each run; texts grow with every delta, so most of a session's bytes go here,
    dealt by dimension and not by session.
    """
    place = [F.col(session), F.coalesce(F.get_json_object("data", "$.layer"), F.lit("1")), F.get_json_object("data", "$.dimension_key")]
    by = Window.partitionBy(*place).orderBy("seq")
    revision = F.coalesce(F.get_json_object("data", "$.is_revision"), F.lit("false"))
    text = F.length(F.get_json_object("data", "$.accumulated")) > 0
    delta = (F.col("type") == "dimension_delta") & F.coalesce(text, F.lit(False))
    out = events.withColumn("_d", F.when(delta, revision))
    same = F.lead("_d").over(by).eqNullSafe(F.col("_d")) & F.lag("_d").over(by).eqNullSafe(F.col("_d"))
    keep = F.col("_d").isNull() | ~F.coalesce(same, F.lit(False))
    return out.withColumn("_keep", keep).where("_keep").drop("_keep", "_d")


def fold_sessions(events: DataFrame, session: str) -> DataFrame:
    """State of each session after all its events (session, seq, type, data), by number; repeats do nothing.

    Rows are sorted in their partitions and folded as they pass: a task holds one state at a time,
    whatever the number of events. ``data`` is JSON, null for none; a null number is 0, which no
    state is behind, so such events do nothing. A null session is one of its own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state: State | None = None

        def told(done: list[tuple]) -> pa.RecordBatch:
            rows = [dict(zip([session, *NAMES], (k, *summary(s)))) for k, s in done]
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            done: list[tuple] = []
            for key, seq, kind, data in zip(*(batch.column(c).to_pylist() for c in (session, "seq", "type", "data"))):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = key, new_state()
                apply(state, seq or 0, kind, data)
            if done:
                yield told(done)
        if state is not None:
            yield told([(now, state)])

    kind = events.schema[session].dataType.simpleString()
    out = f"{session} {kind}, {COLUMNS}"
    schema = to_arrow_schema(events.sparkSession.createDataFrame([], out).schema)
    rows = compacted(events.select(session, F.col("seq").cast("long").alias("seq"), "type", "data"), session)
    return rows.repartition(session).sortWithinPartitions(session, "seq").mapInArrow(scan, out)


class FoldProcessor(StatefulProcessor):
    """Fold of a stream: events are applied in the order of their numbers, and each once.

    Value state holds all but progress and reports, which are map states by dimension, so an event
    writes little; events that come before their turn wait in a list state until the ones before
    them have come, as numbers of a session follow each other from 1.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "core string")
        self.maps = {name: handle.getMapState(name, "name string", "value string") for name in ("progress", "reports")}
        self.waiting = handle.getListState("waiting", "seq long, type string, data string")

    def _load(self) -> State:
        s = new_state() | (json.loads(self.core.get()[0]) if self.core.exists() else {})
        for name, kept in self.maps.items():
            s[name] = {k[0]: json.loads(v[0]) for k, v in kept.iterator()} if kept.exists() else {}
        return s

    def _save(self, s: State, before: dict[str, dict]) -> None:
        self.core.update((json.dumps({k: v for k, v in s.items() if k not in self.maps}),))
        for name, kept in self.maps.items():
            new = {k: json.dumps(v) for k, v in s[name].items()}
            for k in before[name].keys() - new.keys():
                kept.removeKey((k,))
            for k, v in new.items():
                if before[name].get(k) != v:
                    kept.updateValue((k,), (v,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        before = {name: {k: json.dumps(v) for k, v in s[name].items()} for name in self.maps}
        held = {r[0]: (r[1], r[2]) for r in self.waiting.get()} if self.waiting.exists() else {}
        held |= {r["seq"]: (r["type"], r["data"]) for r in rows if r["seq"] and r["seq"] > s["last_seq"]}
        while (turn := s["last_seq"] + 1) in held:
            apply(s, turn, *held.pop(turn))
        self._save(s, before)
        if held:
            self.waiting.put([(n, *held[n]) for n in sorted(held)])
        elif self.waiting.exists():
            self.waiting.clear()
        yield Row(**dict(zip([self.session, *NAMES], (key[0], *summary(s)))))

    def __init__(self, session: str) -> None:
        self.session = session

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, session: str) -> DataFrame:
    """The stream twin of ``fold_sessions``: the state of each session that had events, after each micro-batch.

    The session must run with the RocksDB state store. An event that never comes holds up those
    after it; what has come is told all the same, up to the gap.
    """
    kind = events.schema[session].dataType.simpleString()
    rows = events.select(session, F.col("seq").cast("long").alias("seq"), "type", "data")
    return rows.groupBy(session).transformWithState(FoldProcessor(session), f"{session} {kind}, {COLUMNS}", "Update", "None")


def described(**fields: Column) -> Column:
    """Data of an event as JSON, fields that are null left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
