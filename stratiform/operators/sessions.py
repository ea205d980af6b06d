"""Transitions of planning sessions over stored tables: completion, approval, rejection, status, rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Phases in their order, and the least length of a text that counts as a report (fixed values).
PHASES = ["init", "layer1", "layer2", "layer3", "completed"]
REBUILT = 50
#: Shares that events of sessions are dealt over.
SHARES = 256
UPDATES = ("phase", "execution_paused", "pause_after_step", "previous_layer", "is_revision")


def layer_of(phase: Column) -> Column:
    """Layer of a phase: 0 before the first, null once completed or where unknown; ``layer2_...`` is of layer 2."""
    number = F.regexp_extract(phase, "^layer([123])(_|$)", 1)
    return F.when(phase == "init", 0).when(number != "", number.cast("int"))


def next_phase(phase: Column) -> Column:
    """The phase after one, null after the last and for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in zip(PHASES, PHASES[1:]) for x in pair])[phase]


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def completion(sessions: DataFrame) -> DataFrame:
    """Sessions after the check that follows each round of finished dimensions.

    Reads session_id, phase, step_mode, is_revision, execution_paused, pause_after_step,
    previous_layer, ``finished`` (dimensions done in the session's layer), ``expected`` (all of
    it), ``impacted`` and ``revised`` (dimensions of a revision: all, and done). Adds ``outcome``,
    the first that holds: ``revision_complete`` (sets equal), ``revising``, ``ended`` (phase
    completed or unknown), ``incomplete`` (no dimensions expected, or sets differ), ``paused``
    (step mode), ``advanced`` (to the next layer) or ``completed``; updates the state by it, with
    ``clear_pending`` where buffered reports have been written, ``last_revised`` and ``events``,
    the kinds that a listener is sent. Null flags count as false, null lists as empty.
    """
    none = F.array().cast("array<string>")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    items = lambda c: F.coalesce(F.col(c), none)
    layer, later = layer_of(F.col("phase")), next_phase(F.col("phase"))
    outcome = (
        F.when(flag("is_revision") & same_set(items("impacted"), items("revised")), "revision_complete")
        .when(flag("is_revision"), "revising")
        .when(layer.isNull(), "ended")
        .when((F.size(items("expected")) == 0) | ~same_set(items("finished"), items("expected")), "incomplete")
        .when(flag("step_mode"), "paused")
        .when((layer < 3) & later.isNotNull(), "advanced")
        .otherwise("completed")
    )
    out = sessions.withColumns({"outcome": outcome, "_layer": layer, "_next": later})
    o = F.col("outcome")
    done, went = o.isin("paused", "advanced", "completed"), o.isin("paused", "advanced")
    kinds = F.when(o == "paused", F.array(F.lit("layer_completed"), F.lit("layer_paused"))).when(o == "advanced", F.array(F.lit("layer_completed"), F.lit("layer_started"))).when(o == "completed", F.array(F.lit("layer_completed")))
    new = {
        "events": F.coalesce(kinds, none),
        "clear_pending": done | (o == "revision_complete"),
        "last_revised": F.when(o == "revision_complete", items("impacted")),
        "is_revision": flag("is_revision") & (o != "revision_complete"),
        "execution_paused": F.when(went, o == "paused").otherwise(flag("execution_paused")),
        "pause_after_step": F.when(went, o == "paused").otherwise(flag("pause_after_step")),
        "previous_layer": F.when(went, F.col("_layer")).otherwise(F.coalesce("previous_layer", F.lit(0))),
        "phase": F.when(o == "advanced", F.col("_next")).when(o == "completed", "completed").otherwise(F.col("phase")),
    }
    return out.withColumns(new).drop("_layer", "_next")


def flushed(sessions: DataFrame, pending: DataFrame) -> DataFrame:
    """Buffered reports (session_id, layer, dimension_key, ...) that the check writes to the store.

    ``sessions`` is what ``completion`` returns. A revision writes those of impacted dimensions
    whether it is complete or not, as the next wave reads them; a completed layer writes its own.
    """
    layer = F.when(F.col("outcome").isin("paused", "advanced"), F.col("previous_layer")).when(F.col("outcome") == "completed", 3)
    s = sessions.select("session_id", layer.alias("_layer"), F.when(F.col("outcome").isin("revising", "revision_complete"), F.col("impacted")).alias("_dims"))
    kept = (F.col("layer") == F.col("_layer")) | F.array_contains("_dims", F.col("dimension_key"))
    return pending.join(s, "session_id").where(kept).drop("_layer", "_dims")


def decided(sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions after reviews (session_id, action, feedback, dimensions): one of each session, else none.

    ``approve`` clears the pause, starts the next phase at wave 1 and sets status ``running``.
    ``reject`` needs feedback: the session revises the dimensions (an empty list: all that the
    feedback concerns), status ``revising``, its error goes. ``answer`` tells what came of it:
    ``approved``, ``rejected``, ``feedback required`` or null; without a decision nothing changes.
    """
    d = decisions.select("session_id", "action", F.coalesce("feedback", F.lit("")).alias("_feedback"), F.coalesce("dimensions", F.array().cast("array<string>")).alias("_dims"))
    out = sessions.join(d, "session_id", "left")
    answer = F.when(F.col("action") == "approve", "approved").when((F.col("action") == "reject") & (F.col("_feedback") != ""), "rejected").when(F.col("action") == "reject", "feedback required")
    out = out.withColumn("answer", answer)
    yes, no = F.col("answer").eqNullSafe(F.lit("approved")), F.col("answer").eqNullSafe(F.lit("rejected"))
    new = {
        "pause_after_step": F.when(yes | no, False).otherwise(F.col("pause_after_step")),
        "previous_layer": F.when(yes, 0).otherwise(F.col("previous_layer")),
        "current_wave": F.when(yes, 1).otherwise(F.col("current_wave")),
        "is_revision": F.when(no, True).otherwise(F.col("is_revision")),
        "revision_targets": F.when(no, F.col("_dims")),
        "feedback": F.when(no, F.col("_feedback")),
        "status": F.when(yes, "running").when(no, "revising").otherwise(F.col("status")),
        "error": F.when(~no, F.col("error")),
        "phase": F.when(yes, F.coalesce(next_phase(F.col("phase")), F.col("phase"))).otherwise(F.col("phase")),
    }
    return out.withColumns(new).drop("action", "_feedback", "_dims")


#: Fields that a stored session gives where it has a row, and the state else, with what stands for none.
CONTEXT = {"project_name": "", "village_name": "", "province": "", "city": "", "county": "", "township": "", "planning_period": ""}


def status_view(states: DataFrame, stored: DataFrame) -> DataFrame:
    """Status of every stored session: its state's view, with the stored row's fields where it has one.

    ``stored`` (session_id, created_at and the ``CONTEXT`` fields) decides which sessions there
    are; ``states`` (session_id, phase, execution_paused, progress) may lack some, which are then
    before their first phase. A stored field that is null counts as empty.
    """
    s = states.select("session_id", F.col("phase").alias("_phase"), "execution_paused", F.col("progress").alias("_progress"))
    out = stored.join(s, "session_id", "left")
    phase = F.coalesce("_phase", F.lit("init"))
    layer = F.coalesce(layer_of(phase), F.when(phase == "completed", 3).otherwise(0))
    paused = F.coalesce("execution_paused", F.lit(False))
    status = F.when(phase == "completed", "completed").when(paused, "paused").when(phase == "init", "pending").otherwise("running")
    fields = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in CONTEXT.items() if c in stored.columns]
    progress = F.coalesce("_progress", layer / F.lit(3.0) * 100)
    return out.select("session_id", "created_at", *fields, phase.alias("phase"), layer.alias("current_layer"), status.alias("status"), progress.alias("progress"), (phase == "completed").alias("execution_complete"))


def rebuilt(sessions: DataFrame, completed: DataFrame, reports: DataFrame, layers: DataFrame) -> DataFrame:
    """Events of stored sessions as a listener would have got them: (session_id, position, type, layer, ...).

    ``sessions`` (session_id, phase, pause_after_step, previous_layer), ``completed`` (session_id,
    layer, dimension_key), ``reports`` (session_id, layer, dimension_key, content) and ``layers``
    (layer, expected). A layer that is reached, of which at least as many dimensions are done as
    expected, gives ``layer_completed`` with the number of its reports and of their characters,
    and then ``dimension_complete`` for each report beyond ``REBUILT`` characters, by key. A
    session that pauses ends with ``pause``. One whose phase has no layer (completed, unknown) has
    reached all of them, but its reports are not read: its layers come without any.
    """
    s = sessions.select("session_id", layer_of(F.col("phase")).alias("_reached"), F.coalesce("pause_after_step", F.lit(False)).alias("_pause"), F.coalesce("previous_layer", F.lit(1)).alias("_previous"))
    # each dimension of a layer once, so one that is named twice does not make a layer whole
    n = completed.select("session_id", "layer", "dimension_key").repartition(SHARES, "session_id", "layer").distinct().groupBy("session_id", "layer").agg(F.count(F.lit(1)).alias("_n"))
    whole = n.join(layers, "layer").where("_n >= expected").join(s, "session_id").where("_reached is null or layer <= _reached").select("session_id", "layer", "_reached")
    # only the lengths of reports are shuffled, and in shares of a fixed number: rows that pack well would else fill few tasks
    lengths = reports.select("session_id", "layer", "dimension_key", F.length("content").alias("chars")).repartition(SHARES, "session_id", "layer")
    r = lengths.join(whole.where("_reached is not null"), ["session_id", "layer"], "left_semi")
    totals = r.groupBy("session_id", "layer").agg(F.count(F.lit(1)).alias("_r"), F.coalesce(F.sum("chars"), F.lit(0)).alias("_c"))
    first = whole.join(totals, ["session_id", "layer"], "left").select(
        "session_id", F.lit("layer_completed").alias("type"), "layer", F.lit(None).cast("string").alias("dimension_key"), F.coalesce("_r", F.lit(0)).alias("report_count"), F.coalesce("_c", F.lit(0)).cast("long").alias("total_chars")
    )
    empty = [F.lit(None).cast("long").alias(c) for c in ("report_count", "total_chars")]
    each = r.where(F.col("chars") > REBUILT).select("session_id", F.lit("dimension_complete").alias("type"), "layer", F.col("dimension_key").cast("string").alias("dimension_key"), *empty)
    pause = s.where("_pause").select("session_id", F.lit("pause").alias("type"), F.col("_previous").alias("layer"), F.lit(None).cast("string").alias("dimension_key"), *empty)
    rank = F.when(F.col("type") == "pause", 1).otherwise(0)
    order = Window.partitionBy("session_id").orderBy(rank, "layer", F.when(F.col("type") == "layer_completed", 0).otherwise(1), "dimension_key")
    return first.unionByName(each).unionByName(pause).repartition(SHARES, "session_id").withColumn("position", F.row_number().over(order))


def restored_history(events: DataFrame, rebuilt_events: DataFrame, most: int = 5000) -> DataFrame:
    """What a new listener is sent: a session's stored events, and those rebuilt where it has no completed layer.

    ``events`` (session_id, seq, type, layer) come first, the last ``most`` of a session, then the
    rebuilt ones by position.
    """
    told = events.where("type = 'layer_completed'").select("session_id").distinct()
    extra = rebuilt_events.join(told, "session_id", "left_anti").select("session_id", F.lit(1).alias("_part"), F.col("position").cast("long").alias("_at"), "type", "layer")
    late = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    own = events.repartition(SHARES, "session_id").withColumn("_n", F.row_number().over(late)).where(F.col("_n") <= most).select("session_id", F.lit(0).alias("_part"), F.col("seq").cast("long").alias("_at"), "type", "layer")
    order = Window.partitionBy("session_id").orderBy("_part", "_at")
    return own.unionByName(extra).withColumn("position", F.row_number().over(order)).select("session_id", "position", "type", "layer")


def cached_events(events: DataFrame, session: str, seq: str, kind: str, layer: str) -> DataFrame:
    """Events still cached at a session's end.

    A ``layer_started`` clears the starts and completions of dimensions of all layers before it,
    and the ``layer_started`` of other layers; other kinds stay.
    """
    last = F.max(F.when(F.col(kind) == "layer_started", F.struct(F.col(seq).alias("at"), F.col(layer).alias("of")))).over(Window.partitionBy(session))
    now = events.withColumn("_now", last)
    gone = (F.col(kind).isin("dimension_start", "dimension_complete") & (F.col(seq) < F.col("_now.at"))) | ((F.col(kind) == "layer_started") & ~F.col(layer).eqNullSafe(F.col("_now.of")))
    return now.where(~F.coalesce(gone, F.lit(False))).drop("_now")
