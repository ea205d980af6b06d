"""Dependency graph of planning dimensions: waves, impact, readiness, revision plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.settle import settled

# Phases, their dimensions in file order, and what each depends on within its phase,
# on the first layer, and on the phase before.
PHASES = {
    1: [
        ("location", [], [], []), ("socio_economic", [], [], []), ("villager_wishes", [], [], []), ("superior_planning", [], [], []),
        ("natural_environment", [], [], []), ("land_use", [], [], []), ("traffic", [], [], []), ("public_services", [], [], []),
        ("infrastructure", [], [], []), ("ecological_green", [], [], []), ("architecture", [], [], []), ("historical_culture", [], [], []),
    ],
    2: [
        ("resource_endowment", [], ["natural_environment", "land_use", "socio_economic", "historical_culture", "architecture", "public_services"], []),
        ("planning_positioning", ["resource_endowment"], ["location", "socio_economic", "superior_planning"], []),
        ("development_goals", ["resource_endowment", "planning_positioning"], ["socio_economic", "superior_planning"], []),
        ("planning_strategies", ["resource_endowment", "planning_positioning", "development_goals"], ["natural_environment", "land_use", "traffic", "infrastructure", "historical_culture"], []),
    ],
    3: [
        ("industry", [], ["socio_economic", "land_use"], ["resource_endowment", "planning_positioning", "planning_strategies"]),
        ("spatial_structure", [], ["natural_environment", "land_use"], ["planning_positioning", "planning_strategies"]),
        ("land_use_planning", [], ["land_use", "natural_environment"], ["planning_positioning", "planning_strategies"]),
        ("settlement_planning", [], ["socio_economic"], ["planning_positioning", "planning_strategies"]),
        ("traffic_planning", [], ["traffic"], ["planning_strategies"]),
        ("public_service", [], ["public_services", "socio_economic"], ["planning_strategies"]),
        ("infrastructure_planning", [], ["infrastructure"], ["planning_strategies"]),
        ("ecological", [], ["ecological_green"], ["planning_strategies"]),
        ("disaster_prevention", [], ["infrastructure", "architecture"], ["planning_positioning", "planning_strategies"]),
        ("heritage", [], ["historical_culture"], ["planning_positioning", "planning_strategies"]),
        ("landscape", [], ["architecture", "historical_culture"], ["planning_positioning", "planning_strategies"]),
        (
            "project_bank",
            ["industry", "spatial_structure", "land_use_planning", "settlement_planning", "traffic_planning", "public_service", "infrastructure_planning", "ecological", "disaster_prevention", "heritage", "landscape"],
            [],
            ["resource_endowment", "planning_positioning", "development_goals", "planning_strategies"],
        ),
    ],
}
KINDS = ("depends_on", "layer_depends_on", "phase_depends_on")

DIMENSIONS = [(key, layer, pos) for layer, dims in PHASES.items() for pos, (key, *_) in enumerate(dims)]
EDGES = [(src, key, kind) for dims in PHASES.values() for key, *deps in dims for kind, sources in zip(KINDS, deps) for src in sources]


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSIONS, "key string, layer int, pos int")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, dst string, kind string")


def waves(dims: DataFrame, deps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Wave of each dimension: 1 + the latest wave of what it depends on within its phase.

    Each round takes the dimensions that wait for none any more, so rounds are as many as there
    are waves and every edge is met once. Edges from what is no dimension do not count;
    dimensions on a cycle, or behind one, have no wave and no row. Columns of ``dims`` named in
    ``keep`` stay.
    """
    known = dims.select(F.col("key").alias("src"))
    left = settled(deps.filter("kind = 'depends_on'").select("src", "dst").distinct().join(known, "src", "left_semi"))
    todo = settled(dims.select("key", "layer", "pos", *keep))
    out, wave = None, 1
    while True:
        waiting = left.select(F.col("dst").alias("key")).distinct()
        free = settled(todo.join(waiting, "key", "left_anti").withColumn("wave", F.lit(wave)))
        if free.isEmpty():
            return out if out is not None else free
        out = free if out is None else out.unionByName(free)
        todo = settled(todo.join(waiting, "key", "left_semi"))
        left = settled(left.join(free.select(F.col("key").alias("src")), "src", "left_anti"))
        wave += 1


def impact(deps: DataFrame, targets: Sequence[str] | DataFrame) -> DataFrame:
    """What changes with each target: (target, key, level), the level of its first visit.

    ``targets`` is a list or a table (target). Breadth first: each round visits only what no
    earlier one did, so many paths cost nothing, and cycles end.
    """
    if isinstance(targets, DataFrame):
        front = targets.select("target", F.col("target").alias("key"), F.lit(0).alias("level")).distinct()
    else:
        front = deps.sparkSession.createDataFrame([(t, t, 0) for t in targets], "target string, key string, level int")
    step = settled(deps.select("src", "dst").distinct())
    seen = front = settled(front)
    while True:
        found = front.join(step, F.col("key") == F.col("src")).select("target", F.col("dst").alias("key"), (F.col("level") + 1).alias("level")).distinct()
        front = settled(found.join(seen.select("target", "key"), ["target", "key"], "left_anti"))
        if front.isEmpty():
            return seen.filter("key <> target")
        seen = seen.unionByName(front)


def direct_downstream(deps: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(src, n, downstream): what depends on each dimension by the given kinds of edge."""
    d = deps.filter(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    return d.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("downstream"))


def ready(dims: DataFrame, deps: DataFrame, completed: DataFrame) -> DataFrame:
    """Dimensions not completed whose every dependency is: an anti-join with unmet edges."""
    unmet = deps.join(completed.select(F.col("key").alias("src")), "src", "left_anti").select(F.col("dst").alias("key")).distinct()
    return dims.join(completed.select("key"), "key", "left_anti").join(unmet, "key", "left_anti")


def dispatch(dims: DataFrame, deps: DataFrame, completed: DataFrame, layer: int, step_mode: bool = False) -> DataFrame:
    """Ready dimensions of the layer, and of the next one where its own dependencies allow (not in step mode)."""
    found = ready(dims, deps, completed)
    return found.filter(F.col("layer") == layer if step_mode else F.col("layer").isin(layer, layer + 1))


def next_wave(levels: DataFrame, completed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All dimensions of the first wave that has an unfinished one, of each value of ``by``."""
    first = levels.join(completed.select("key"), "key", "left_anti").groupBy(*by).agg(F.min("wave").alias("_first"))
    joined = levels.join(first, list(by)) if by else levels.crossJoin(F.broadcast(first))  # a single row
    return joined.filter("wave = _first").drop("_first")


def revision_plan(deps: DataFrame, targets: Sequence[str] | DataFrame, completed: DataFrame) -> DataFrame:
    """(key, wave): targets in wave 0, what they change in the latest wave any target gives, completed only."""
    tree = impact(deps, targets).groupBy("key").agg(F.max("level").alias("wave"))
    if isinstance(targets, DataFrame):
        zero = targets.select(F.col("target").alias("key"), F.lit(0).alias("wave")).distinct()
    else:
        zero = deps.sparkSession.createDataFrame([(t, 0) for t in targets], "key string, wave int")
    rest = tree.join(zero, "key", "left_anti").join(completed.select("key"), "key", "left_semi")
    return zero.unionByName(rest.select("key", F.col("wave").cast("int").alias("wave")))


def layers_complete(dims: DataFrame, completed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per layer (and ``by``): all and finished dimensions, and whether the sets are equal."""
    done = dims.join(completed.select("key").distinct().withColumn("_done", F.lit(1)), "key", "left")
    return done.groupBy(*by, "layer").agg(F.count(F.lit(1)).alias("n"), F.count("_done").alias("n_done")).withColumn("complete", F.col("n") == F.col("n_done"))


def first_pending(dims: DataFrame, completed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pending dimension of each layer (and ``by``) that stands first in the file."""
    return dims.join(completed.select("key"), "key", "left_anti").groupBy(*by, "layer").agg(F.min_by("key", F.struct("pos", "key")).alias("key"))
