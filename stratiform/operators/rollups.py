"""Roll-ups and merges of reports, layers, stats and sessions: built-in aggregates and joins throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def availability(flags: Sequence[Column]) -> Column:
    """Share of layers that are there."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)) / len(flags)


def distance_stats(pairs: DataFrame, by: Sequence[str], distance: str = "distance", times: str | None = None) -> DataFrame:
    """Least, mean and greatest distance of each group; ``times`` tells how many pairs a row stands for."""
    mean = F.sum(F.col(distance) * F.col(times)) / F.sum(times) if times else F.avg(distance)
    return pairs.groupBy(*by).agg(F.min(distance).alias("least"), mean.alias("mean"), F.max(distance).alias("most"))


def overall(stats: DataFrame, n: str, empty: str, latency_sum: str) -> DataFrame:
    """One row from rows of sums: rates from the sums, never means of means."""
    s = stats.agg(F.sum(n).alias("n"), F.sum(empty).alias("n_empty"), F.sum(latency_sum).alias("_l"))
    rate = lambda c: F.coalesce(c / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return s.select("n", "n_empty", (rate(F.col("n_empty")) * 100).alias("empty_rate"), rate(F.col("_l")).alias("mean_latency"))


def by_rate(stats: DataFrame, rate: str, tie: str) -> DataFrame:
    """Rows with their rank by a rate, the highest first: a report of all groups (there are few)."""
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rate), tie)))


def strategies(articles: DataFrame, plan: str, strategy: str, content: str, open_mark: str) -> DataFrame:
    """Articles of each plan by strategy, and how many are written: those without the mark of an open one."""
    done = F.count_if(~F.coalesce(F.col(content), F.lit("")).contains(open_mark))
    return articles.groupBy(plan, strategy).agg(F.count(F.lit(1)).alias("n"), done.alias("n_done"))


def keyword_ratios(text: Column, positive: Sequence[str], negative: Sequence[str]) -> tuple[Column, Column]:
    """Share of wanted words in a text, and of unwanted ones; 0 for an empty list."""
    share = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) / max(len(words), 1)
    return share(positive), share(negative)


def first_layer_text(keys: DataFrame, layers: Sequence[DataFrame], key: str, text: str) -> DataFrame:
    """Text of each key from the first layer that has one; an empty text is none, and keys without any go."""
    out = keys.select(key)
    for i, layer in enumerate(layers):
        out = out.join(layer.filter(F.length(text) > 0).select(F.col(key).alias(f"_k{i}"), F.col(text).alias(f"_t{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    return out.select(key, F.coalesce(*[F.col(f"_t{i}") for i in range(len(layers))]).alias(text)).filter(F.col(text).isNotNull())


def later_layers_win(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several layers as one, a key's row that of the last layer that has it."""
    merged = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(i + 1))
        merged = part if merged is None else merged.unionByName(part)
    rest = [c for c in merged.columns if c != key]
    return merged.groupBy(key).agg(F.max_by(F.struct(*rest), "layer").alias("_r")).select(key, "_r.*")


def union_with_counts(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of several sources with their source, repeats kept, and how many each has (0 as well)."""
    merged, counts = None, None
    for name, f in frames.items():
        part = f.withColumn("provider", F.lit(name))
        n = f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("provider"), "n")
        merged, counts = (part, n) if merged is None else (merged.unionByName(part), counts.unionByName(n))
    return merged, counts


def compared(baseline: DataFrame, revised: DataFrame, key: str, score: Column) -> DataFrame:
    """Score of each key's texts (columns old and new), 0 where the new one is missing or empty."""
    j = baseline.select(key, F.col("text").alias("old")).join(revised.select(key, F.col("text").alias("new")), key, "left")
    return j.withColumn("score", F.when(F.coalesce(F.length("new"), F.lit(0)) > 0, score).otherwise(0.0))


def latest_checkpoint(checkpoints: DataFrame, by: Sequence[str], time: str, ident: str) -> DataFrame:
    """The newest checkpoint of each group, of equals the last by id."""
    return checkpoints.groupBy(*by).agg(F.max_by(ident, F.struct(time, ident)).alias(ident), F.max(time).alias(time))


def checkpoint_lists(checkpoints: DataFrame, by: Sequence[str], time: str, ident: str) -> DataFrame:
    """Checkpoints of each group in order of time: a session has a few of each layer."""
    return checkpoints.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, ident))), lambda x: x[ident]).alias("checkpoints"))


def newest_report(projects: DataFrame, sessions: DataFrame, reports: DataFrame, project: str, session: str, created: str, key: str, version: str, value: str) -> DataFrame:
    """Reports of the newest session of each project, the highest version of each dimension, of equals the greatest value."""
    newest = projects.select(project).join(sessions, project).groupBy(project).agg(F.max_by(session, F.struct(created, session)).alias(session))
    best = reports.groupBy(session, key).agg(F.max(F.struct(version, value)).alias("_v")).select(session, key, F.col(f"_v.{value}").alias(value), F.col(f"_v.{version}").alias(version))
    return newest.join(best, session)


def switches(given: Column, current: Column, default: Column) -> Column:
    """A switch by layer: as given, else as it is, else the general one."""
    return F.coalesce(given, current, default)


def approved(phase: Column, next_phase: Column) -> dict[str, Column]:
    """Columns of a session after approval: it goes on with the next phase, from its first wave."""
    return {"pause_after_step": F.lit(False), "previous_layer": F.lit(0), "phase": F.coalesce(next_phase, phase), "current_wave": F.lit(1)}


def kept_parents(chunks: DataFrame, ingested: str, tie: str, most: int = 2000) -> DataFrame:
    """The ``most`` parents that came last: what a bounded cache still holds."""
    return chunks.orderBy(F.desc(ingested), F.desc(tie)).limit(most)


def without_source(chunks: DataFrame, gone: DataFrame, source: str) -> DataFrame:
    """Chunks of sources that are not deleted."""
    return chunks.join(gone.select(source).distinct(), source, "left_anti")


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor empty: nested defaults of an insert."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def planning_period(period: Column, default_year: int) -> Column:
    """(base year, target year) of "2024-2035": three years on where there is no second."""
    years = F.regexp_extract_all(F.coalesce(period, F.lit("")), F.lit(r"\d{4}"), F.lit(0))
    base = F.coalesce(F.try_element_at(years, F.lit(1)).cast("int"), F.lit(default_year))
    return F.struct(base.alias("base"), F.coalesce(F.try_element_at(years, F.lit(2)).cast("int"), base + 3).alias("target"))


def travel_minutes(metres: Column, kmh: Column) -> Column:
    return F.when(kmh > 0, metres / 1000.0 / F.nullif(kmh, F.lit(0.0)) * 60.0)


def place_names(text: Column) -> Column:
    """Names of a list: 2 to 6 characters, no words of direction, no counts; what follows a full stop is none."""
    parts = F.split(F.split(text, "。", -1)[0], "[、，,]", -1)
    # Words of direction, and names that are counts.
    fit = lambda x: F.length(x).between(2, 6) & ~F.regexp_like(x, F.lit(r"[至接靠连]|^\d+$"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), fit)


def summary_row(metric: Column, m1: Column, m2: Column, percent: Column, d: Column, p: Column, stars: Column) -> list[Column]:
    """A comparison as a report prints it: fixed decimals, a sign before the change."""
    signed = F.concat(F.when(percent >= 0, "+").otherwise(""), F.format_string("%.1f", percent), F.lit("%"))
    two = lambda c: F.format_string("%.2f", c)
    return [metric.alias("metric"), two(m1).alias("group1_mean"), two(m2).alias("group2_mean"), two(m1 - m2).alias("difference"), signed.alias("percent_change"), two(d).alias("cohens_d"), F.format_string("%.4f", p).alias("p_value"), stars.alias("significance")]


def cached_vectors(texts: DataFrame, cache: DataFrame, text: str, vector: Column) -> DataFrame:
    """(md5, vector) to append to a cache by text digest: distinct texts that it lacks, each computed once."""
    new = texts.select(F.md5(F.col(text).cast("binary")).alias("md5"), text).dropDuplicates(["md5"])
    return new.join(cache.select("md5"), "md5", "left_anti").select("md5", vector.alias("vector"))
