"""Monitoring of models and features: drift, degradation, contributions, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks


def feature_importance(rows: DataFrame, column: str, least: int = 3) -> DataFrame:
    """``feature``, ``mean_abs``, ``n`` from JSON objects of contributions; values that aren't plain numbers don't count, nor
    do features met less than ``least`` times."""
    found = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("feature", "value")).filter(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    return found.groupBy("feature").agg(F.avg(F.abs(F.col("value").cast("double"))).alias("mean_abs"), F.count("*").alias("n")).filter(F.col("n") >= least)


def feature_psi(rows: DataFrame, bins: int = 20, epsilon: float = 1e-8) -> DataFrame:
    """``feature`` and ``psi`` from ``rows`` of ``feature``, ``period`` ('base' or 'now') and ``x``.

    Bins are equal parts of the baseline's range, ends belonging to the outer ones; values outside don't count. Densities
    get ``epsilon`` and are scaled to 1. Only counts by feature and bin are shuffled."""
    ends = rows.filter("period = 'base' and x is not null").groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = rows.join(ends, "feature").filter(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy("feature", "lo", "hi", F.coalesce(place, F.lit(0)).alias("bin")).agg(*[F.count(F.when(F.col("period") == p, 1)).alias(p) for p in ("base", "now")])
    every = ends.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    full = every.join(counts.drop("lo", "hi"), ["feature", "bin"], "left").fillna(0, ["base", "now"])
    w = Window.partitionBy("feature")  # as many rows as there are bins
    density = lambda p: F.coalesce(F.try_divide(F.col(p), F.sum(p).over(w) * F.col("width")), F.lit(0.0)) + epsilon
    dense = full.select("feature", density("base").alias("b"), density("now").alias("n"))
    share = dense.select("feature", (F.col("b") / F.sum("b").over(w)).alias("b"), (F.col("n") / F.sum("n").over(w)).alias("n"))
    return share.groupBy("feature").agg(F.sum((F.col("n") - F.col("b")) * F.log(F.col("n") / F.col("b"))).alias("psi"))


def score_psi(rows: DataFrame, by: list[str], bins: int = 50, epsilon: float = 1e-8, least: int = 100) -> DataFrame:
    """``by`` and ``psi`` of scores from ``rows`` of ``by``, ``score`` and ``base`` (true for the baseline).

    Bins are equal parts of 0 to 1; scores outside don't count. Densities get ``epsilon`` and are scaled to 1. Null with fewer
    than ``least`` scores after the baseline. Only counts by bin are shuffled."""
    inside = rows.filter(F.col("score").between(0.0, 1.0)).groupBy(*by, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = inside.agg(F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("c"))
    wide = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("b", "c")))).alias("held"), F.sum("b").alias("all_b"), F.sum("c").alias("all_c"))  # a row a bin
    at = lambda k, name: F.coalesce(F.try_element_at("held", k)[name], F.lit(0))
    density = lambda name, total: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_divide(at(k, name) * float(bins), F.col(total)), F.lit(0.0)) + epsilon)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dense = wide.select(*by, "all_c", density("b", "all_b").alias("b"), density("c", "all_c").alias("c"))
    scaled = dense.select(*by, "all_c", total(F.col("b")).alias("sum_b"), total(F.col("c")).alias("sum_c"), "b", "c")
    terms = F.zip_with("b", "c", lambda b, c: (c / F.col("sum_c") - b / F.col("sum_b")) * F.log((c / F.col("sum_c")) / (b / F.col("sum_b"))))
    return scaled.select(*by, F.when(F.col("all_c") >= least, total(terms)).alias("psi"))


def drift_alerts(psi: DataFrame, warning: float = 0.1, critical: float = 0.5) -> DataFrame:
    """``metric``, ``severity``, ``value``, ``threshold`` for each feature that drifted."""
    hit = psi.filter(F.col("psi") > warning)
    return hit.select(F.concat(F.lit("feature_drift_"), "feature").alias("metric"), F.when(F.col("psi") > critical, "critical").otherwise("warning").alias("severity"), F.col("psi").alias("value"), F.lit(warning).alias("threshold"))


def prediction_alert(psi: DataFrame, by: list[str]) -> DataFrame:
    """The same for the scores of each of ``by``: critical over 0.25."""
    hit = psi.filter(F.col("psi") > 0.1)
    return hit.select(*by, F.lit("prediction_psi").alias("metric"), F.when(F.col("psi") > 0.25, "critical").otherwise("warning").alias("severity"), F.col("psi").alias("value"), F.lit(0.1).alias("threshold"))


def degradation_alerts(labelled: DataFrame, latencies: DataFrame, auc_floor: float = 0.75, latency_p95: float = 250.0) -> DataFrame:
    """``metric``, ``severity``, ``value``, ``threshold`` where discrimination is under its floor or the 95th percentile of
    latency (interpolated) over its limit."""
    low = ranks.auc(labelled).filter(F.col("auc") < auc_floor).select(F.lit("roc_auc").alias("metric"), F.when(F.col("auc") < auc_floor - 0.10, "critical").otherwise("warning").alias("severity"), F.col("auc").alias("value"), F.lit(auc_floor).alias("threshold"))
    slow = ranks.percentiles(latencies, "latency_ms", {"p95": 0.95}).filter(F.col("p95") > latency_p95)
    return low.union(slow.select(F.lit("p95_latency_ms"), F.lit("warning"), F.col("p95"), F.lit(latency_p95)))


def top_features(values: dict[str, Column], n: int, least: float) -> Column:
    """Names of the ``n`` values furthest from 0 that are over ``least`` away, furthest first, then by name."""
    items = F.array(*[F.struct((-F.abs(v)).alias("far"), F.lit(k).alias("name")) for k, v in values.items()])
    kept = F.filter(F.array_sort(items), lambda x: x["far"] < -least)
    return F.transform(F.slice(kept, 1, n), lambda x: x["name"])


def share_of(shares: Column, key: Column) -> Column:
    """A map's value for ``key``; 0 if it has none."""
    return F.coalesce(F.try_element_at(shares, key), F.lit(0.0))


def with_note(body: Column, field: str, note: Column, over: dict[str, Column]) -> Column:
    """A JSON object of strings with ``note`` appended to the array that ``field`` holds (as text), and other keys replaced."""
    held = F.from_json(body, "map<string,string>")
    notes = F.coalesce(F.from_json(F.try_element_at(held, F.lit(field)), "array<string>"), F.array().cast("array<string>"))
    new = {field: F.to_json(F.array_append(notes, note)), **over}
    rest = F.map_filter(held, lambda k, _: ~k.isin(*new))
    return F.to_json(F.map_concat(rest, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)])))


def first_metric(body: Column, names: list[str]) -> Column:
    """The first of ``names`` that the object under ``metrics`` has, as a number."""
    return F.coalesce(*[F.get_json_object(body, f"$.metrics.{n}").try_cast("double") for n in names])


def retrieved(rows: DataFrame, store: DataFrame, key: str, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``rows`` with each feature from ``store`` (a row for each key), else computed, else its default; ``missing`` names those
    that are defaults. ``wanted`` maps names to the computed column and the default."""
    held = store.select(key, *[F.col(n).alias(f"__{n}") for n in wanted])
    joined = rows.join(held, key, "left")
    known = {n: F.coalesce(F.col(f"__{n}"), computed) for n, (computed, _) in wanted.items()}
    missing = F.filter(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in known.items()]), lambda x: x.isNotNull())
    return joined.withColumn("missing", missing).withColumns({n: F.coalesce(c, F.lit(wanted[n][1])) for n, c in known.items()}).drop(*[f"__{n}" for n in wanted])
