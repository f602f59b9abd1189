"""Models: an isolation forest, boosted trees with calibration, and the registry of versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Rows of each tree's sample; all samples together bound what reaches the driver.
TREES, SAMPLE = 100, 256


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: the column that a node splits, its cut, its children, and depth at leaves."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, size: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.column, self.cut, self.left, self.right, self.depth, self.roots = [], [], [], [], [], []
        self.scale = float(_path(min(size, max(len(sample), 2)))) or 1.0
        for _ in range(trees):
            rows = sample[rng.permutation(len(sample))[:size]]
            self.roots.append(self._grow(rows, 0, int(np.ceil(np.log2(max(size, 2)))), rng))

    def _grow(self, rows: np.ndarray, depth: int, limit: int, rng: np.random.Generator) -> int:
        at = len(self.column)
        for part in (self.column, self.cut, self.left, self.right, self.depth):
            part.append(-1)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else np.empty(0, int)
        if depth >= limit or len(rows) <= 1 or not len(spread):
            self.depth[at] = depth + float(_path(len(rows)))
            return at
        c = int(rng.choice(spread))
        cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
        below = rows[:, c] < cut
        self.column[at], self.cut[at] = c, cut
        self.left[at], self.right[at] = self._grow(rows[below], depth + 1, limit, rng), self._grow(rows[~below], depth + 1, limit, rng)
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; more is stranger. All rows go down each tree together."""
        column, cut, left, right, depth = (np.array(v) for v in (self.column, self.cut, self.left, self.right, self.depth))
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(column[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(x[inner, column[node]] < cut[node], left[node], right[node])
            total += depth[at]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def fit_forest(rows: DataFrame, key: str, inputs: list[str], trees: int = TREES, size: int = SAMPLE) -> Forest:
    """A forest on ``trees * size`` rows at most, drawn by a hash of ``key``; missing inputs count as 0."""
    wanted = rows.select(F.xxhash64(key).alias("__order"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in inputs])
    drawn = wanted.orderBy("__order").limit(trees * size).select(*inputs).toArrow()
    sample = np.column_stack([drawn.column(c).to_numpy() for c in inputs]) if drawn.num_rows else np.zeros((1, len(inputs)))
    return Forest(sample, trees, size)


def score_forest(rows: DataFrame, key: str, inputs: list[str], forest: Forest) -> DataFrame:
    """``key`` and ``anomaly``: 1 for usual rows down to -1 for the strangest, for every row."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees * size leaves at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in inputs])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(1 - 2 * shared.value.raw(x))], [key, "anomaly"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in inputs]).mapInArrow(run, f"{key} {kind}, anomaly double")


def contamination_scores(scored: DataFrame, label: str, shares: list[float]) -> DataFrame:
    """``contamination``, ``threshold``, ``f1`` and ``best`` for each share of rows to be taken for strange.

    ``scored`` has ``anomaly`` (less is stranger) and a boolean ``label`` (null: false). A row is taken for strange if its score is
    under the share's percentile, interpolated. The best one has the largest F1, the first of equal ones; none has if all
    are 0. All shares come from the counts by score and one more pass; a row a share is all that is compared."""
    names = {f"__t{k}": c for k, c in enumerate(shares)}
    cuts = ranks.percentiles(scored, "anomaly", names)
    true, low = F.coalesce(F.col(label), F.lit(False)), {t: F.col("anomaly") < F.col(t) for t in names}
    sums = scored.crossJoin(F.broadcast(cuts)).agg(F.count_if(true).alias("__p"), *[F.max(t).alias(t) for t in names], *[F.count_if(low[t]).alias(f"{t}n") for t in names], *[F.count_if(low[t] & true).alias(f"{t}p") for t in names])  # one row joined
    f1 = lambda t: F.coalesce(F.try_divide(2.0 * F.col(f"{t}p"), F.col(f"{t}n") + F.col("__p")), F.lit(0.0))
    found = F.array(*[F.struct(F.lit(float(c)).alias("contamination"), F.col(t).alias("threshold"), f1(t).alias("f1")) for t, c in names.items()])
    rows = sums.select(found.alias("found")).select(F.array_max(F.transform("found", lambda x: x["f1"])).alias("__top"), F.posexplode("found").alias("__k", "x"), "found")
    first = F.array_position(F.transform("found", lambda x: x["f1"]), F.col("__top")) - 1
    return rows.select("x.*", ((F.col("__k") == first) & (F.col("__top") > 0)).alias("best"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight`` so that both labels weigh the same in all."""
    w = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = w.agg(F.sum("__n").alias("__all"), F.count("*").alias("__kinds"))
    table = w.crossJoin(total).select(label, (F.col("__all") / (F.col("__kinds") * F.col("__n"))).alias("weight"))  # a row for each label
    return rows.join(F.broadcast(table), label)


class RiskModel:
    """Gradient-boosted trees of MLlib with isotonic calibration; inputs that are missing count as 0."""

    def __init__(self, inputs: list[str], label: str = "label", trees: int = 10, depth: int = 3):
        self.inputs, self.label, self.trees, self.depth = inputs, label, trees, depth
        self.model = self.calibration = None

    def _assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in self.inputs])))

    def fit(self, rows: DataFrame, calibrate_on: DataFrame | None = None) -> RiskModel:
        """Train on weighted rows, and calibrate on others if they are given."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import IsotonicRegression

        weighted = class_weights(rows, self.label)
        gbt = GBTClassifier(labelCol=self.label, featuresCol="features", weightCol="weight", maxIter=self.trees, maxDepth=self.depth, seed=5)
        self.model = gbt.fit(self._assembled(weighted).select("features", F.col(self.label).cast("double").alias(self.label), "weight"))
        if calibrate_on is not None:
            raw = self._raw(calibrate_on).select(F.col(self.label).cast("double").alias(self.label), "raw")
            self.calibration = IsotonicRegression(labelCol=self.label, featuresCol="raw", predictionCol="risk").fit(raw)
        return self

    def _raw(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(self._assembled(rows)).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``raw`` and ``risk`` (0 to 1)."""
        scored = self._raw(rows)
        out = self.calibration.transform(scored) if self.calibration else scored.withColumn("risk", F.col("raw"))
        return out.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk"))))

    def importances(self) -> dict[str, float]:
        """Each input's importance."""
        return dict(zip(self.inputs, map(float, self.model.featureImportances.toArray()), strict=True))


def promoted(registry: DataFrame, model: str, version: str, at: Column) -> DataFrame:
    """The registry with a version in production and the one that was archived. ``registry`` has ``model``, ``version``,
    ``status`` and ``changed``."""
    mine = F.col("model") == model
    new, old = mine & (F.col("version") == version), mine & (F.col("version") != version) & (F.col("status") == "production")
    return registry.withColumns({"status": F.when(new, "production").when(old, "archived").otherwise(F.col("status")), "changed": F.when(new | old, at).otherwise(F.col("changed"))})


def rolled_back(registry: DataFrame, model: str, at: Column) -> DataFrame:
    """The version that was archived last back in production, and the one in production archived; nothing without one."""
    w = Window.partitionBy("model", "status").orderBy(F.col("changed").desc(), F.col("version").desc())
    mine, last = F.col("model") == model, F.row_number().over(w) == 1
    marked = registry.withColumns({"__back": mine & (F.col("status") == "archived") & last})
    there = F.max("__back").over(Window.partitionBy("model"))
    old = mine & (F.col("status") == "production") & F.col("__there")
    return marked.withColumn("__there", there).withColumns({"status": F.when(F.col("__back"), "production").when(old, "archived").otherwise(F.col("status")), "changed": F.when(F.col("__back") | old, at).otherwise(F.col("changed"))}).drop("__back", "__there")
