"""Boosted trees on log sales: design matrix, fit, score, experiments, submission."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.functions.targets import closed_rule, from_log, money, to_log
from shelfcast.operators.panel import in_split, trading_days
from shelfcast.operators.scores import METRICS, evaluate, improvement
from shelfcast.operators.selection import CATEGORICAL, without
from shelfcast.operators.vocabulary import add_codes
from shelfcast.plans.boosting import Ensemble, TreeSettings, grow, node_table, trees_of
from shelfcast.plans.runs import append_run
from shelfcast.sources.staging import stage
from shelfcast.spec import PanelSpec

MISSING = -1.0
CODED = tuple(c for c in CATEGORICAL if c != "Store")


@dataclass(frozen=True)
class Variant:
    dropped: tuple[str, ...] = ()
    overrides: tuple[tuple[str, float], ...] = ()

    def settings(self, base: TreeSettings) -> TreeSettings:
        return replace(base, **dict(self.overrides))


# The experiments, by name, with the columns dropped and settings changed.
VARIANTS = {
    "full": Variant(),
    "no_lags": Variant(dropped=("lag_",)),
    "no_store": Variant(dropped=("Store",)),
    "no_dow_mean": Variant(dropped=("dow_mean_4", "dow_ratio")),
    "lr_0.03_leaves_256": Variant(overrides=(("learning_rate", 0.03), ("leaves", 256))),
    "lr_0.10_leaves_64": Variant(overrides=(("learning_rate", 0.10), ("leaves", 64))),
    "seed_1": Variant(overrides=(("seed", 1),)),
    "seed_2": Variant(overrides=(("seed", 2),)),
    "seed_3": Variant(overrides=(("seed", 3),)),
}
CHOSEN = "no_lags"
#: Runs that differ in nothing but the seed.
SEED_RUNS = ["full", "seed_1", "seed_2", "seed_3"]


def store_levels(train: DataFrame, smoothing: float) -> DataFrame:
    """Mean log sales per store, drawn to the overall mean where there are few days.

    It stands for the store in the trees, which cannot split thousands of categories.
    The last row, with a NULL store, is the level of a store not seen in training.
    """
    label = to_log(F.col("Sales"))
    sums = train.groupBy("Store").agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    known = sums.select("Store", ((F.col("s") + overall * smoothing) / (F.col("n") + smoothing)).alias("level"))
    unseen = sums.agg((F.sum("s") / F.sum("n")).alias("level")).select(
        F.lit(None).cast("int").alias("Store"), "level"
    )
    return known.unionByName(unseen)


def fold_of(seed: int, folds: int) -> Column:
    """The fold of a store's day, from a seeded digest: the same wherever the row lies."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), "Store", F.col("Date").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % folds


def fold_levels(train: DataFrame, smoothing: float, folds: int, seed: int) -> DataFrame:
    """(Store, fold, level): each store's level from the days that are not in the fold.

    A training row gets the level of its own fold, which its label is not in. One pass sums by
    store and fold; a level is the store's sums less the fold's.
    """
    label = to_log(F.col("Sales"))
    sums = train.groupBy("Store", fold_of(seed, folds).alias("fold")).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    sums = stage(sums, "fold-sums")
    of_fold = sums.groupBy("fold").agg(F.sum("s").alias("fold_s"), F.sum("n").alias("fold_n"))
    totals = of_fold.agg(F.sum("fold_s").alias("s"), F.sum("fold_n").alias("n"))
    s, n = totals.select("s").scalar(), totals.select("n").scalar()
    rest = F.coalesce(F.try_divide(s - F.col("fold_s"), n - F.col("fold_n")), s / n)
    others = of_fold.select("fold", rest.alias("overall"))
    store = Window.partitionBy("Store")  # a row for each fold
    left_s, left_n = F.sum("s").over(store) - F.col("s"), F.sum("n").over(store) - F.col("n")
    without_own = sums.select("Store", "fold", left_s.alias("s"), left_n.alias("n"))
    level = (F.col("s") + F.col("overall") * smoothing) / (F.col("n") + smoothing)
    return without_own.join(F.broadcast(others), "fold").select("Store", "fold", level.alias("level"))


@dataclass
class Design:
    """How feature rows become vectors: frozen vocabulary, levels and column order."""

    features: list[str]
    vocabulary: DataFrame
    levels: DataFrame
    nullable: list[str]
    sizes: dict[str, int]
    folds: DataFrame | None = None
    folding: tuple[int, int] | None = None

    @property
    def columns(self) -> list[str]:
        """Names of the vector's places."""
        return [*self.features, *[f"{c}_missing" for c in self.nullable]]

    def _input(self, name: str) -> Column:
        if name == "Store":
            return F.col("_level").alias(name)
        if name in self.sizes:
            # One category more than the vocabulary, for values it does not have.
            n = self.sizes[name]
            nominal = {"ml_attr": {"type": "nominal", "name": name, "num_vals": n + 1}}
            code = F.coalesce(F.col(f"{name}_code"), F.lit(n)).cast("double")
            return code.alias(name, metadata=nominal)
        value = F.col(name).cast("double")
        return F.coalesce(value, F.lit(MISSING)).alias(name) if name in self.nullable else value.alias(name)

    def _with_levels(self, rows: DataFrame, training: bool) -> DataFrame:
        unseen = self.levels.where(F.isnull("Store")).agg(F.max("level").alias("l")).scalar()
        if training:
            rows = rows.withColumn("fold", fold_of(*self.folding)).join(self.folds, ["Store", "fold"], "left")
        else:
            rows = rows.join(self.levels.where(F.isnotnull("Store")), "Store", "left")
        return rows.withColumn("_level", F.coalesce("level", unseen))

    def vectors(self, df: DataFrame, *keep: str, training: bool = False) -> DataFrame:
        """``keep`` columns of ``df`` and the ``features`` vector.

        ``training`` rows get their store's level without their own fold.
        """
        coded = [c for c in CODED if c in self.features]
        rows = add_codes(df, self.vocabulary, tuple(coded))
        if "Store" in self.features:
            rows = self._with_levels(rows, training)
        inputs = [self._input(f) for f in self.features]
        flags = [F.isnull(c).cast("double").alias(f"{c}_missing") for c in self.nullable]
        kept = [F.col(k).alias(f"_keep_{k}") for k in keep]
        out = VectorAssembler(inputCols=self.columns, outputCol="features").transform(
            rows.select(*kept, *inputs, *flags)
        )
        return out.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], "features")


def make_design(
    train: DataFrame, features: list[str], vocabulary: DataFrame, settings: TreeSettings
) -> Design:
    """Freeze the design on training rows; only a few counts come to the driver."""
    coded = [c for c in CODED if c in features]
    counted = vocabulary.where(F.col("column").isin(list(CODED))).groupBy("column").count().collect()
    sizes = {r["column"]: r["count"] for r in counted if r["column"] in coded}
    numeric = [f for f in features if f not in CATEGORICAL]
    nulls = train.agg(*[F.max(F.isnull(f)).alias(f) for f in numeric]).first() if numeric else {}
    always = ("lag_", "roll_", "trend_", "open_rate_", "dow_mean", "dow_ratio")
    nullable = [f for f in numeric if nulls[f] or f.startswith(always)]
    levels = stage(store_levels(train, settings.level_smoothing), "levels")
    folds = stage(fold_levels(train, settings.level_smoothing, settings.folds, settings.seed), "fold-levels")
    return Design(features, vocabulary, levels, nullable, sizes, folds, (settings.seed, settings.folds))


@dataclass
class Fitted:
    design: Design
    model: Ensemble

    @property
    def best_round(self) -> int:
        return self.model.rounds

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Add the forecast: back from logs, not negative, nothing on closed days."""
        rows = self.design.vectors(df, *df.columns)
        score = self.model.score(vector_to_array("features"))
        return rows.withColumn(name, closed_rule(from_log(score), F.col("Open"))).drop("features")

    def importance(self, top: int | None = None) -> DataFrame:
        table = importance(self.design.levels.sparkSession, self.model, self.design.columns)
        return table if top is None else table.limit(top)


def importance(spark: SparkSession, model: Ensemble, columns: list[str]) -> DataFrame:
    """Share of the total gain per feature, in percent, the largest first.

    A feature and its missing-value flag count as one.
    """
    gains: dict[str, float] = {}
    for column, gain in zip(columns, model.gains, strict=True):
        name = column.removesuffix("_missing") if column.removesuffix("_missing") in columns else column
        gains[name] = gains.get(name, 0.0) + gain
    total = sum(gains.values()) or 1.0
    rows = [(name, gain / total * 100) for name, gain in gains.items()]
    table = spark.createDataFrame(rows, "feature string, gain_pct double")
    return table.orderBy(F.desc("gain_pct"), "feature")


def _labelled(design: Design, rows: DataFrame, training: bool) -> DataFrame:
    labelled = trading_days(rows).withColumn("label", to_log(F.col("Sales")))
    return design.vectors(labelled, "label", training=training)


def fit(
    train: DataFrame,
    features: list[str],
    vocabulary: DataFrame,
    settings: TreeSettings,
    valid: DataFrame | None = None,
    rounds: int | None = None,
) -> Fitted:
    """Grow trees on the trading days of ``train``.

    With ``valid`` the number of rounds is the one with the least validation error.
    Otherwise ``rounds`` trees are grown.
    """
    train = trading_days(train)
    design = make_design(train, features, vocabulary, settings)
    held_out = None if valid is None else _labelled(design, valid, False)
    return Fitted(design, grow(_labelled(design, train, True), settings, held_out, rounds))


def fit_variant(
    table: DataFrame, names: list[str], vocabulary: DataFrame, variant: str, settings: TreeSettings
) -> Fitted:
    """One experiment: its features and settings, trained on train, stopped on valid."""
    chosen = VARIANTS[variant]
    return fit(
        in_split(table, "train"),
        without(names, chosen.dropped),
        vocabulary,
        chosen.settings(settings),
        valid=in_split(table, "valid"),
    )


def split_scores(fitted: Fitted, table: DataFrame, label: str, spec: PanelSpec, splits=("valid",)) -> DataFrame:
    rows = fitted.predict(in_split(table, *splits)).withColumn("label", F.lit(label))
    return evaluate(rows, ("split", "label"), scale=spec.money_scale)


def run_experiments(
    table: DataFrame,
    names: list[str],
    vocabulary: DataFrame,
    baseline: DataFrame,
    spec: PanelSpec,
    settings: TreeSettings,
    root: str,
    only: list[str] | None = None,
    at_once: int = 8,
) -> list[str]:
    """Fit each variant, score it on valid and append it to the run tables.

    Train and valid become vectors once; a variant that drops features slices them. ``at_once``
    variants are fitted at the same time as concurrent jobs, each in a scheduler pool of its own;
    their runs are appended one after another. ``baseline`` is the score row that improvements are
    measured against. The driver handles one row of scores per variant.
    """
    spark = table.sparkSession
    base = baseline.select(*METRICS).first()
    train, valid = trading_days(in_split(table, "train")), in_split(table, "valid")
    design = make_design(train, names, vocabulary, settings)
    label = to_log(F.col("Sales"))
    level = StorageLevel.MEMORY_AND_DISK
    train_rows = design.vectors(train.withColumn("label", label), "label", training=True).persist(level)
    valid_rows = design.vectors(valid.withColumn("label", label), "label", "Sales", "Open").persist(level)
    window = trading_days(valid).agg(F.min("Date").alias("a"), F.max("Date").alias("b")).first()
    n_train = train_rows.count()

    def experiment(name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"variant-{name}")
        chosen = VARIANTS[name]
        own = chosen.settings(settings)
        kept = set(without(names, chosen.dropped))
        columns = [c for c in design.columns if c.removesuffix("_missing") in kept or c in kept]
        slicer = VectorSlicer(inputCol="all", outputCol="features", indices=[design.columns.index(c) for c in columns])
        on_train = slicer.transform(train_rows.withColumnRenamed("features", "all")).drop("all")
        on_valid = slicer.transform(valid_rows.withColumnRenamed("features", "all")).drop("all")
        trees = grow(on_train, own, trading_days(on_valid))
        pred = closed_rule(from_log(trees.score(vector_to_array("features"))), F.col("Open"))
        score = evaluate(on_valid.select("Sales", "Open", pred.alias("pred")), (), scale=spec.money_scale).first()
        metrics = {
            "best_round": trees.rounds,
            "rounds_grown": len(trees.valid_errors),
            "train_error": trees.train_errors[trees.rounds - 1],
            "valid_error": trees.valid_errors[trees.rounds - 1],
        }
        for m in METRICS:
            metrics[f"valid_{m}"] = score[m]
            metrics[f"gain_{m}_pct"] = (1 - score[m] / base[m]) * 100
        params = vars(own) | {
            "n_features": len(kept),
            "dropped": ",".join(chosen.dropped),
            "train_rows": n_train,
            "valid_from": window["a"],
            "valid_to": window["b"],
        }
        gains = [(r["feature"], r["gain_pct"]) for r in importance(spark, trees, columns).collect()]
        return name, params, metrics, {"target": "log1p", "scored": "open days"}, gains

    runs = []
    try:
        with ThreadPoolExecutor(at_once) as pool:
            # Slow and large trees first.
            order = sorted(only or list(VARIANTS), key=lambda name: VARIANTS[name].settings(settings).learning_rate)
            work = [pool.submit(inheritable_thread_target(spark)(experiment), name) for name in order]
            runs += [append_run(spark, root, *done.result()) for done in as_completed(work)]
    finally:
        train_rows.unpersist()
        valid_rows.unpersist()
    return runs


def holdout_scores(fitted: Fitted, table: DataFrame, baseline: DataFrame, spec: PanelSpec) -> DataFrame:
    """Model and baseline on valid and test, with the model's gain in each window."""
    model = split_scores(fitted, table, "model", spec, ("valid", "test"))
    return improvement(model.unionByName(baseline), "baseline", ("split",))


def save_model(fitted: Fitted, path: str, config: str, trained_through: dt.date, scores: DataFrame) -> None:
    """Write the trees, the frozen design and one row of provenance under ``path``.

    ``scores`` has a row for each label, so the baseline's errors stand beside the model's.
    """
    spark = fitted.design.levels.sparkSession
    node_table(spark, fitted.model.trees).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    fitted.design.levels.write.mode("overwrite").parquet(f"{path}/levels")
    fitted.design.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    meta = {
        "config": config,
        "features": fitted.design.features,
        "nullable": fitted.design.nullable,
        "categories": fitted.design.sizes,
        "categorical": [c for c in CATEGORICAL if c in fitted.design.features],
        "num_rounds": fitted.best_round,
        "start": fitted.model.start,
        "rate": fitted.model.rate,
        "gains": fitted.model.gains,
        "target_transform": "log1p",
        "trained_through": trained_through,
        "metrics": {r["label"]: {m: float(r[m]) for m in METRICS} for r in scores.collect()},
    }
    schema = (
        "config string, features array<string>, nullable array<string>, categories map<string,int>, "
        "categorical array<string>, num_rounds int, start double, rate double, gains array<double>, "
        "target_transform string, trained_through date, metrics map<string,map<string,double>>"
    )
    spark.createDataFrame([meta], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Fitted:
    meta = spark.read.parquet(f"{path}/meta").first()
    design = Design(
        list(meta["features"]),
        spark.read.parquet(f"{path}/vocabulary"),
        spark.read.parquet(f"{path}/levels"),
        list(meta["nullable"]),
        dict(meta["categories"]),
    )
    trees = trees_of(spark.read.parquet(f"{path}/trees"))
    return Fitted(design, Ensemble(meta["start"], meta["rate"], trees, list(meta["gains"])))


def provenance(spark: SparkSession, path: str, serving: DataFrame) -> DataFrame:
    """One row: what the model is, how it scored and what it can be asked for."""
    span = serving.agg(
        F.min("Date").alias("serve_from"),
        F.max("Date").alias("serve_to"),
        F.count_distinct("store_key").alias("n_stores"),
    )
    meta = spark.read.parquet(f"{path}/meta")
    return meta.select(
        "config",
        F.size("features").alias("n_features"),
        "num_rounds",
        "target_transform",
        "trained_through",
        "metrics",
        *[span.select(c).scalar().alias(c) for c in span.columns],
    )


def submission(
    fitted: Fitted, future: DataFrame, serving: DataFrame, multiplier: float = 1.0
) -> DataFrame:
    """(Id, Sales) for the published ids: forecast times multiplier, two decimals.

    An id without a serving row fails the job: a submission has every id.
    """
    unseen = serving.where(F.isnull("Sales")).withColumn("_served", F.lit(True))
    ids = future.withColumnRenamed("Store", "store_key").select("Id", "store_key", "Date")
    missing = F.raise_error(F.concat(F.lit("no features for id "), F.col("Id").cast("string")))
    rows = ids.join(unseen, ["store_key", "Date"], "left").withColumn(
        "Open", F.when(F.col("_served"), F.col("Open")).otherwise(missing.cast("int"))
    )
    rows = fitted.predict(rows.where(F.isnotnull("Open")).drop("_served"))
    return rows.select("Id", money(F.col("pred"), multiplier).alias("Sales"))


def submission_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("Sales").alias("mean"),
        F.count_if(F.col("Sales") == 0).alias("zero_rows"),
        F.max("Sales").alias("max"),
    )
