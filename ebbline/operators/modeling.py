"""Model data, training, comparison and scoring with MLlib."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache
from threading import BoundedSemaphore

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.columns import md5_number, md5_of
from ebbline.operators import metrics
from ebbline.operators.features import complete_features, feature_tables
from ebbline.plans import neighbours
from ebbline.plans.skew import md5_rank
from ebbline.sources import warehouse

KEY = ["occupant_id", "segment", "window"]
LABEL, WEIGHT, FOLD = "cutoff_strict", "weights", "fold"
# Feature sets by option.
BASIC = ["f_late", "f_zero_vol"]
ANOMALY = {"anom": ["f_anom3_vol"], "manom": ["f_manom3_vol"], "none": []}
METADATA = ["cust_type_code", "municipality", "meter_size"]
CUT_PRIOR = ["cut_prior"]
CATEGORICAL = [*METADATA, *CUT_PRIOR]
# Mix of the two penalties, depth of a forest without a depth grid.
ELASTIC_MIX, DEFAULT_DEPTH = 0.5, 20
#: Rows that a task of a fit should have at least.
ROWS_A_PARTITION = 20_000
#: Rows of equal features, label, weight and fold that a row of a fit stands for.
COPIES = "copies"
#: A forest's rows are blocks of copies where that leaves at least this many of them.
BLOCKS = 20_000
#: Share of the training rows whose copies may be fewer than a block.
FEW_COPIES = 0.01


@dataclass(frozen=True)
class ModelOptions:
    anom: str = "anom"
    with_meta: bool = False
    with_cut_prior: bool = False
    model_types: tuple[str, ...] = ("logistic_regression", "random_forest")
    n_samples: tuple[int, ...] = (4, 6, 8, 10, 12)
    max_depths: tuple[int, ...] | None = (3, 4, 5)
    trees: int = 100
    folds: int = 5
    regularization: bool = True
    reg_params: tuple[float, ...] | None = None  # None: a path from the data
    path_length: int = 20
    path_least: float = 1e-4
    patience: int = 3
    rebalance: str | None = "weights"
    parallelism: int = 8
    seed: int = 1
    features: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(
            self, "features", feature_names(self.anom, self.with_meta, self.with_cut_prior)
        )

    def tag(self, ref_date: str) -> str:
        prior = "with_cut_prior" if self.with_cut_prior else "no_cut_prior"
        meta = "with_meta" if self.with_meta else "no_meta"
        return f"train.{ref_date}.{prior}.{meta}.{self.anom}"

    def digest(self) -> str:
        """Of everything that can change a result."""
        fields = {k: v for k, v in asdict(self).items() if k != "parallelism"}
        return hashlib.md5(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:12]


# -- model data ----------------------------------------------------------------------------

def feature_names(anom: str = "anom", with_meta: bool = False, with_cut_prior: bool = False) -> list[str]:
    if anom not in ANOMALY:
        raise ValueError(f"anom {anom!r}: expected one of {sorted(ANOMALY)}")
    return [
        *BASIC, *ANOMALY[anom],
        *(METADATA if with_meta else []), *(CUT_PRIOR if with_cut_prior else []),
    ]


def select_features(table: DataFrame, names: Sequence[str], label: str = LABEL) -> DataFrame:
    return table.select(*KEY, *names, label)


def strata(table: DataFrame, label: str = LABEL) -> DataFrame:
    """``stratum``: nocut, cut0 (last cut segment of the customer) or cut1 (earlier ones)."""
    last = table.filter(F.col(label) == 1).groupBy("occupant_id").agg(F.max("segment").alias("_last"))
    return (
        table.filter(F.col(label).isin(0, 1))
        .join(last, "occupant_id", "left")
        .withColumn(
            "stratum",
            F.when(F.col(label) == 0, "nocut")
            .when(F.col("segment") == F.col("_last"), "cut0")
            .otherwise("cut1"),
        )
        .drop("_last")
    )


def stratified_split(
    table: DataFrame, label: str = LABEL, test_share: float = 0.2, split: str = "exact"
) -> DataFrame:
    """Add ``stratum`` and ``subset`` (train or test); each stratum is split by itself.

    ``exact``: the ``ceil(share * n)`` rows of lowest md5 digest form the test set; a stratum
    of one row goes to train.  The digest that separates them is found by counting four-digit
    prefixes and ordering only the rows of the one prefix where the count is reached, so the
    large stratum is never sorted.  ``hash``: the digest prefix decides alone (the test share
    is approximate), with no second pass.
    """
    rows = strata(table, label).withColumn("_digest", md5_of(*KEY))
    prefix = F.substring("_digest", 1, 4)
    if split == "hash":
        limit = f"{math.ceil(test_share * 65_536):05x}"
        test = F.concat(F.lit("0"), prefix) < F.lit(limit)
        return rows.withColumn(
            "subset", F.when(test, "test").otherwise("train")
        ).drop("_digest")
    if split != "exact":
        raise ValueError(f"split {split!r}: expected exact or hash")

    sizes = rows.groupBy("stratum", prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    counted = sizes.withColumns({
        "_size": F.sum("_n").over(whole), "_upto": F.sum("_n").over(upto),
    }).withColumn("_wanted", F.ceil(F.lit(test_share) * F.col("_size").cast("double")))
    # At most one row per stratum.
    reached = F.broadcast(
        counted.filter("_size > 1 and _upto >= _wanted and _upto - _n < _wanted")
        .select("stratum", "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    edge = (
        rows.select("stratum", "_digest").withColumn("_prefix", prefix)
        .join(reached, ["stratum", "_prefix"])
        .withColumn("_rn", F.row_number().over(whole.orderBy("_digest")))
        .filter(F.col("_rn") == F.col("_left"))
        .select("stratum", F.col("_digest").alias("_edge"))
    )
    return (
        rows.join(F.broadcast(edge), "stratum", "left")
        .withColumn(
            "subset",
            F.when(F.col("_digest") <= F.col("_edge"), "test").otherwise("train"),
        )
        .drop("_digest", "_edge")
    )


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """label -> weight that gives both classes half of the total weight (two rows)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = train.agg(F.count(F.lit(1)))
    return counts.select(label, (F.lit(0.5) * total.scalar() / F.col("n")).alias(WEIGHT))


def with_class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    return train.join(F.broadcast(class_weights(train, label)), label)


def smote_oversample(train: DataFrame, names: Sequence[str], label: str = LABEL, k: int = 5) -> DataFrame:
    """Add minority rows between neighbours until both classes are equal: keys, features, label, ``synthetic``.

    Neighbours are the ``k`` nearest other minority rows by the numeric features, ties in md5 order
    of the keys; they are searched once per distinct vector, and copies of a vector, however many,
    count as its nearest rows.  A new row lies between a row and one of its neighbours in the numeric
    features, takes its categories from that neighbour, and has a key of its own.  Neighbour and place
    follow from the row's key and the number of the copy.  A lone minority row is repeated.  A row
    whose numeric features are not all known is kept, but no new row starts or ends there.
    """
    folder = warehouse.new_folder(train.sparkSession, "smote")
    numeric = [c for c in names if c not in CATEGORICAL]
    other = [c for c in names if c in CATEGORICAL]
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    minor, n_minor, n_major = counts.agg(F.min_by(label, F.struct("n", label)), F.min("n"), F.max("n")).first()
    vector = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in numeric])
    known = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = train.filter(F.col(label).eqNullSafe(F.lit(minor)) & known).select(
        *KEY, vector.alias("x"), F.struct(*(other or [F.lit(0).alias("none")])).alias("categories"), md5_of(*KEY).alias("digest"),
        F.md5(F.concat_ws("|", vector.cast("array<string>")).cast("binary")).alias("vid"),
    )
    rows = warehouse.store(rows, folder, "minority")
    among = Window.partitionBy("vid").orderBy("digest")
    first = warehouse.store(rows.withColumn("_rn", F.row_number().over(among)).filter(F.col("_rn") <= k + 1), folder, "first")
    vectors = rows.groupBy("vid").agg(F.count(F.lit(1)).alias("copies"), F.min_by("x", "digest").alias("x"), F.min("digest").alias("tie"))
    vectors = warehouse.store(vectors, folder, "vectors")
    near = neighbours.nearest(vectors.filter(F.col("copies") <= k), vectors.select("vid", "x", "tie"), k, folder)
    own = vectors.select("vid", F.col("vid").alias("other"), F.lit(0.0).alias("gap"))
    reached = own.unionByName(near.select("vid", "other", "gap")).join(
        first.select(F.col("vid").alias("other"), F.col("x").alias("y"), "categories", "digest"), "other")
    nearby = Window.partitionBy("vid").orderBy("gap", "digest")
    lists = reached.withColumn("_rn", F.row_number().over(nearby)).filter(F.col("_rn") <= k + 1).groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "y", "categories", "digest"))).alias("near"))
    missing, usable = n_major - n_minor, rows.count()
    numbered = md5_rank(rows.withColumn("_all", F.lit(1)), ["_all"], F.col("digest"), out="number")
    share = F.lit(missing // max(1, usable)) + F.when(F.col("number") <= missing % max(1, usable), 1).otherwise(0)
    block = F.lit(10_000).cast("bigint")  # a row with very many copies is not unfolded at once
    copies = (
        numbered.withColumn("share", share.cast("bigint")).filter("share > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("share") - 1) / block))))
        .withColumn("copy", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.col("share"), (F.col("block") + 1) * block))))
        .join(lists, "vid", "left")
        .withColumn("near", F.slice(F.filter("near", lambda e: e["digest"] != F.col("digest")), 1, k))
    )
    text = "concat_ws('|', digest, string(copy))"
    chosen = F.try_element_at("near", (md5_number(text) % F.greatest(F.size("near"), F.lit(1)) + 1).cast("int"))
    made = copies.withColumns({"to": chosen, "u": md5_number(text, 1) / F.lit(4294967296.0)}).select(
        F.concat_ws("-", F.lit("made"), F.col("copy").cast("string"), F.col("occupant_id")).alias("occupant_id"), "segment", "window",
        *[(F.col("x")[i] + (F.coalesce(F.col("to.y")[i], F.col("x")[i]) - F.col("x")[i]) * F.col("u")).alias(c) for i, c in enumerate(numeric)],
        *[F.when(F.col("to").isNull(), F.col("categories")[c]).otherwise(F.col("to.categories")[c]).alias(c) for c in other],
        F.lit(minor).cast(train.schema[label].dataType).alias(label), F.lit(1).alias("synthetic"),
    )
    kept = train.select(*KEY, *[F.col(c).cast("double").alias(c) for c in numeric], *other, label, F.lit(0).alias("synthetic"))
    return kept.unionByName(made).select(*KEY, *names, label, "synthetic")


def with_folds(train: DataFrame, folds: int = 5, label: str = LABEL) -> DataFrame:
    """Folds of equal size and class mix: position in md5 order within the class, mod ``folds``."""
    return md5_rank(train, [label], md5_of(*KEY), out="_rn").withColumn(
        FOLD, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")
    ).drop("_rn")


# -- models --------------------------------------------------------------------------------

def numeric_and_categorical(names: Sequence[str]) -> tuple[list[str], list[str]]:
    return [c for c in names if c not in CATEGORICAL], [c for c in names if c in CATEGORICAL]


def missing_values(train: DataFrame, names: Sequence[str]) -> tuple[dict[str, float], list[str]]:
    """What a missing numeric feature counts as, its weighted mean over the training rows, and the features
    that training rows lack."""
    numeric, _ = numeric_and_categorical(names)
    if not numeric:
        return {}, []
    weight = F.col(WEIGHT) if WEIGHT in train.columns else F.lit(1.0)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    row = train.agg(
        *[F.try_divide(F.sum(value[c] * weight), F.sum(F.when(value[c].isNotNull(), weight))).alias(c) for c in numeric],
        *[F.count_if(value[c].isNull()).alias(f"{c}_n") for c in numeric],
    ).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in numeric}, [c for c in numeric if row[f"{c}_n"]]


def fill_stage(means: dict[str, float], flagged: Sequence[str]) -> SQLTransformer:
    """The means take the place of missing values; a flagged feature also tells that it was missing.

    The state is in the statement, so it is saved and loaded with the model.
    """
    flags = [f"CAST({c} IS NULL OR isnan({c}) AS DOUBLE) AS {c}_missing" for c in flagged]
    filled = [f"coalesce(nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE)), CAST('{v!r}' AS DOUBLE)) AS {c}" for c, v in means.items()]
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(means)}), {', '.join([*filled, *flags])} FROM __THIS__")


def feature_stages(
    names: Sequence[str], one_hot: bool, means: dict[str, float] | None = None, flagged: Sequence[str] = (), output: str = "features"
) -> list:
    """Fill missing numbers, index the categorical features (unseen and missing values are one more
    category), encode them for linear models, assemble one vector."""
    numeric, categorical = numeric_and_categorical(names)
    stages: list = [fill_stage(means, flagged)] if means else []
    inputs = [*numeric, *[f"{c}_missing" for c in flagged]]
    if categorical:
        indexed = [f"{c}_index" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"))
        if one_hot:
            encoded = [f"{c}_onehot" for c in categorical]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"))
            inputs += encoded
        else:
            inputs += indexed
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return stages


def encode(table: DataFrame, names: Sequence[str], one_hot: bool = False) -> PipelineModel:
    return Pipeline(stages=feature_stages(names, one_hot)).fit(table)


def _weighted(estimator, table: DataFrame):
    return estimator.setWeightCol(WEIGHT) if WEIGHT in table.columns else estimator


@dataclass
class Trained:
    model: PipelineModel
    names: list[str]
    cv: DataFrame | None  # held-out scores: key, label, p_cutoff
    cv_auc: float | None


@lru_cache
def _places(parallelism: int) -> BoundedSemaphore:
    """For fits: that many run at a time, however many searches do."""
    return BoundedSemaphore(max(1, parallelism))


class GridSearch:
    """Fits an estimator's settings on the folds; a fold's model is scored, its scores are written, and it is dropped.

    Features are shares of a window's records and codes, so many rows have the same ones: rows of equal
    features, label, weight and fold are one row that carries their weight, and a fit's work follows
    the number of different rows.  The features are encoded once; what the folds fit is the estimator
    alone.  Settings are compared by exact metrics of the scores of all folds together.
    """

    def __init__(self, train: DataFrame, options: ModelOptions, stages: Sequence):
        self.options, self.folder, self.train = options, warehouse.new_folder(train.sparkSession, "search"), train
        self.encoder = Pipeline(stages=list(stages)).fit(train)
        self.weight = F.col(WEIGHT) if WEIGHT in train.columns else F.lit(1.0)
        alike = train.withColumn(WEIGHT, self.weight).groupBy(*options.features, LABEL, WEIGHT, FOLD).agg(F.count(F.lit(1)).alias(COPIES))
        groups = warehouse.store(alike.withColumn("_each", F.col(WEIGHT)).withColumn(WEIGHT, F.col(WEIGHT) * F.col(COPIES)), self.folder, "groups")
        kept = [*options.features, LABEL, WEIGHT, FOLD, COPIES, "_each", "features"]
        stored = warehouse.store(self.encoder.transform(groups.withColumns({f"_{c}": F.col(c) for c in options.features})).select(
            *[F.col(f"_{c}" if c in options.features else c).alias(c) for c in kept]), self.folder, "encoded")
        # every step of a fit is a job over all partitions; few rows need few of them
        self.rows = self.fitted = stored.coalesce(max(1, math.ceil(stored.count() / ROWS_A_PARTITION)))
        self.sums = {r[FOLD]: r for r in stored.groupBy(FOLD).agg(
            F.sum(WEIGHT).alias("w"), F.sum(F.col(WEIGHT) * F.col("_each")).alias("q"), F.sum(F.col(WEIGHT) * F.col(WEIGHT)).alias("q_groups"),
        ).collect()}  # a row per fold
        self.slots = _slots(self.encoder, train)
        self.tried: list = []
        self.stats: list[dict] = []

    def use_blocks(self) -> int:
        """Let fits see blocks of equal rows of about one size, and return that size; 1: every row by itself.

        The size is that which all but few rows have copies for, so rows that have no like are not put
        together, and leaves ``BLOCKS`` of them.
        """
        few, total = self.rows.agg(F.percentile(F.col(COPIES), F.lit(FEW_COPIES), F.col(COPIES)), F.sum(COPIES)).first()
        size = max(1, min(int(few or 1), (total or 0) // BLOCKS))
        if size == 1:
            single = self.encoder.transform(self.train).withColumn(WEIGHT, self.weight).select(LABEL, WEIGHT, FOLD, "features")
            self.fitted = warehouse.store(single, self.folder, "single").coalesce(max(1, math.ceil((total or 0) / ROWS_A_PARTITION)))
            return size
        many = F.lit(10_000).cast("bigint")  # a group of very many blocks is not unfolded at once
        blocks = (
            self.rows.withColumn("_n", F.greatest(F.lit(1), F.round(F.col(COPIES) / size)).cast("bigint"))
            .withColumn(WEIGHT, F.col(WEIGHT) / F.col("_n"))
            .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / many))))
        )
        tasks = max(1, math.ceil((total or 0) / size / ROWS_A_PARTITION))
        unfolded = blocks.repartition(tasks, "_part", *self.options.features, LABEL, FOLD).withColumn(
            "_block", F.explode(F.sequence(F.col("_part") * many + 1, F.least(F.col("_n"), (F.col("_part") + 1) * many))))
        stored = warehouse.store(unfolded.select(LABEL, WEIGHT, FOLD, "features"), self.folder, "blocks")
        self.fitted = stored.coalesce(tasks)
        return size

    def fit(self, estimator, fold: int | None = None):
        """The estimator fitted on all rows, or on those outside a fold."""
        rows = self.fitted if fold is None else self.fitted.filter(F.col(FOLD) != fold)
        if not isinstance(estimator, LogisticRegression):
            return estimator.copy().fit(rows)
        # The penalty is on coefficients in units of the deviation, whose divisor counts weights squared: heavier
        # rows stretch all deviations alike, and both parts of the penalty are shrunk by as much.
        w, q, q_groups = (sum(r[c] for k, r in self.sums.items() if k != fold) for c in ("w", "q", "q_groups"))
        stretch = math.sqrt((w * w - q) / (w * w - q_groups)) if w * w > max(q, q_groups) else 1.0
        penalty, mix = estimator.getRegParam(), estimator.getElasticNetParam()
        first, second = penalty * mix / stretch, penalty * (1 - mix) / stretch**2
        shrunk = estimator.copy().setRegParam(first + second)
        model = shrunk.setElasticNetParam(first / (first + second) if penalty else mix).fit(rows)
        return model.copy({model.regParam: penalty, model.elasticNetParam: mix})

    def run(self, estimators: Sequence) -> None:
        """Scores of each setting's folds, several fits at a time, and the metrics of each setting."""
        first = len(self.tried)

        def one(job: tuple[int, int]) -> None:
            setting, fold = job
            with _places(self.options.parallelism):
                model = self.fit(estimators[setting], fold)
                held_out = score(model, self.rows.filter(F.col(FOLD) == fold), [*self.options.features, LABEL, WEIGHT, COPIES])
                held_out.write.mode("overwrite").parquet(f"{self.folder}/held_out/setting={first + setting}/fold={fold}")

        jobs = [(k, fold) for k in range(len(estimators)) for fold in range(self.options.folds)]
        with ThreadPoolExecutor(max(1, self.options.parallelism)) as pool:
            list(pool.map(one, jobs))
        self.tried += estimators
        new = self.scores().filter(F.col("setting") >= first)
        rows = {r["setting"]: r.asDict() for r in metrics.score_metrics(new, LABEL, "p_cutoff", group="setting", copies=COPIES).collect()}
        self.stats += [rows.get(first + k, {"auc": None, "logloss": None}) for k in range(len(estimators))]

    def scores(self) -> DataFrame:
        """What each setting's folds gave the rows they did not see, once for equal rows."""
        return self.train.sparkSession.read.parquet(f"{self.folder}/held_out")

    def held_out(self, setting: int) -> DataFrame:
        """Key, label and held-out score of every training row."""
        same = [LABEL, FOLD, *self.options.features]
        known = self.scores().filter(F.col("setting") == setting).select(*[F.col(c).alias(f"_{c}") for c in same], "p_cutoff").distinct()
        alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
        return self.train.select(*KEY, *same).join(known, alike, "left").select(*KEY, LABEL, "p_cutoff")

    def best(self, metric: str) -> int:
        """The first setting of highest AUC or lowest log-loss."""
        value = {"auc": lambda s: s["auc"], "logloss": lambda s: None if s["logloss"] is None else -s["logloss"]}[metric]
        return max(range(len(self.stats)), key=lambda k: (-math.inf if value(self.stats[k]) is None else value(self.stats[k]), -k))

    def trained(self, setting: int) -> Trained:
        """The setting fitted on all rows, behind the encoder."""
        estimator = self.tried[setting].copy()
        if estimator.hasParam("tol"):  # the chosen one is fitted more closely
            estimator.setTol(1e-10).setMaxIter(500)
        with _places(self.options.parallelism):
            model = self.fit(estimator)
        return Trained(
            PipelineModel([*self.encoder.stages, model]), self.options.features, self.held_out(setting), self.stats[setting]["auc"]
        )


def penalty_path(rows: DataFrame, length: int, least: float, mix: float) -> list[float]:
    """Penalties from the one that leaves no coefficient down to ``least`` of it, evenly in the logarithm.

    At the null model a feature enters when its weighted gradient, in standard deviations, passes
    ``mix`` times the penalty; one aggregation over the two classes gives all gradients.
    """
    weight = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1.0)
    summary = Summarizer.metrics("mean", "variance").summary(F.col("features"), weight)
    parts = {int(r[LABEL]): r for r in rows.groupBy(LABEL).agg(summary.alias("s"), F.sum(weight).alias("w")).collect()}
    if set(parts) != {0, 1}:
        return [1.0]
    w = {y: r["w"] for y, r in parts.items()}
    mean = {y: r["s"]["mean"].toArray() for y, r in parts.items()}
    whole = rows.agg(summary.alias("s")).first()["s"]
    deviation = np.sqrt(whole["variance"].toArray())
    total = w[0] + w[1]
    centre = (w[0] * mean[0] + w[1] * mean[1]) / total
    gradient = np.divide(w[1] / total * (mean[1] - centre), deviation, out=np.zeros(len(centre)), where=deviation > 0)
    top = float(np.abs(gradient).max(initial=0.0)) / mix
    if top <= 0:
        return [1.0]
    return [top * least ** (k / max(1, length - 1)) for k in range(length)]


def _logistic(train: DataFrame, penalty: float, mix: float = ELASTIC_MIX):
    return _weighted(LogisticRegression(
        labelCol=LABEL, elasticNetParam=mix, standardization=True, maxIter=50, tol=1e-4, regParam=penalty
    ), train)


def train_logistic(train: DataFrame, options: ModelOptions) -> Trained:
    """Elastic-net logistic regression, its penalty searched along a path from the data; or without a penalty.

    The search goes from large penalties to small ones, some at a time, and ends when the held-out
    log-loss has not improved for ``patience`` settings; the lowest log-loss wins.
    """
    if not options.regularization:
        return train_logistic_plain(train, options)
    means, _ = missing_values(train, options.features)
    search = GridSearch(train, options, feature_stages(options.features, True, means))
    path = list(options.reg_params or penalty_path(
        search.encoder.transform(train), options.path_length, options.path_least, ELASTIC_MIX))
    at_once = max(1, options.parallelism // max(1, options.folds)) + 1
    for k in range(0, len(path), at_once):
        search.run([_logistic(search.rows, p) for p in path[k : k + at_once]])
        if options.reg_params is None and len(search.stats) - 1 - search.best("logloss") >= options.patience:
            break
    return search.trained(search.best("logloss"))


def independent_slots(rows: DataFrame, size: int) -> list[int]:
    """Slots of ``features`` that, with an intercept, determine all others: constants and combinations go.

    The correlations of all slots come from one distributed aggregation; what is left for the driver
    is a matrix of the slots' number squared, worked off by pivots in the slots' order.
    """
    if not size:
        return []
    varies = rows.agg(Summarizer.variance(F.col("features"))).first()[0].toArray() > 0
    left, kept = np.nan_to_num(Correlation.corr(rows, "features").first()[0].toArray()), []
    for k in np.flatnonzero(varies).tolist():
        if left[k, k] < 1e-9:
            continue
        kept.append(k)
        row = left[k] / math.sqrt(left[k, k])
        left = left - np.outer(row, row)
    return kept


def train_logistic_plain(train: DataFrame, options: ModelOptions) -> Trained:
    """Binomial model without a penalty, with standard errors and p-values.

    Of each category's indicators and of features that follow from others, those that add no rank
    are left out: the level that is met most often first, which is what the others are compared with.
    """
    means, _ = missing_values(train, options.features)
    stages = feature_stages(options.features, True, means, output="all_features")
    probe = Pipeline(stages=[*stages[:-1], stages[-1].copy().setOutputCol("features")]).fit(train)
    slots = _slots(probe, train)
    levels = _first_levels(probe)
    order = [k for k, name in enumerate(slots) if name not in levels]
    kept = [order[k] for k in independent_slots(
        probe.transform(train).select(_sliced("features", order).alias("features")), len(order))]
    stages.append(VectorSlicer(inputCol="all_features", outputCol="features", indices=kept))
    search = GridSearch(train, options, stages)
    search.run([_weighted(GeneralizedLinearRegression(
        labelCol=LABEL, family="binomial", link="logit", solver="irls", regParam=0.0, maxIter=50, tol=1e-10
    ), search.rows)])
    return search.trained(0)


def _sliced(column: str, slots: Sequence[int]) -> Column:
    values = vector_to_array(column)
    return array_to_vector(F.array(*[values[k] for k in slots]))


def _first_levels(model: PipelineModel) -> set[str]:
    """Names of the indicator slots of each feature's commonest level."""
    return {f"{c}_onehot_{labels[0]}" for stage in model.stages if isinstance(stage, StringIndexerModel)
            for c, labels in zip(stage.getInputCols(), stage.labelsArray) if labels}


def train_forest(train: DataFrame, options: ModelOptions) -> Trained:
    """Random forests over the depth grid (depth 20 without one).  A category needs a bin, and so do unseen ones.

    A feature that training rows lack is flagged, so trees can split on its absence.

    Trees differ by the weights of the rows: a row counts as often as a Poisson draw of mean 1 says.  A
    block of k equal rows is in a tree with the odds of k to 1 and then counts k + 1 times: mean and
    variance are k, those of k draws.
    """
    means, flagged = missing_values(train, options.features)
    search = GridSearch(train, options, feature_stages(options.features, False, means, flagged))
    sizes = [len(v) + 1 for stage in search.encoder.stages if isinstance(stage, StringIndexerModel) for v in stage.labelsArray]
    forest = _weighted(RandomForestClassifier(
        labelCol=LABEL, numTrees=options.trees, seed=options.seed, maxBins=max([64, *sizes])
    ), search.rows)
    block = search.use_blocks()
    if block > 1:
        forest = forest.setBootstrap(False).setSubsamplingRate(block / (block + 1))
    search.run([forest.copy().setMaxDepth(d) for d in options.max_depths or (DEFAULT_DEPTH,)])
    return search.trained(search.best("auc"))


def residuals(model: PipelineModel, train: DataFrame) -> DataFrame:
    """Per slot of a linear model, and the intercept: name, value, deviation and gradient.

    gradient is the weighted mean of (p - label) times the slot, 0 everywhere at the optimum without a penalty.
    """
    last, names = model.stages[-1], _slots(model, train)
    w = F.col(WEIGHT) if WEIGHT in train.columns else F.lit(1.0)
    scored = model.transform(train)
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    rows = scored.select(F.concat(vector_to_array("features"), F.array(F.lit(1.0))).alias("x"), (p - F.col(LABEL)).alias("r"), w.alias("w"), "features")
    slots = rows.select("r", "w", F.posexplode("x").alias("slot", "x")).groupBy("slot").agg(
        (F.sum(F.col("w") * F.col("r") * F.col("x")) / F.sum("w")).alias("gradient"))
    deviation = [*np.sqrt(rows.agg(Summarizer.metrics("variance").summary(F.col("features"), F.col("w")).alias("s")).first()["s"]["variance"].toArray()).tolist(), 1.0]
    values = [*last.coefficients.toArray().tolist(), last.intercept]
    known = train.sparkSession.createDataFrame(list(zip(range(len(values)), [*names, "Intercept"], values, deviation)), "slot int, name string, value double, deviation double")
    return known.join(slots, "slot").select("name", "value", "deviation", "gradient")


def optimality(model: PipelineModel, train: DataFrame) -> DataFrame:
    """name and gap: how far each slot is from the first-order conditions of the penalized likelihood."""
    last = model.stages[-1]
    penalty, mix = (last.getRegParam(), last.getElasticNetParam()) if hasattr(last, "getElasticNetParam") else (0.0, 0.0)
    own = F.when(F.col("name") == "Intercept", 0.0).otherwise(F.lit(penalty))
    g, b = F.try_divide("gradient", "deviation"), F.col("value") * F.col("deviation")
    inside = F.greatest(F.lit(0.0), F.abs(g) - own * mix)
    moved = F.abs(g + own * (1 - mix) * b + own * mix * F.signum(b))
    return residuals(model, train).select("name", F.coalesce(F.when(b == 0, inside).otherwise(moved), F.lit(0.0)).alias("gap"))


TRAINERS = {"logistic_regression": train_logistic, "random_forest": train_forest}


def score(model: Model, table: DataFrame, kept: Sequence[str] | None = None) -> DataFrame:
    """Key, label if there is one (or the columns named), and the probability of class 1."""
    kept = kept or [c for c in [*KEY, LABEL, "subset", "stratum"] if c in table.columns]
    scored = model.transform(table)
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*kept, F.nanvl(p, F.lit(None).cast("double")).alias("p_cutoff"))


def score_linear(table: DataFrame, coefficients: dict[str, float], means: dict[str, float] | None = None) -> DataFrame:
    """Probability from given logit coefficients: pure column arithmetic.  A missing input counts as its mean, if given."""
    z = F.lit(0.0)
    for name, w in coefficients.items():
        if name == "intercept":
            z = z + F.lit(float(w))
        else:
            value = F.col(name)
            if means and name in means:
                value = F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(float(means[name])))
            z = z + F.lit(float(w)) * value
    return table.withColumn("p_cutoff", 1 / (1 + F.exp(-z)))


def _slots(model: PipelineModel, table: DataFrame) -> list[str]:
    """Names of the slots of ``features``, from the column's metadata."""
    transformed = table.limit(0)
    for stage in model.stages:
        if isinstance(stage, (VectorAssembler, VectorSlicer)) or not hasattr(stage, "getFeaturesCol"):
            transformed = stage.transform(transformed)
    attrs = transformed.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in slots]


COEFS = "name string, value double, kind string, std_error double, p_value double"


def coefficients(model: PipelineModel, table: DataFrame) -> DataFrame:
    """name, value, kind, std_error, p_value: coefficients of a linear model, importances of a forest.

    Errors and p-values are known for the model without a penalty, as long as it is not a reloaded one
    and its likelihood has a finite optimum.
    """
    last, names = model.stages[-1], _slots(model, table)
    if hasattr(last, "featureImportances"):
        rows = [(n, float(v), "importance", None, None) for n, v in zip(names, last.featureImportances.toArray().tolist())]
    else:
        values = [*last.coefficients.toArray().tolist(), last.intercept]
        errors = ps = [None] * len(values)
        if isinstance(last, GeneralizedLinearRegressionModel) and last.hasSummary:
            try:
                errors, ps = last.summary.coefficientStandardErrors, last.summary.pValues
            except UnsupportedOperationException:  # a level has one label only, so there is no finite optimum
                pass
        rows = [(n, float(v), "coefficient", e, p) for n, v, e, p in zip([*names, "Intercept"], values, errors, ps)]
    return table.sparkSession.createDataFrame(rows, COEFS)


# -- training runs -------------------------------------------------------------------------

STATS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("sweep_id", T.StringType()), T.StructField("options", T.StringType()),
    T.StructField("grid_order", T.IntegerType()), T.StructField("n_samples", T.IntegerType()),
    T.StructField("model_type", T.StringType()), T.StructField("seed", T.IntegerType()),
    *[T.StructField(f"{m}_{s}", T.DoubleType())
      for s in ("train", "xval", "test") for m in ("auc", "logloss", "r2")],
])


def prepare_training(features: DataFrame, options: ModelOptions, folder: str, name: str) -> DataFrame:
    """Split, weights and folds of one feature table, written once because every fit rereads it."""
    split = stratified_split(features)
    train = split.filter("subset = 'train'")
    if options.rebalance == "weights":
        train = with_class_weights(train)
    elif options.rebalance == "oversample":
        means, _ = missing_values(train, options.features)
        known = train.fillna(means).replace(float("nan"), None, subset=list(means)).fillna(means) if means else train
        train = smote_oversample(known, options.features).withColumn("subset", F.lit("train"))
    elif options.rebalance is not None:
        raise ValueError(f"rebalance {options.rebalance!r}: expected weights, oversample or None")
    train = with_folds(train, options.folds)
    rows = train.unionByName(split.filter("subset = 'test'"), allowMissingColumns=True)
    return warehouse.store(rows, folder, name)


def train_and_test(
    prepared: DataFrame, model_type: str, options: ModelOptions
) -> tuple[Trained, dict[str, DataFrame], dict[str, float | None]]:
    """Train one kind of model; held-out, train and test scores and their metrics."""
    if model_type not in TRAINERS:
        raise ValueError(f"model type {model_type!r}: expected one of {sorted(TRAINERS)}")
    trained = TRAINERS[model_type](prepared.filter("subset = 'train'"), options)
    scored = {
        "train": score(trained.model, prepared.filter("subset = 'train'")),
        "xval": trained.cv,
        "test": score(trained.model, prepared.filter("subset = 'test'")),
    }
    together = None
    for subset, df in scored.items():
        part = df.select(F.lit(subset).alias("scored"), LABEL, "p_cutoff")
        together = part if together is None else together.unionByName(part)
    stats: dict[str, float | None] = {}
    for row in metrics.score_metrics(together, LABEL, "p_cutoff", group="scored").collect():  # 3 rows
        stats |= {f"{m}_{row['scored']}": row[m] for m in ("auc", "logloss", "r2")}
    return trained, scored, stats


def best_run(stats: DataFrame) -> DataFrame:
    """``is_best``: highest held-out AUC of each option set; the first in grid order wins a tie."""
    order = Window.partitionBy("options").orderBy(
        F.col("auc_xval").desc_nulls_last(), F.col("grid_order")
    )
    return stats.withColumn("is_best", F.row_number().over(order) == 1)


@dataclass(frozen=True)
class RunFolders:
    root: str

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def stats(self) -> str:
        return f"{self.root}/model_stats"

    @property
    def coefs(self) -> str:
        return f"{self.root}/model_coefs"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def sweeps(self) -> str:
        return f"{self.root}/sweeps"

    def model(self, run_id: str) -> str:
        return f"{self.root}/models/{run_id}"


def sweep_name(features: DataFrame, options: ModelOptions, ref_date: str) -> str:
    """Tells apart what the runs depend on: every option, the date and the content of the feature table."""
    rows = features.select(F.xxhash64(*[F.col(c) for c in sorted(features.columns)]).cast("decimal(20,0)").alias("h"))
    content = rows.agg(F.count("h"), F.sum("h"), F.sum(F.xxhash64("h").cast("decimal(20,0)"))).first()
    return f"{options.tag(ref_date)}.{options.digest()}.{hashlib.md5(str(tuple(content)).encode()).hexdigest()[:12]}"


def train_sweep(
    spark: SparkSession, features: DataFrame, root: str, options: ModelOptions, ref_date: str
) -> DataFrame:
    """Train every model type for every window length and record the runs; returns them.

    The loop covers the small grid of settings only; every fit and every score is a distributed job.
    ``features`` holds all window lengths (column ``n_samples``); the seed grows from one to the next.
    Runs do not depend on each other and most of their jobs are short: up to ``parallelism`` of them go
    on side by side, begun in the grid's order, and share as many fits.

    A run's row in the statistics is written when all else of the run is there, and the sweep's row
    when all runs are, so a sweep that was cut off is not seen; started again with the same options on
    the same features, it goes on with the runs that are missing.
    """
    folders, sweep = RunFolders(root), sweep_name(features, options, ref_date)
    recorded = warehouse.read_if_there(spark, folders.stats, STATS_SCHEMA).filter(F.col("sweep_id") == sweep)
    done = {r["run_id"] for r in recorded.select("run_id").collect()}

    def record(run: tuple) -> None:
        run_id, i, n, j, model_type, prepared, own = run
        trained, scored, stats = train_and_test(prepared, model_type, own)
        trained.model.write().overwrite().save(folders.model(run_id))
        for subset in ("train", "test"):
            warehouse.write_predictions(scored[subset], folders.predictions, run_id, subset)
        warehouse.write_by_run(
            coefficients(trained.model, prepared).withColumn("run_id", F.lit(run_id)), folders.coefs
        )
        row = {
            "run_id": run_id, "sweep_id": sweep, "options": options.tag(ref_date), "grid_order": i * len(options.model_types) + j,
            "n_samples": n, "model_type": model_type, "seed": own.seed, **stats,
        }
        warehouse.write_by_run(spark.createDataFrame([tuple(row.get(c) for c in STATS_SCHEMA.names)], STATS_SCHEMA), folders.stats)

    with ThreadPoolExecutor(max(1, options.parallelism)) as pool:
        begun = []
        for i, n in enumerate(options.n_samples):
            runs = {f"{sweep}.N{n:02d}.{m}": (j, m) for j, m in enumerate(options.model_types)}
            if done.issuperset(runs):
                continue
            own = replace(options, seed=options.seed + i)
            table = features.filter(F.col("n_samples") == n).drop("n_samples")
            prepared = prepare_training(table, own, f"{root}/training", f"{sweep}.N{n:02d}")
            begun += [pool.submit(record, (run_id, i, n, j, m, prepared, own)) for run_id, (j, m) in runs.items() if run_id not in done]
        for run in begun:
            run.result()
    if not warehouse.is_committed(spark, folders.sweeps, sweep):
        written = warehouse.read_if_there(spark, folders.stats, STATS_SCHEMA).filter(F.col("sweep_id") == sweep)
        warehouse.write_by_run(best_run(written.select(*STATS_SCHEMA.names)), folders.runs)
    warehouse.commit_sweep(spark, folders.sweeps, sweep, f"{options.tag(ref_date)}.{options.digest()}")
    return recorded_runs(spark, root, options, ref_date)


def recorded_runs(spark: SparkSession, root: str, options: ModelOptions, ref_date: str) -> DataFrame:
    """The runs of the last complete sweep with exactly these options."""
    folders = RunFolders(root)
    sweep = warehouse.last_sweep(spark, folders.sweeps, f"{options.tag(ref_date)}.{options.digest()}")
    if sweep is None:
        raise LookupError(f"no recorded sweep for {options.tag(ref_date)} with these options")
    return spark.read.parquet(folders.runs).filter(F.col("sweep_id") == sweep)


def predict_current(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, options: ModelOptions,
    train_ref: str, ref: str, feature_folder: str | None = None,
) -> DataFrame:
    """Score today's customers with the best recorded run; features plus ``p_cutoff``.

    Customers with a history shorter than the window have missing features; the model fills them
    with what it learned in training.
    """
    folders = RunFolders(root)
    best = recorded_runs(spark, root, options, train_ref).filter("is_best").select("run_id", "n_samples").first()
    n = best["n_samples"]
    features = complete_features(feature_tables(tables, ref, "predict", [n]), "predict")
    if feature_folder is None:
        feature_folder = warehouse.new_folder(spark, "features")
    # Written once: the scores and the returned rows both start from the stored table.
    warehouse.write_feature_table(features, feature_folder, "predict", ref)
    features = warehouse.read_feature_table(spark, feature_folder, "predict", ref, n).drop("n_samples")
    model = PipelineModel.load(folders.model(best["run_id"]))
    scored = score(model, features)
    warehouse.write_predictions(scored, folders.predictions, f"predict.{ref}.{best['run_id']}", "predict")
    return features.join(scored.select("occupant_id", "p_cutoff"), "occupant_id")
