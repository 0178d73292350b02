import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from ebbline.operators import metrics, modeling, risk
from ebbline.sources import warehouse

KEY = "occupant_id string, segment int, window int"


def training(spark, n=600, seed=5):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        late = rnd.random()
        y = int(late + rnd.gauss(0, 0.15) > 0.8)
        data.append((f"{i}-001", i % 3, 0, y, late, rnd.random(), rnd.choice([0.0, 0.1])))
    return spark.createDataFrame(data, f"{KEY}, cutoff_strict int, f_late double, f_zero_vol double, f_anom3_vol double")


@pytest.fixture(scope="module")
def options():
    return modeling.ModelOptions(trees=10, folds=3, max_depths=(2, 3), reg_params=(0.001, 0.1), n_samples=(6,))


@pytest.fixture(scope="module")
def prepared(spark, options):
    return modeling.prepare_training(training(spark), options, warehouse.new_folder(spark, "t"), "p")


def auc_by_pairs(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_equals_counting_pairs(spark, seed):
    rnd = random.Random(seed)
    scores = [0.0, 1.0, 1e-9, 1 - 1e-9, 0.5]
    pairs = [(rnd.randrange(2), rnd.choice(scores) if rnd.random() < 0.5 else rnd.random() ** 6) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y int, p double")
    got = metrics.score_metrics(df, "y", "p").first()
    assert math.isclose(got["auc"], auc_by_pairs(pairs), rel_tol=1e-12)
    assert got["n"] == 300 and got["logloss"] > 0


def test_auc_equals_mllib_without_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    df = training(spark).select(F.col("cutoff_strict").alias("label"), F.col("f_late").alias("p"))
    want = BinaryClassificationEvaluator().evaluate(
        df.withColumn("rawPrediction", array_to_vector(F.array(1 - F.col("p"), F.col("p"))))
    )
    assert math.isclose(metrics.roc_auc(df, "label", "p").first()[0], want, abs_tol=1e-9)


@pytest.mark.parametrize("sizes", [(0, 1), (1, 2), (5, 35), (10, 100)])
def test_exact_split_sizes(spark, sizes):
    cut, nocut = sizes
    data = [(f"c{i}-001", 0, 0, 1) for i in range(cut)] + [(f"n{i}-001", 0, 0, 0) for i in range(nocut)]
    df = spark.createDataFrame(data, f"{KEY}, cutoff_strict int")
    got = {(r["stratum"], r["subset"]): r["count"] for r in modeling.stratified_split(df).groupBy("stratum", "subset").count().collect()}
    for stratum, n in (("cut0", cut), ("nocut", nocut)):
        test = math.ceil(0.2 * n) if n > 1 else 0
        assert got.get((stratum, "test"), 0) == test
        assert got.get((stratum, "train"), 0) == n - test


def test_split_puts_last_cut_segment_first(spark):
    df = spark.createDataFrame(
        [("a", 0, 0, 1), ("a", 2, 0, 1), ("a", 2, 1, 0), ("b", 0, 0, 1)], f"{KEY}, cutoff_strict int")
    got = {(r[0], r[1], r[2]): r["stratum"] for r in modeling.stratified_split(df).select("occupant_id", "segment", "window", "stratum").collect()}
    assert got == {("a", 0, 0): "cut1", ("a", 2, 0): "cut0", ("a", 2, 1): "nocut", ("b", 0, 0): "cut0"}


def test_hash_split_is_near_the_share(spark):
    got = modeling.stratified_split(training(spark, 2000), split="hash").filter("subset = 'test'").count()
    assert 330 < got < 470


def test_weights_average_one_and_folds_are_even(spark, prepared):
    train = prepared.filter("subset = 'train'")
    assert math.isclose(train.agg(F.avg("weights")).first()[0], 1.0)
    sizes = [r["count"] for r in train.groupBy("cutoff_strict", "fold").count().orderBy("cutoff_strict", "count").collect()]
    assert max(sizes[:3]) - min(sizes[:3]) <= 1 and max(sizes[3:]) - min(sizes[3:]) <= 1


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_models_learn_a_separable_problem(spark, prepared, options, kind):
    trained, scored, stats = modeling.train_and_test(prepared, kind, options)
    assert stats["auc_test"] > 0.9 and stats["auc_xval"] > 0.9
    assert scored["xval"].count() == prepared.filter("subset = 'train'").count()
    coefs = {r["name"]: r["value"] for r in modeling.coefficients(trained.model, prepared).collect()}
    assert abs(coefs["f_late"]) == max(abs(v) for k, v in coefs.items() if k != "Intercept")


def test_forest_with_many_categories(spark):
    wide = modeling.ModelOptions(trees=2, folds=2, max_depths=(2,), n_samples=(6,), with_meta=True)
    table = training(spark).withColumns({
        "cust_type_code": F.lit("R"), "meter_size": F.lit("1"),
        "municipality": F.concat(F.lit("m"), F.expr("pmod(xxhash64(occupant_id), 200)")),
    })
    train = modeling.prepare_training(table, wide, warehouse.new_folder(spark, "wide"), "p").filter("subset = 'train'")
    assert train.select("municipality").distinct().count() > 64
    assert modeling.train_forest(train, wide).cv_auc is not None


def test_missing_input_counts_as_the_training_mean(spark, prepared, options):
    train = prepared.filter("subset = 'train'")
    mean = train.agg(F.sum(F.col("f_zero_vol") * F.col("weights")) / F.sum("weights")).first()[0]
    for kind in ("logistic_regression", "random_forest"):
        trained = modeling.TRAINERS[kind](train, options)
        few = prepared.orderBy("occupant_id").limit(5)
        scores = []
        for value in (F.lit(None).cast("double"), F.lit(float("nan")), F.lit(mean)):
            rows = modeling.score(trained.model, few.withColumn("f_zero_vol", value)).collect()
            scores.append(sorted((r["occupant_id"], r["p_cutoff"]) for r in rows))
        assert scores[0] == scores[1] == scores[2] and all(0 <= p <= 1 for _, p in scores[0])
    means, lacking = modeling.missing_values(train, options.features)
    assert math.isclose(means["f_zero_vol"], mean) and lacking == []
    given = modeling.score_linear(few.withColumn("f_late", F.lit(None).cast("double")), {"intercept": 0.0, "f_late": 1.0}, {"f_late": 2.0})
    assert math.isclose(given.first()["p_cutoff"], 1 / (1 + math.exp(-2)))
    nan = spark.createDataFrame([(float("nan"),), (None,), (60.0,), (40.0,)], "p_cutoff double")
    assert [r[0] for r in risk.at_risk(nan, 50).collect()] == [60.0]


def test_a_forest_knows_that_an_input_was_missing(spark, options):
    """Where training rows lack an input when they are cut, so will be those that lack it later."""
    table = training(spark, 400).withColumn("f_zero_vol", F.when(F.col("cutoff_strict") == 0, F.col("f_zero_vol")))
    train = modeling.prepare_training(table, options, warehouse.new_folder(spark, "t"), "m").filter("subset = 'train'")
    trained = modeling.train_forest(train, options)
    assert "f_zero_vol_missing" in [r["name"] for r in modeling.coefficients(trained.model, train).collect()]
    scored = modeling.score(trained.model, table).groupBy("cutoff_strict").agg(F.avg("p_cutoff")).collect()
    assert {r[0]: round(r[1]) for r in scored} == {0: 0, 1: 1}


def test_the_path_starts_where_the_first_feature_enters(spark, prepared, options):
    train = prepared.filter("subset = 'train'")
    search = modeling.GridSearch(train, options, modeling.feature_stages(options.features, True, modeling.missing_values(train, options.features)[0]))
    path = modeling.penalty_path(search.rows, 5, 1e-4, 0.5)
    assert len(path) == 5 and math.isclose(path[-1] / path[0], 1e-4) and path == sorted(path, reverse=True)
    zero = [modeling._logistic(train, path[0] * k).setTol(1e-10).fit(search.rows).coefficients.numNonzeros() for k in (1.001, 0.98)]
    assert zero == [0, 1]


def test_the_chosen_penalty_has_the_lowest_log_loss(spark, prepared):
    train = prepared.filter("subset = 'train'")
    own = modeling.ModelOptions(folds=3, path_length=8, patience=2)
    trained = modeling.train_logistic(train, own)
    assert modeling.optimality(trained.model, train).filter("gap > 1e-6").count() == 0
    loss = {p: modeling.metrics.score_metrics(modeling.train_logistic(train, modeling.ModelOptions(folds=3, reg_params=(p,))).cv, modeling.LABEL, "p_cutoff").first()["logloss"]
            for p in (trained.model.stages[-1].getRegParam(), 5.0)}
    assert min(loss, key=loss.get) < 5.0


def test_plain_logistic_has_p_values_and_full_rank(spark, prepared):
    options = modeling.ModelOptions(folds=3, regularization=False, with_meta=True)
    train = prepared.filter("subset = 'train'").withColumns({
        "cust_type_code": F.when(F.crc32(F.col("occupant_id").cast("binary")) % 3 > 0, "A").otherwise("B"), "municipality": F.lit("one"),
        "meter_size": F.when(F.crc32(F.col("occupant_id").cast("binary")) % 3 > 0, "big").otherwise("small"), "f_anom3_vol": F.col("f_zero_vol") * 2})
    trained = modeling.train_logistic(train, options)
    got = {r["name"]: r for r in modeling.coefficients(trained.model, train).collect()}
    assert set(got) == {"f_late", "f_zero_vol", "cust_type_code_onehot_B", "Intercept"}  # what adds no rank is left out
    assert got["f_late"]["p_value"] < 0.01 and all(r["std_error"] > 0 for r in got.values())
    assert modeling.optimality(trained.model, train).filter("gap > 1e-7").count() == 0


def test_smote_balances_and_stays_between_neighbours(spark):
    base = training(spark).select("occupant_id", "segment", "window", "cutoff_strict", "f_late", "f_zero_vol")
    copies = spark.createDataFrame([(f"same{i}", 0, 0, 1, 0.9, 0.5) for i in range(8)], base.schema)
    out = modeling.smote_oversample(base.unionByName(copies), ["f_late", "f_zero_vol"]).cache()
    counts = {r["cutoff_strict"]: r["count"] for r in out.groupBy("cutoff_strict").count().collect()}
    assert counts[0] == counts[1]
    made = out.filter("synthetic = 1")
    assert made.filter("cutoff_strict <> 1 or f_late < 0.3 or f_late > 1").count() == 0
    # copies of one point have each other as neighbours
    assert made.filter("occupant_id like '%same%' and (f_late <> 0.9 or f_zero_vol <> 0.5)").count() == 0


def test_options():
    assert modeling.ModelOptions(anom="none").features == ["f_late", "f_zero_vol"]
    full = modeling.ModelOptions(anom="manom", with_meta=True, with_cut_prior=True)
    assert full.features == ["f_late", "f_zero_vol", "f_manom3_vol", "cust_type_code", "municipality", "meter_size", "cut_prior"]
    assert full.tag("2000-06-30") == "train.2000-06-30.with_cut_prior.with_meta.manom"
    with pytest.raises(ValueError):
        modeling.feature_names("both")


def test_first_wins_a_tie(spark):
    runs = spark.createDataFrame([("x", "o", 1, 0.8), ("y", "o", 0, 0.8), ("z", "o", 2, None)],
                                 "run_id string, options string, grid_order int, auc_xval double")
    assert [r["run_id"] for r in modeling.best_run(runs).filter("is_best").collect()] == ["y"]


def test_sweep_registry_and_prediction(spark, clean_stage):
    from ebbline.catalog.fixtures import PREDICT_REF, TRAIN_REF
    from ebbline.operators.features import feature_sweep

    options = modeling.ModelOptions(n_samples=(4, 6), trees=5, folds=2, max_depths=(2,), reg_params=(0.01,),
                                    model_types=("random_forest",), with_meta=True)
    root = warehouse.new_folder(spark, "sweep")
    runs = modeling.train_sweep(spark, feature_sweep(clean_stage, TRAIN_REF, n_samples=(4, 6)), root, options, TRAIN_REF)
    assert runs.count() == 2 and runs.filter("is_best").count() == 1
    best = runs.filter("is_best").first()["run_id"]
    folders = modeling.RunFolders(root)
    assert warehouse.best_of(spark.read.parquet(folders.coefs), runs).select("run_id").distinct().first()[0] == best
    first = modeling.predict_current(spark, clean_stage, root, options, TRAIN_REF, PREDICT_REF)
    again = modeling.predict_current(spark, clean_stage, root, options, TRAIN_REF, PREDICT_REF)
    scores = [sorted((r["occupant_id"], r["p_cutoff"]) for r in d.select("occupant_id", "p_cutoff").collect()) for d in (first, again)]
    assert scores[0] == scores[1] and scores[0] and all(0 <= p <= 1 for _, p in scores[0])


def test_a_sweep_is_seen_when_it_is_complete_and_goes_on_where_it_stopped(spark, monkeypatch):
    options = modeling.ModelOptions(n_samples=(4, 6), trees=3, folds=2, max_depths=(2,), model_types=("random_forest",))
    table = training(spark, 200).withColumn("n_samples", F.explode(F.array(F.lit(4), F.lit(6))))
    root = warehouse.new_folder(spark, "sweep")
    real, calls = modeling.train_and_test, []

    def stops(prepared, kind, own):
        calls.append(own.seed)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return real(prepared, kind, own)

    monkeypatch.setattr(modeling, "train_and_test", stops)
    with pytest.raises(RuntimeError):
        modeling.train_sweep(spark, table, root, options, "2000-01-01")
    with pytest.raises(LookupError):
        modeling.recorded_runs(spark, root, options, "2000-01-01")
    runs = modeling.train_sweep(spark, table, root, options, "2000-01-01")
    assert calls == [1, 2, 2] and sorted(r["seed"] for r in runs.collect()) == [1, 2] and runs.filter("is_best").count() == 1
    # other features or options are another sweep, and its runs never meet these
    modeling.train_sweep(spark, table.filter("segment < 2"), root, options, "2000-01-01")
    last = modeling.recorded_runs(spark, root, options, "2000-01-01")
    assert last.count() == 2 and not {r["run_id"] for r in last.collect()} & {r["run_id"] for r in runs.collect()}
    with pytest.raises(LookupError):
        modeling.recorded_runs(spark, root, modeling.replace(options, trees=4), "2000-01-01")
    modeling.train_sweep(spark, table, root, options, "2000-01-01")
    assert len(calls) == 5  # nothing is trained twice
    assert {r["run_id"] for r in modeling.recorded_runs(spark, root, options, "2000-01-01").collect()} == {r["run_id"] for r in runs.collect()}


def test_runs_of_a_sweep_go_on_side_by_side_and_share_the_fits(spark, monkeypatch):
    options = modeling.ModelOptions(n_samples=(4, 6), trees=3, folds=2, max_depths=(2,), reg_params=(0.1,), parallelism=2)
    table = training(spark, 200).withColumn("n_samples", F.explode(F.array(F.lit(4), F.lit(6))))
    real, fit, met, at_once, most = modeling.train_and_test, modeling.GridSearch.fit, threading.Barrier(2), [], []

    def waits(prepared, kind, own):
        met.wait(300)  # breaks where runs go one after another
        return real(prepared, kind, own)

    def counted(search, *args):
        at_once.append(1)
        most.append(len(at_once))
        try:
            return fit(search, *args)
        finally:
            at_once.pop()

    monkeypatch.setattr(modeling, "train_and_test", waits)
    monkeypatch.setattr(modeling.GridSearch, "fit", counted)
    root = warehouse.new_folder(spark, "sweep")
    together = modeling.train_sweep(spark, table, root, options, "2000-01-01").orderBy("grid_order").collect()
    assert [r["grid_order"] for r in together] == [0, 1, 2, 3] and max(most) <= 2


def test_map_cells_hold_every_customer_once(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice([rnd.uniform(-90, 90), 40.0 + rnd.random() / 1000]), rnd.choice([rnd.uniform(-180, 180), -80.0]), float(i)) for i in range(300)]
    points += [(1000 + i, 10.0, 20.0, 1.0) for i in range(30)] + [(2000, None, 1.0, 5.0), (2001, 90.0, 180.0, 5.0)]
    df = spark.createDataFrame(points, "location_id int, latitude double, longitude double, p_cutoff double")
    cells = risk.map_cells(df, "p_cutoff", threshold=None, limit=10, deepest=12).collect()
    assert sum(r["customers"] for r in cells) == len(points)
    for r in cells:
        if r["cell"] is None:
            assert r["customers"] == 1 and r["value"] == 5.0
            continue
        inside = [p for p in points if p[1] is not None and r["south"] <= p[1] and (p[1] < r["north"] or r["north"] == 90)
                  and r["west"] <= p[2] and (p[2] < r["east"] or r["east"] == 180)]
        assert len(inside) == r["customers"] and (r["customers"] <= 10 or r["level"] == 12)
        assert math.isclose(r["value"], sum(p[3] for p in inside) / len(inside))


def test_shares_of_several_categories_equal_those_of_each(spark):
    df = spark.createDataFrame([(60.0, "a", 1), (70.0, None, 1), (80.0, "a", None), (90.0, "b", 2), (10.0, "a", 2)], "p_cutoff double, cust_type string, municipality int")
    many = {(r["category"], r["value"]): r["share"] for r in risk.category_shares(df, ["cust_type", "municipality"]).collect()}
    one = {(c, None if r[c] is None else str(r[c])): r["share"] for c in ("cust_type", "municipality") for r in risk.category_share(df, c).collect()}
    assert many == one and many[("cust_type", None)] == 0 and many[("cust_type", "a")] == 50


def test_risk_edges(spark):
    df = spark.createDataFrame(
        [(1, "a", 60.0, 100.0, 1.0, 5.0, 2, "R"), (2, "b", 80.0, 200.0, 0.0, 5.0, 0, None), (3, "c", 10.0, 1.0, 1.0, 1.0, 9, "R")],
        "location_id bigint, occupant_id string, p_cutoff double, mean_charge_tot double, mean_charge_late double, mean_vol double, nCutPrior int, cust_type string")
    assert risk.predicted_cutoffs(df).first()[0] == 2
    got = {r["feature"]: (round(r["total"], 6), r["mean"]) for r in risk.expected_values(df).collect()}
    assert got["mean_charge_tot"][0] == 0.22 and got["nCutPrior"][0] == 1.2
    none = risk.expected_values(df, 99).first()
    assert none["total"] == 0 and none["mean"] is None
    shares = {r["cust_type"]: r["share"] for r in risk.category_share(df, "cust_type").collect()}
    assert shares == {"R": 50.0, None: 0.0}
    names = risk.anonymize(df.withColumn("meter_address", F.lit("x"))).select("meter_address").distinct().count()
    assert names == 3


def test_shared_folder_comes_from_the_session(spark):
    assert warehouse.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def _rows_with_likes(spark, n=600):
    """Rows of few different features, labels and weights; the classes are not told apart fully."""
    data = [(f"o{i}", 0, 0, (i % 5) / 4, (i % 3) / 2, 0.0 if i % 7 else 0.5, int((i * 37) % 11 < 2 + i % 5), i) for i in range(n)]
    table = spark.createDataFrame(data, "occupant_id string, segment int, window int, f_late double, f_zero_vol double, f_anom3_vol double, cutoff_strict int, n int")
    train = table.withColumns({"weights": F.expr("CASE WHEN cutoff_strict = 1 THEN 2.5D ELSE 0.75D END"), "fold": F.expr("n div 105 % 5")})
    return train.drop("n")


def test_equal_rows_are_fitted_once_with_the_result_of_all_rows(spark):
    train, options = _rows_with_likes(spark), modeling.ModelOptions()
    stages = modeling.feature_stages(options.features, True, modeling.missing_values(train, options.features)[0])
    search = modeling.GridSearch(train, options, stages)
    assert search.rows.count() == train.select(*options.features, "cutoff_strict", "fold").distinct().count() < 600
    every_row = search.encoder.transform(train)
    for fold in (None, 2):
        kept = every_row if fold is None else every_row.filter(F.col("fold") != fold)
        estimator = modeling._logistic(train, 0.01).setTol(1e-10).setMaxIter(500)
        found, known = search.fit(estimator, fold), estimator.copy().fit(kept)
        assert abs(found.coefficients.toArray() - known.coefficients.toArray()).max() < 1e-6 and abs(found.intercept - known.intercept) < 1e-6
        assert (found.getRegParam(), found.getElasticNetParam()) == (0.01, 0.5)
    search.run([modeling._logistic(train, 0.01)])
    held_out = search.held_out(0)
    assert held_out.count() == held_out.select("occupant_id").distinct().count() == 600 and held_out.filter("p_cutoff IS NULL").isEmpty()
    own = modeling.metrics.score_metrics(held_out, "cutoff_strict", "p_cutoff").first()
    assert abs(own["auc"] - search.stats[0]["auc"]) < 1e-12 and abs(own["logloss"] - search.stats[0]["logloss"]) < 1e-12


def test_a_forest_takes_blocks_of_copies_and_single_rows_where_there_are_none(spark, monkeypatch):
    options = modeling.ModelOptions()
    train = _rows_with_likes(spark).withColumns({"f_zero_vol": F.lit(0.0), "f_anom3_vol": F.lit(0.5)})
    stages = modeling.feature_stages(options.features, False, modeling.missing_values(train, options.features)[0])
    search = modeling.GridSearch(train, options, stages)
    assert search.use_blocks() == 1 and search.fitted.count() == 600
    monkeypatch.setattr(modeling, "BLOCKS", 200)
    size = search.use_blocks()
    assert 1 < size <= 3 and search.fitted.count() < 600
    by_class = {r[0]: r[1] for r in search.fitted.groupBy("cutoff_strict").agg(F.sum("weights")).collect()}
    known = {r[0]: r[1] for r in train.groupBy("cutoff_strict").agg(F.sum("weights")).collect()}
    assert by_class.keys() == known.keys() and all(abs(by_class[k] - known[k]) < 1e-6 for k in known)
    alone = train.withColumn("f_late", F.xxhash64("occupant_id") / 1e20)
    assert modeling.GridSearch(alone, options, stages).use_blocks() == 1
