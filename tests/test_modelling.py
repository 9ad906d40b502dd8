import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.operators import forest as FO
from convlens.operators import modelling as M
from convlens.operators import splitting as SP


@pytest.fixture(scope="module")
def t(spark):
    """A planted signal: the label depends on a, and on b and c together."""
    base = spark.range(0, 4000, numPartitions=4).select(
        F.col("id"),
        *[
            (F.pmod(F.hash("id", F.lit(s)), F.lit(1000)) / 1000.0).alias(name)
            for s, name in [(1, "a"), (2, "b"), (3, "c"), (4, "noise"), (5, "_u")]
        ],
    )
    chance = 0.1 + 0.4 * F.col("a") + 0.4 * ((F.col("b") > 0.5) & (F.col("c") > 0.5)).cast("int")
    t = base.withColumn("y", (F.col("_u") < chance).cast("int")).drop("_u")
    return SP.kfold(SP.stratified_split(t, "y", "id"), "id", 3).cache()


FEATURES = ["a", "b", "c", "noise"]


@pytest.fixture(scope="module")
def forest(t):
    return M.random_forest(trees=20, depth=6).fit(t.where("split = 'train'"), FEATURES, "y")


def test_models_find_the_signal(t):
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    models = [None, M.logistic_regression(50), M.random_forest(20, 6)]
    rows = {r["model"]: r for r in M.compare(train, test, FEATURES, "y", "id", models).collect()}
    assert rows["M2 RandomForest"]["roc_auc"] > 0.7
    assert rows["M1 LogReg"]["roc_auc"] > 0.65
    assert abs(rows["M0 Dummy"]["roc_auc"] - 0.5) < 0.06
    n = test.count()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == n for r in rows.values())
    best = M.best_model(t.sparkSession.createDataFrame(list(rows.values()))).first()
    assert best["f1"] == max(r["f1"] for r in rows.values())


def test_scores_are_probabilities_and_repeatable(t, forest):
    a = M.score(forest, t).orderBy("id").collect()
    assert all(0.0 <= r["score"] <= 1.0 and r["prediction"] in (0.0, 1.0) for r in a)
    assert a == M.score(forest, t).orderBy("id").collect()


def test_importances_sum_to_one_and_rank_noise_last(t, forest):
    rows = M.feature_importance(forest, t).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=1e-4)
    assert rows[-1]["feature"] == "noise" and len(rows) == len(FEATURES)
    assert M.feature_importance(forest, t, 2).count() == 2


def test_leaves_found_tree_by_tree_are_those_of_a_walk(t, forest):
    roots, feature, cut, left, _, depth = forest.arrays
    bins = np.random.default_rng(5).integers(0, FO.BINS, (200, len(FEATURES))).astype(np.uint8)
    at = np.repeat(roots[None, :], len(bins), 0)
    for _ in range(40):
        at = left[at] + (bins[np.arange(len(bins))[:, None], feature[at]] > cut[at])
    assert (FO._leaves(bins, roots, feature, cut, left, depth) == at).all()
    assert depth.max() <= 6 and len(depth) == len(roots) == 20


def test_features_are_assembled_once_for_all_folds(t, monkeypatch):
    """Folds share the staged vectors, and give the scores of fits that assemble their own."""
    from pyspark.ml.feature import VectorAssembler

    calls, own = [], VectorAssembler._transform
    monkeypatch.setattr(VectorAssembler, "_transform", lambda self, d: calls.append(1) or own(self, d))
    train = t.where("split = 'train'")
    crossed = M.cross_scores(train, FEATURES, "y", "id", [M.logistic_regression(30)], folds=3)
    assert len(calls) == 1
    alone = M.logistic_regression(30).fit(train.where("fold != 1"), FEATURES, "y")
    assert M.feature_list(alone) == FEATURES
    want = sorted(r["score"] for r in M.score(alone, train.where("fold = 1")).collect())
    assert sorted(r["score"] for r in crossed.where("fold = 1").collect()) == pytest.approx(want, abs=1e-6)


def test_missing_feature_is_an_error(t, forest):
    with pytest.raises(ValueError, match="noise"):
        M.score(forest, t.drop("noise"))
    with pytest.raises(ValueError, match="duration"):
        M.assert_no_leakage(["a", "duration"], ["duration"])


def test_saved_model_scores_the_same(t, forest, tmp_path):
    M.save_model(forest, str(tmp_path / "forest"))
    again = M.load_model(str(tmp_path / "forest"))
    assert M.feature_list(again) == FEATURES
    assert [r["feature"] for r in M.feature_list_table(again, t).orderBy("position").collect()] == FEATURES
    a = M.score(forest, t).agg(F.sum("score")).first()[0]
    assert M.score(again, t).agg(F.sum("score")).first()[0] == pytest.approx(a, rel=1e-9)


def test_cross_validation_and_model_card(t):
    models = [None, M.logistic_regression(30)]
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    cv = M.cross_validate(train, FEATURES, "y", "id", models, folds=3)
    row = cv.where("model = 'M1 LogReg'").first()
    assert row["test_roc_auc_mean"] > 0.65 and 0 <= row["test_roc_auc_std"] < 0.1
    card = M.model_card(M.compare(train, test, FEATURES, "y", "id", models), cv)
    assert card.count() == 2 and {"roc_auc", "test_roc_auc_mean"} <= set(card.columns)


def test_split_is_stratified_and_repeatable(t):
    sizes = {(r["y"], r["split"]): r["count"] for r in t.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        share = sizes[y, "test"] / (sizes[y, "test"] + sizes[y, "train"])
        assert abs(share - 0.2) < 0.04
    again = SP.stratified_split(t.drop("split").repartition(7), "y", "id")
    assert again.exceptAll(t.select(*again.columns)).count() == 0


def test_exact_split_meets_the_quota(t):
    exact = SP.stratified_split(t.drop("split"), "y", "id", 0.2, exact=True)
    for r in exact.groupBy("y").agg(F.count_if(F.col("split") == "test"), F.count("*")).collect():
        assert r[1] == int(0.2 * r[2] + 0.5)


def test_folds_cover_all_rows_evenly(t):
    sizes = [r["count"] for r in t.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 0.9 * t.count() / 3


def test_class_weights_balance(t):
    w = SP.with_class_weights(t, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(w[1]["w"])


def test_forest_does_not_follow_partitions_or_order(t):
    train = t.where("split = 'train'").select("id", "y", *FEATURES)
    fits = [
        FO.fit_forests(train.repartition(n).orderBy(F.rand(n)) if n == 64 else train.repartition(n), FEATURES, "y", "id", trees=12, depth=6)[-1]
        for n in (4, 64, 200)
    ]
    assert fits[0].importances() == fits[1].importances() == fits[2].importances()
    order = ["tree", "node"]
    for other in fits[1:]:
        assert fits[0].nodes.sort_values(order, ignore_index=True).equals(other.nodes.sort_values(order, ignore_index=True))


def test_forest_of_a_fold_has_not_seen_it(t):
    """The labels of a fold change nothing in the forest that leaves it out, and all in the others."""
    flipped = t.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    a = FO.fit_forests(t, FEATURES, "y", "id", "fold", 3, trees=8, depth=5, whole=False)
    b = FO.fit_forests(flipped, FEATURES, "y", "id", "fold", 3, trees=8, depth=5, whole=False)
    same = [a[k].nodes.sort_values(["tree", "node"], ignore_index=True).equals(b[k].nodes.sort_values(["tree", "node"], ignore_index=True)) for k in range(3)]
    assert same == [False, True, False]


def test_first_split_is_the_best_of_all_splits():
    rng = np.random.default_rng(3)
    for _ in range(20):
        bins = rng.integers(0, 6, (80, 3)).astype(np.uint8)
        y, count, weight = rng.integers(0, 2, 80), rng.integers(1, 4, 80), rng.choice([0.5, 2.0], 80)
        nodes = FO.grow(bins, y, count, weight, 1, 10, 3, np.random.default_rng(0))

        def gini(m):
            w, p = (weight * count)[m].sum(), (weight * count * y)[m].sum()
            return 2 * p * (w - p) / w if w else 0.0

        best = 0.0
        for f in range(3):
            for c in range(6):
                left = bins[:, f] <= c
                if count[left].sum() >= 10 and count[~left].sum() >= 10:
                    best = max(best, gini(np.ones(80, bool)) - gini(left) - gini(~left))
        assert nodes[0][4] == pytest.approx(best)
        f, c, child = nodes[0][:3]
        for m, node in ((bins[:, f] <= c, nodes[child]), (bins[:, f] > c, nodes[child + 1])):
            assert node[3] == pytest.approx((weight * count * y)[m].sum() / (weight * count)[m].sum())


def test_scores_are_means_of_leaves(t, forest):
    rows = M.score(forest, t).limit(40).toPandas()
    for _, r in rows.iterrows():
        bins = [int(np.searchsorted(e, r[f], side="left")) for f, e in zip(forest.features, forest.edges)]
        leaves = []
        for _, tree in forest.nodes.groupby("tree"):
            tree = tree.set_index("node")
            at = 0
            while tree.loc[at, "feature"] >= 0:
                at = tree.loc[at, "left"] + (bins[tree.loc[at, "feature"]] > tree.loc[at, "cut"])
            leaves.append(tree.loc[at, "probability"])
        assert r["score"] == pytest.approx(np.mean(leaves))


def test_large_tables_give_each_tree_a_slice(t):
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    model = FO.fit_forests(train, FEATURES, "y", "id", trees=30, depth=6, tree_rows=400)[-1]
    assert M.evaluate(M.score(model, test), "y").first()["roc_auc"] > 0.65
    assert model.nodes.groupby("tree").size().max() <= 2 * 400 * 1.6 / 20


def test_missing_values_and_one_class(t):
    holes = t.withColumn("a", F.when(F.col("a") > 0.2, F.col("a"))).where("split = 'train'")
    scores = M.score(M.random_forest(5, 4).fit(holes, FEATURES, "y"), holes).agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] < scores[1] <= 1
    one = t.where("y = 0")
    assert M.score(M.random_forest(3, 3).fit(one, FEATURES, "y"), one).agg(F.max("score")).first()[0] == 0.0


def test_each_row_is_scored_once_by_each_model(t):
    models = [None, M.random_forest(5, 4)]
    out = M.cross_scores(t, FEATURES, "y", "id", models, folds=3)
    sizes = {(r["model"], r["fold"]): r["count"] for r in out.groupBy("model", "fold").count().collect()}
    want = {r["fold"]: r["count"] for r in t.groupBy("fold").count().collect()}
    assert sizes == {(m, k): n for m in ("M0 Dummy", "M2 RandomForest") for k, n in want.items()}


def test_every_tree_and_bin_of_a_large_table_comes_from_all_rows(spark):
    """More rows than one tree used to see, and than the sample that used to set the bins."""
    rows = spark.range(0, 60_000, numPartitions=5).withColumn("y", (F.pmod(F.hash("id"), F.lit(10)) < 3).cast("int"))
    rows = rows.withColumn("a", F.pmod(F.hash("id", F.lit(1)), F.lit(100_000)) / 7.0).withColumn("few", F.col("id") % 3)
    model = FO.fit_forests(rows, ["a", "few"], "y", "id", trees=3, depth=2)[-1]
    values = np.sort(rows.toPandas()["a"].to_numpy())
    assert model.edges[0].tolist() == np.unique(values[(np.arange(1, FO.BINS) * len(values)) // FO.BINS]).tolist()
    assert model.edges[1].tolist() == [0.0, 1.0]
    drawn = FO._unit(F.lit("bag-42"), F.col("id"), F.col("tree"))
    often = sum((drawn >= F.lit(p)).cast("int") for p in FO.POISSON)
    weight = {r["y"]: 60_000 / (2 * r["count"]) for r in rows.groupBy("y").count().collect()}
    bags = rows.withColumn("tree", F.explode(F.array(*[F.lit(i) for i in range(3)]))).groupBy("tree", "y").agg(F.sum(often).alias("n")).collect()
    for tree in range(3):
        mass = {r["y"]: weight[r["y"]] * r["n"] for r in bags if r["tree"] == tree}
        root = model.nodes.query("tree == @tree and node == 0").iloc[0]
        assert root["probability"] == pytest.approx(mass[1] / (mass[0] + mass[1]), rel=1e-12)


def test_bin_limits_are_exact_for_any_number_of_values(spark, monkeypatch):
    from convlens.operators import percentiles as P

    monkeypatch.setattr(P, "FEW", 50)
    t = spark.range(0, 5000, numPartitions=7).select(
        (F.pmod(F.hash("id"), F.lit(900)) / 3.0).alias("many"), F.when(F.col("id") > 9, F.pmod("id", F.lit(40))).alias("some"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 4).alias("few"), F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("id") % 40).alias("endless"),
    )
    found, table = P.bin_limits(t, t.columns, 32), t.toPandas()
    for c in ("many", "some"):
        x = np.sort(table[c].dropna().to_numpy(np.float64))
        assert found[c] == np.unique(x[(np.arange(1, 32) * len(x)) // 32]).tolist()
    assert (found["few"], found["one"], found["none"]) == ([0.0, 1.0, 2.0], [], [])
    assert found["endless"][0] == 1.0 and len(found["endless"]) == 31


def test_blocks_and_files_change_no_tree(monkeypatch):
    rng = np.random.default_rng(8)
    bins, y, count = rng.integers(0, 9, (3000, 4)).astype(np.uint8), rng.integers(0, 2, 3000), rng.integers(1, 5, 3000)
    weight = np.array([0.7, 1.9])[y]
    trees = [FO.grow(bins, y, count, weight, 8, 5, 2, np.random.default_rng(1))]
    monkeypatch.setattr(FO, "BLOCK", 170)
    monkeypatch.setattr(FO, "HELD", 500)
    monkeypatch.setattr(FO, "SEARCHED", 3)
    monkeypatch.setattr(FO, "SORTED", 4)
    trees.append(FO.grow(bins, y, count, weight, 8, 5, 2, np.random.default_rng(1)))
    mixed = rng.permutation(3000)
    trees.append(FO.grow(bins[mixed], y[mixed], count[mixed], weight[mixed], 8, 5, 2, np.random.default_rng(1)))
    assert trees[0] == trees[1] == trees[2] and len(trees[0]) > 100
