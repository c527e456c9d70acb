"""Least squares and learners against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pmtspark.operators import learners
from pmtspark.operators.absorb import tiled_gram, wls_absorbed
from pmtspark.operators.design import BASIC, EXTENDED, Design, observed_levels
from pmtspark.operators.learners import (
    binary_model,
    choose_penalty,
    fold_grams,
    forest,
    lasso_cv,
    lasso_design,
    lasso_path,
)
from pmtspark.operators.quantile_regression import NotConverged, quantile_regression
from pmtspark.operators.replicates import packed_rows, replicate_grams
from pmtspark.operators.regression import (
    cluster_covariance,
    coef_table,
    factor,
    fitted_table,
    poverty_weight,
    score,
    t_tail,
    unpack,
    wls,
)

N = 600


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(N):
        a, b = rng.normal(), rng.integers(0, 2)
        size = ["[1,3)", "[3,5)", "[5,7)"][rng.integers(0, 3)]
        region = str(rng.integers(1, 5))
        y = 1 + 0.5 * a - 0.7 * b + {"[1,3)": 0, "[3,5)": 0.3, "[5,7)": -0.2}[size]
        rows.append((i, float(a), bool(b), size, region, float(1 + i % 5), float(y + rng.normal() * 0.4)))
    df = spark.createDataFrame(
        rows, "id int, a double, b boolean, hhsize_fct string, region string, mult double, y double"
    ).cache()
    return df, Design.of(df, ("a", "b", "hhsize_fct", "region"))


def matrices(df, design):
    z = [c.alias(f"c{i}") for i, (_, c) in enumerate(design.columns())]
    got = np.array([list(r) for r in df.select(*z, "y", "mult").collect()], dtype=float)
    return got[:, :-2], got[:, -2], got[:, -1]


def test_design_names_and_levels(data):
    df, d = data
    assert d.names == ["(Intercept)", "a", "bTRUE", "hhsize_fct[3,5)", "hhsize_fct[5,7)",
                       "hhsize_fct[7,9)", "hhsize_fct[9,Inf)", "region2", "region3", "region4"]
    assert (len(BASIC), len(EXTENDED)) == (25, 45)
    unknown = df.withColumn("hhsize_fct", F.when(F.col("id") > 9, F.col("hhsize_fct")))
    assert d.complete(unknown).count() == N - 10


def test_wls_matches_numpy_and_drops_aliased(data):
    df, d = data
    x, y, w = matrices(df, d)
    row = wls(df, d, F.col("y"), F.col("mult")).first()
    # levels never seen give zero columns, which stay without a coefficient
    assert [i for i, b in enumerate(row.beta) if b is None] == [5, 6]
    keep = [0, 1, 2, 3, 4, 7, 8, 9]
    root = np.sqrt(w)[:, None]
    expected = np.linalg.lstsq(x[:, keep] * root, y * root[:, 0], rcond=None)[0]
    assert [row.beta[i] for i in keep] == pytest.approx(expected, rel=1e-9)
    again = df.withColumn("a2", 2 * F.col("a") + 1)
    twice = Design.of(again, ("a", "a2", "b"))
    beta = wls(again, twice, F.col("y"), F.col("mult")).first().beta
    assert beta[2] is None and None not in (beta[0], beta[1], beta[3])


def test_scores_by_lookup_equal_products(data):
    df, d = data
    for design in (d, lasso_design(d), d.with_options(intercept=False)):
        beta = np.random.default_rng(1).normal(size=len(design.names)).round(3)
        x, _, _ = matrices(df, design)
        rows = df.withColumn("beta", F.array(*map(F.lit, map(float, beta))))
        got = [r[0] for r in rows.select(design.dot("beta")).collect()]
        assert got == pytest.approx(x @ beta)


def test_residuals_are_orthogonal(data):
    df, d = data
    table = fitted_table(df, wls(df, d, F.col("y"), F.col("mult")), d, F.col("y"), "mult")
    sums = table.agg(F.sum(F.col("w") * F.col("resid")), F.sum(F.col("w") * F.col("resid") * F.col("a")),
                     F.sum("w")).first()
    assert list(sums) == pytest.approx([0, 0, 1], abs=1e-9)


def square(row, m):
    r = np.zeros((m, m))
    r[np.triu_indices(m)] = row.factor
    return r.T @ r


def test_factors_are_of_the_cross_products(data, monkeypatch):
    df, d = data
    z = [F.lit(1.0), F.col("a"), F.col("y")]
    rows = np.array([[1.0, r.a, r.y, r.mult, int(r.region)] for r in df.collect()])

    def plain(x):
        return (x[:, :3] * x[:, 3:4]).T @ x[:, :3]

    for chunk, cells in ((4096, 2**22), (7, 9)):
        monkeypatch.setattr("pmtspark.operators.regression.CHUNK_ROWS", chunk)
        monkeypatch.setattr("pmtspark.operators.regression.TASK_CELLS", cells)
        whole = factor(df.repartition(5), z, F.col("mult")).first()
        assert square(whole, 3) == pytest.approx(plain(rows)) and whole.n == N
        for r in factor(df.repartition(5), z, F.col("mult"), by=["region"]).collect():
            own = rows[rows[:, 4] == int(r.region)]
            assert square(r, 3) == pytest.approx(plain(own)) and r.n == len(own)
    assert factor(df.filter("id < 0"), z).count() == 0


def test_regressors_far_from_zero_keep_their_digits(data):
    df, _ = data
    far = df.withColumn("year", 2_000_000 + F.col("a")).withColumn("same", F.col("year") * 2 - 7)
    terms = ("year", "b", "same")
    near = wls(df, Design.of(df, ("a", "b")), F.col("y"), F.col("mult")).first().beta
    beta = wls(far, Design.of(far, terms), F.col("y"), F.col("mult")).first().beta
    assert beta[1:3] == pytest.approx(near[1:], rel=1e-6) and beta[3] is None
    table = cluster_covariance(far, Design.of(far, ("year", "b")), F.col("y"), F.col("mult"), "region")
    plain = cluster_covariance(df, Design.of(df, ("a", "b")), F.col("y"), F.col("mult"), "region")
    assert table.first().se[1:] == pytest.approx(plain.first().se[1:], rel=1e-6)


def test_null_weights_count_nowhere(data):
    df, narrow = data[0], Design.of(data[0], ("a", "b"))
    odd = df.withColumn("mult", F.when(F.col("id") != 7, F.col("mult")))
    odd = odd.withColumn("y", F.when(F.col("id") != 9, F.col("y")))
    full = df.filter("id NOT IN (7, 9)")
    for design in (narrow, data[1]):
        got = wls(odd, design, F.col("y"), F.col("mult")).first()
        expected = wls(full, design, F.col("y"), F.col("mult")).first()
        assert got.n == expected.n == N - 2
        pairs = zip(got.beta, expected.beta)
        assert all(a == b if b is None else a == pytest.approx(b, rel=1e-9) for a, b in pairs)


def test_no_fit_gives_no_prediction(data):
    df, _ = data
    for design in (Design.of(df, ("a", "b")), data[1]):
        fit = wls(df.filter("id < 0"), design, F.col("y"), F.col("mult"))
        assert score(df, fit, design).filter("log_yhat IS NOT NULL").count() == 0


def test_wide_fits_by_group(data):
    df, d = data
    df = df.withColumn("part", F.when(F.col("id") % 3 > 0, F.col("id") % 3))  # one group is NULL
    assert len(d.names) > 8
    fits = {r.part: r for r in wls(df, d, F.col("y"), F.col("mult"), by=["part"]).collect()}
    assert set(fits) == {None, 1, 2}
    for part, row in fits.items():
        own = df.filter(F.col("part").eqNullSafe(F.lit(part)))
        expected = wls(own, d, F.col("y"), F.col("mult")).first()
        assert row.n == expected.n
        assert [b for b in row.beta if b is not None] == pytest.approx(
            [b for b in expected.beta if b is not None], rel=1e-9
        )


def test_level_bound_is_per_column(spark, monkeypatch):
    monkeypatch.setattr("pmtspark.operators.design.MAX_LEVELS", 5)
    rows = spark.range(6).select(F.col("id").cast("string").alias("many"), F.lit("x").alias("one"))
    assert len(observed_levels(rows.filter("many < '5'"), ["many", "one"])["many"]) == 5
    with pytest.raises(ValueError, match="many"):
        observed_levels(rows, ["many", "one"])


def test_cluster_errors_match_numpy(data):
    df, _ = data
    d = Design.of(df, ("a", "b"))
    x, y, w = matrices(df, d)
    region = np.array([r.region for r in df.select("region").collect()])
    bread = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = bread @ x.T @ (w * y)
    e = y - x @ beta
    meat = sum(
        np.outer(s, s) for g in set(region) for s in [(x * (w * e)[:, None])[region == g].sum(0)]
    )
    g, k = len(set(region)), x.shape[1]
    v = bread @ meat @ bread * (g / (g - 1)) * ((N - 1) / (N - k))
    cov = cluster_covariance(df, d, F.col("y"), F.col("mult"), "region")
    row = cov.first()
    assert row.se == pytest.approx(np.sqrt(np.diag(v)), rel=1e-8)
    assert (row.n, row.clusters) == (N, g)
    table = coef_table(cov, d, omit="Intercept", strip="TRUE", digits=4)
    rows = {r.term: r for r in table.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].estimate == pytest.approx(beta[1], abs=1e-4)
    assert rows["a"].stars == "***"


# Two-sided critical points of Student's t.
@pytest.mark.parametrize(
    "t, df, p",
    [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (2.77645, 4, 0.05), (2.13185, 4, 0.1),
     (3.16927, 10, 0.01), (2.04227, 30, 0.05), (1.95996, 10000, 0.05), (0.0, 3, 1.0)],
)
def test_t_tail(t, df, p):
    assert t_tail(t, df) == pytest.approx(p, abs=2e-5)


def test_poverty_weights_and_median(data):
    df, _ = data
    d = Design.of(df, ("a",))
    low = wls(df, d, F.col("y"), poverty_weight(F.col("y"), F.lit(1.0), F.col("mult"))).first().beta
    direct = wls(df.filter("y <= 1"), d, F.col("y"), F.col("mult")).first().beta
    assert low == pytest.approx(direct)
    fit = quantile_regression(df, d, F.col("y"), 0.25)
    below = df.filter(F.col("y") <= fit.beta[0] + fit.beta[1] * F.col("a")).count()
    assert below / N == pytest.approx(0.25, abs=0.02)
    assert fit.n == N and fit.gap <= 1e-6 * fit.loss


@pytest.mark.parametrize("tau, seed", [(0.5, 1), (0.2, 2), (0.9, 3)])
def test_quantile_regression_equals_the_best_vertex(spark, tau, seed):
    """A best fit goes through as many rows as there are columns: try all pairs."""
    rng = np.random.default_rng(seed)
    x, y, w = rng.normal(50, 3, 25), rng.normal(0, 1, 25), rng.integers(0, 5, 25)
    y = y + 2 * x
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    odd = [(98, None, 1.0, 1.0), (99, 1.0, None, 1.0), (97, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "id long, a double, y double, mult double")

    def loss(b0, b1):
        r = y - b0 - b1 * x
        return (w * np.where(r >= 0, tau * r, (tau - 1) * r)).sum()

    best = np.inf
    for i in range(25):
        for j in range(i):
            slope = (y[i] - y[j]) / (x[i] - x[j])
            best = min(best, loss(y[i] - slope * x[i], slope))
    fit = quantile_regression(df, Design.of(df, ("a",)), F.col("y"), tau, F.col("mult"))
    assert fit.n == 25 and fit.loss == pytest.approx(loss(*fit.beta), rel=1e-9)
    assert best <= fit.loss * (1 + 1e-12) and fit.loss - fit.gap <= best * (1 + 1e-9)


def test_quantile_regression_fails_aloud(data):
    df, _ = data
    d = Design.of(df, ("a",))
    with pytest.raises(NotConverged):
        quantile_regression(df, d, F.col("y"), 0.25, most_passes=4)
    with pytest.raises(ValueError, match="no rows"):
        quantile_regression(df.filter("id < 0"), d, F.col("y"))


def test_pairwise_terms(data):
    df, _ = data
    d = Design.of(df, ("a", "b", "hhsize_fct"), pairwise=True)
    assert "a:bTRUE" in d.names and not any("[3,5):hhsize" in n for n in d.names)
    fit = wls(df, d, F.col("y"), F.col("mult"))
    assert score(df, fit, d).filter("log_yhat IS NULL").count() == 0


def test_lasso(data):
    df, d = data
    wide = lasso_design(d)
    grams = fold_grams(df, wide, F.col("y"), "id")
    rows = grams.collect()
    assert sum(r.n for r in rows) == N and len(rows) == 10
    folds = np.stack([unpack(r.gram, len(wide.names) + 1) for r in sorted(rows, key=lambda r: r.fold)])
    chosen = choose_penalty(folds)
    assert chosen["lambda_1se"] >= chosen["lambda_min"]
    fit = lasso_cv(grams, len(wide.names)).first()
    assert fit.beta == pytest.approx(chosen["beta"]) and fit.n == N
    # no penalty is least squares, the top of the path is zero everywhere
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(size=300)
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
    corr, target = x.T @ x / 300, x.T @ y / 300
    top = np.abs(target).max()
    path = list(lasso_path(corr[None], target[None], np.array([1.01 * top, 0.5 * top, 0.0]), 1e-18))
    assert not path[0].any() and path[1].any()
    assert path[2][0] == pytest.approx(np.linalg.solve(corr, target))
    # optimality: gradient is at most the penalty, and equal to it where active
    slope = target - corr @ path[1][0]
    active = path[1][0] != 0
    assert np.abs(slope).max() <= 0.5 * top + 1e-8
    assert np.abs(slope[active]) == pytest.approx(0.5 * top)


def test_lasso_replicates_share_a_scan(data):
    df, d = data
    wide = lasso_design(d)
    odd = F.when(F.col("id") % 2 == 0, 0).otherwise(1) + F.when(F.col("id") % 3 == 0, 0).otherwise(2)
    bits = df.withColumn("test", F.array(odd.cast("long")))
    fits = lasso_cv(
        fold_grams(bits, wide, F.col("y"), "id", bits="test", replicates=2), len(wide.names)
    ).collect()
    alone = lasso_cv(fold_grams(df.filter("id % 3 = 0"), wide, F.col("y"), "id"), len(wide.names))
    second = next(r for r in fits if r.replicate == 2)
    assert second.beta == pytest.approx(alone.first().beta) and second.n == N // 3


def test_replicates_beyond_task_memory_take_more_scans(data):
    df, _ = data
    bits = df.withColumn("bits", F.expr("array(shiftleft(1L, cast(id % 5 as int)))"))
    packed = packed_rows(bits, "id", F.col("y"), F.col("mult"), [F.lit(1.0), F.col("a")], "bits")
    whole = {r.replicate: r for r in replicate_grams(packed, 5, 2).collect()}
    parts = {r.replicate: r for r in replicate_grams(packed, 5, 2, cells=12).collect()}
    z = [F.lit(1.0), F.col("a"), F.col("y")]
    assert set(parts) == set(whole) == {1, 2, 3, 4, 5}
    for i in parts:
        plain = factor(df.filter(F.col("id") % 5 != i - 1), z, F.col("mult")).first()
        for got in (parts[i], whole[i]):
            assert unpack(got.gram, 3) == pytest.approx(square(plain, 3)) and got.n == plain.n


def test_forest_and_binary(data):
    df, d = data
    train, rows = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    runs = [
        forest(train, rows, d, F.col("y"), trees=10, depth=5, seed=3).select("id", "log_yhat")
        for _ in range(2)
    ]
    first, second = ({r.id: round(r.log_yhat, 6) for r in run.collect()} for run in runs)
    assert first == second and len(first) == N // 2
    scored = forest(train, rows, d, F.col("y"), trees=10, depth=5, seed=3)
    mse, var = scored.agg(F.avg(F.pow(F.col("y") - F.col("log_yhat"), 2)), F.var_pop("y")).first()
    assert mse < 0.7 * var
    poor = F.col("y") <= 0.8
    for kind in ("logit", "lasso", "forest"):
        p = binary_model(train, rows, d, poor, kind, weight="mult", trees=10, depth=5)
        hit = p.agg(F.avg(((F.col("p_poor") >= 0.5) == poor).cast("int"))).first()[0]
        assert hit > 0.75
    with pytest.raises(ValueError):
        binary_model(train, rows, d, poor, "probit")


def test_forest_reads_dealt_rows_that_are_held(data, monkeypatch):
    """The passes of a fit read label and vector, made once, in tasks of a set number of rows."""
    df, d = data
    seen = []

    def fit(model, rows, params=None):
        seen.append((rows.columns, rows.storageLevel.useMemory, rows.rdd.getNumPartitions()))
        return plain(model, rows, params)

    plain = learners.RandomForestRegressor.fit
    monkeypatch.setattr(learners.RandomForestRegressor, "fit", fit)
    monkeypatch.setattr(learners, "FOREST_ROWS", 7, raising=False)
    scored = forest(df.coalesce(1), df, d, F.col("y"), trees=5, depth=3)
    assert seen == [(["_label", "features"], True, -(-N // 7))]
    assert scored.columns == [*df.columns, "log_yhat"] and scored.count() == N


def test_absorbed_levels_equal_dummies(data):
    """One factor, and two that are crossed unevenly, against a dummy for every level."""
    df, _ = data
    df = df.withColumn("town", (F.col("id") * 7919 % 83).cast("string")).withColumn(
        "week", F.when(F.col("id") % 11 > 0, F.floor(F.pow(F.col("id") % 97, 0.7)))
    )
    d = Design.of(df, ("a", "b"), intercept=False)
    rows = df.select("a", F.col("b").cast("int"), "y", "mult", "town", "week").toPandas()
    for factors in (["town"], ["town", "week"]):
        fit = wls_absorbed(df, d, F.col("y"), F.col("mult"), factors).first()
        x = [rows[["a", "b"]].to_numpy(float)]
        for f in factors:
            x.append((rows[f].fillna("none").to_numpy()[:, None] == rows[f].fillna("none").unique()[None]) * 1.0)
        root = np.sqrt(rows["mult"].to_numpy())
        expected = np.linalg.lstsq(np.column_stack(x) * root[:, None], rows["y"] * root, rcond=None)[0][:2]
        assert fit.n == N and fit.beta == pytest.approx(expected, rel=1e-7)
    with pytest.raises(ValueError, match="intercept"):
        wls_absorbed(df, Design.of(df, ("a",)), F.col("y"), F.col("mult"), ["town"])


def test_tiles_make_the_whole_matrix(data):
    df, _ = data
    d = Design.of(df, ("a", "b", "region"), pairwise=True)
    x, y, w = matrices(df, d)
    z = np.column_stack([x, y])
    expected = (z * w[:, None]).T @ z
    for tile, cells in ((4, 1 << 23), (5, 30)):
        got = np.zeros_like(expected)
        for r in tiled_gram(df, d, F.col("y"), F.col("mult"), tile, cells, chunk=50).collect():
            i, j = r.left * tile, r.right * tile
            block = np.array(r.part).reshape(min(tile, len(got) - i), -1)
            got[i : i + len(block), j : j + block.shape[1]] = block
            got[j : j + block.shape[1], i : i + len(block)] = block.T
            assert r.n == N
        assert got == pytest.approx(expected)
