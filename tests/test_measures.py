"""Targeting measures, splits, densities and experiments."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pmtspark.operators import measures as M
from pmtspark.operators import replicates as replicates_
from pmtspark.operators import resample as R
from pmtspark.operators.density import below_line, mass_below, weighted_density
from pmtspark.operators.quantile import weighted_quantile
from pmtspark.operators.hashing import block_hashes
from pmtspark.operators.replicates import (
    drawn,
    linear_values,
    packed_rows,
    replicate_bits,
    replicate_quantiles,
    replicate_targeting,
    replicate_totals,
    with_replicates,
)
from pmtspark.plans import experiment as X
from pmtspark.plans.report import error_report, headcount_report, line_label


def lines(df, z, zhat):
    return df.withColumn("z", F.array(F.lit(z))).withColumn("zhat", F.array(F.lit(zhat)))


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1.0, 2.0, 0.25), (2.0, 1.0, 0.25), (3.0, 4.0, 0.25), (4.0, 2.0, 0.25)]
    return spark.createDataFrame(rows, "y double, yhat double, w double")


def test_targeting_micro(small):
    row = M.targeting_measures(lines(small, 2.0, 1.0), [0.5]).first()
    assert (row.H, row.IER, row.EER, row.TER) == pytest.approx((0.75, 1 / 3, 0.0, 0.5))
    none = M.targeting_measures(lines(small, 0.5, 1.0), [0.5]).first()
    assert none.H == 0 and none.IER is None and none.EER is None


def test_confusion(small):
    matrix = M.confusion(small, F.col("y") <= 2, F.col("yhat") <= 2, F.col("w"))
    row = M.confusion_chi2(M.confusion_measures(matrix)).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (0.25, 0.25, 0.0, 0.5)
    assert row.tn + row.fp + row.fn + row.tp == 1
    assert (row.precision, row.accuracy, row.coverage) == pytest.approx((2 / 3, 0.75, 1.0))
    assert row.one_minus_leakage == pytest.approx(row.precision)
    assert row.f2 == pytest.approx(5 * 0.5 / (5 * 0.5 + 0.25))
    seen = np.array([[1, 1], [0, 2]])
    expected = np.outer(seen.sum(1), seen.sum(0)) / 4
    assert row.chi2 == pytest.approx(((seen - expected) ** 2 / expected).sum())
    lr = sum(2 * o * np.log(o / e) for o, e in zip(seen.ravel(), expected.ravel()) if o)
    assert row.lr_chi2 == pytest.approx(lr)
    assert M.mean_squared_error(small, "y", "yhat").first().mse == pytest.approx(7 / 4)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(800):
        size, share = int(rng.integers(1, 9)), float(rng.random())
        y = float(np.exp(8 + 0.6 * np.log(size) + 0.3 * share + 0.4 * rng.normal()))
        rows.append((i, str(i % 4), float(np.log(size)), share, y, float(1 + i % 3)))
    return spark.createDataFrame(
        rows, "HHID int, region string, ln_size double, share double, cpp double, mult double"
    ).cache()


SETS = {"Basic": ("ln_size", "share"), "Extended": ("ln_size", "share", "region")}
SETUP = X.Setup(forest={"trees": 5, "depth": 4})


def test_headcount_at_own_line(sample):
    z = weighted_quantile(sample, "cpp", "mult", [0.2], "HHID").select(F.array("value").alias("z"))
    rows = M.attach_lines(sample, z)
    share = rows.agg(M.headcount(rows, "cpp", "mult", F.get("z", F.lit(0)))).first()[0]
    total = sample.agg(F.sum("mult")).first()[0]
    assert abs(share - 0.2) <= 3 / total


def test_curves_and_dominance(sample):
    df = sample.withColumn("y", F.col("cpp")).withColumn("exact", F.col("cpp"))
    df = df.withColumn("flat", F.lit(1e9))
    grid = (0.1, 0.3, 0.5)
    z = M.line_array(weighted_quantile(df, "cpp", "mult", grid, "HHID"), grid, "z")
    curve = M.coverage_curve(M.attach_lines(df, z), grid, yhats=("exact", "flat"), w="mult")
    rows = {(r.predictor, r.q): r for r in curve.collect()}
    assert rows["exact", 0.1].coverage == 1 and rows["exact", 0.1].leakage == pytest.approx(0)
    assert rows["flat", 0.5].coverage == 0 and rows["flat", 0.5].leakage is None
    row = M.dominance(curve, "exact", "flat").first()
    assert row.first_dominates and not row.second_dominates


def test_dominance_at_every_line(spark):
    """Two predictors that agree on a grid of lines, and differ between its lines."""
    rng = np.random.default_rng(12)
    y, a, b = (np.round(rng.lognormal(0, 1, 400), 1) for _ in range(3))
    w = rng.integers(0, 4, 400).astype(float)
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(y, a, b, w)] + [(None, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0)],
        "y double, a double, b double, w double",
    )
    jumps = np.unique(np.concatenate([y, np.maximum(y, a), np.maximum(y, b)]))

    def coverage(p, z):
        return w[np.maximum(y, p) <= z].sum() / w[y <= z].sum()

    lines = [z for z in jumps if w[y <= z].sum() > 0]
    diff = np.array([coverage(a, z) - coverage(b, z) for z in lines])
    row = M.dominance_everywhere(df.repartition(4), "y", "a", "b", "w").first()
    assert row.lines == len(lines)
    assert (row.min_diff, row.max_diff) == pytest.approx((diff.min(), diff.max()))
    assert row.first_dominates == bool(diff.min() >= 0) and not row.second_dominates
    steps = {r.line: r for r in M.coverage_steps(df, "y", ["a", "b"], "w").collect()}
    assert steps[lines[5]].coverage_a == pytest.approx(coverage(a, lines[5]))
    same = M.dominance_everywhere(df.withColumn("b", F.col("y")), "y", "b", "a", "w").first()
    assert same.first_dominates
    assert M.dominance_everywhere(df.limit(0), "y", "a", "b", "w").first().lines == 0


def order_of(ids, seed, replicate=None):
    def key(i):
        if replicate is None:
            return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()
        block, at = divmod(replicate - 1, 4)
        return hashlib.md5(f"{i}:{seed}:{block}".encode()).hexdigest()[8 * at : 8 * at + 8]

    return sorted(ids, key=lambda i: (key(i), i))


@pytest.mark.parametrize("n", [1, 5, 7, 300])
def test_half_is_exact_and_portable(spark, n):
    df = spark.range(n)
    flagged = R.split_half(df, "id", 1896)
    want = round(n * 0.5)  # half to even
    got = {r.id for r in flagged.filter("test").collect()}
    assert got == set(order_of(range(n), 1896)[:want])
    rest = R.complement(df, flagged.filter("test"), "id")
    assert {r.id for r in rest.collect()} == set(range(n)) - got
    assert R.train_part(flagged).count() + R.test_part(flagged).count() == n


def test_replicates(spark):
    df = spark.range(101)
    long = with_replicates(replicate_bits(df, "id", 6, 9), 6)
    for rep in range(1, 7):
        got = {r.id for r in long.filter((F.col("replicate") == rep) & F.col("test")).collect()}
        assert got == set(order_of(range(101), 9, rep)[:50])
    assert long.count() == 606
    totals = replicate_totals(replicate_bits(df.withColumn("x", F.col("id")), "id", 6, 9), 6, ["x"])
    for r in totals.collect():
        drawn = order_of(range(101), 9, r.replicate)
        ids = drawn[:50] if r.test else drawn[50:]
        assert (r.n, r.x) == (len(ids), sum(ids))


@pytest.mark.parametrize("replicates", [1, 64, 65])
def test_halves_by_several_digits(spark, monkeypatch, replicates):
    """Selection goes on digit by digit until few rows are left, and ties go by id."""
    monkeypatch.setattr(replicates_, "PICK_ROWS", 1)
    monkeypatch.setattr(replicates_, "DIGIT_BITS", 4)
    df = spark.range(700).withColumn("name", F.concat(F.lit("h"), F.col("id")))
    flagged = replicate_bits(df, "name", replicates, 3, share=0.3)
    long = with_replicates(flagged, replicates)
    for rep in {1, replicates}:
        got = {r.name for r in long.filter((F.col("replicate") == rep) & F.col("test")).collect()}
        assert got == set(order_of([f"h{i}" for i in range(700)], 3, rep)[:210])


def test_half_edge_by_several_digits(spark):
    df = spark.range(20_000)
    for rows in (1, 4096):
        h, i = R.half_edge(df, "id", 5, 0.5, rows)
        assert i == order_of(range(20_000), 5)[9_999]


def test_replicate_quantiles_equal_the_plain_ones(spark, monkeypatch):
    """Ties, zero and missing weights, several levels of bounds, on both sides of the splits."""
    rng = np.random.default_rng(4)
    n, reps, qs = 1_500, 5, (0.0, 0.05, 0.5, 0.9, 1.0)
    y = np.round(np.exp(rng.normal(0, 3, n)) - 2, 1)  # negative values and ties too
    w = rng.integers(0, 4, n).astype(float)
    rows = [(i, float(a), float(b) if i % 50 else None) for i, (a, b) in enumerate(zip(y, w))]
    df = spark.createDataFrame(rows, "id long, y double, w double").repartition(3)
    flagged = replicate_bits(df, "id", reps, 8).cache()
    packed = packed_rows(flagged, "id", F.col("y"), F.col("w"), [F.col("y")])
    long = with_replicates(flagged, reps)
    for pick, bits in ((4096, 9), (3, 2)):
        monkeypatch.setattr(replicates_, "PICK_ROWS", pick)
        monkeypatch.setattr(replicates_, "VALUE_BITS", bits)
        for test in (True, False):
            got = replicate_quantiles(packed, reps, lambda c: c.y, test, qs)
            part = long.filter(F.col("test") == test)
            for r in weighted_quantile(part, "y", "w", qs, "id", by=["replicate"]).collect():
                assert got[r.replicate - 1, qs.index(r.q)] == pytest.approx(r.value)


def test_hashes_of_many_texts(spark):
    """Short, long and non-ASCII texts, against Spark's MD5 of a text at a time."""
    texts = ["", "7", "12", "ü", "x" * 41, "x" * 48, "x" * 49, "x" * 200, "12345678901"]
    got = block_hashes(pa.array(texts), 1896, 125)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(124))).alias("b")
    for r in rows.select("i", "t", blocks).withColumn("h", R.hash_key("t", 1896, F.col("b"))).collect():
        want = [int(r.h[8 * k : 8 * k + 8], 16) for k in range(4)]
        assert got[r.i, 4 * r.b : 4 * r.b + 4].tolist() == want


def test_splits_do_not_depend_on_the_window(spark, monkeypatch):
    """A window that misses the boundary is widened until it holds it."""
    df = spark.range(3_000)
    want = {r.id: r.test_bits for r in replicate_bits(df, "id", 70, 9).collect()}
    monkeypatch.setattr(replicates_, "WINDOW", 0.2)
    assert {r.id: r.test_bits for r in replicate_bits(df, "id", 70, 9).collect()} == want


@pytest.mark.parametrize("window", [8.0, 0.05])
def test_replicate_quantiles_by_a_pilot(spark, monkeypatch, window):
    """Few values with very many rows, a pilot smaller than the table, and bounds that miss."""
    monkeypatch.setattr(replicates_, "PILOT_ROWS", 400)
    monkeypatch.setattr(replicates_, "PICK_ROWS", 50)
    reps, qs = 4, (0.0, 0.2, 0.4, 1.0)
    df = spark.range(20_000).repartition(4).withColumn("w", (1 + F.col("id") % 7).cast("double"))
    flagged = replicate_bits(df, "id", reps, 8).cache()
    long = with_replicates(flagged, reps)
    monkeypatch.setattr(replicates_, "WINDOW", window)
    for y in ((F.col("id") % 5).cast("double"), F.sin("id"), F.lit(3.0)):
        packed = packed_rows(flagged, "id", y, F.col("w"), [y])
        got = replicate_quantiles(packed, reps, lambda c: c.y, True, qs)
        part = long.filter("test").withColumn("y", y)
        for r in weighted_quantile(part, "y", "w", qs, "id", by=["replicate"]).collect():
            assert got[r.replicate - 1, qs.index(r.q)] == pytest.approx(r.value)


def test_rows_far_from_all_lines_are_not_looked_at_by_cell(spark):
    """Searches and measures ask for the values of few rows; the rest count alike in all replicates."""
    reps, n, qs = 8, 40_000, (0.2, 0.4)
    df = spark.range(n).select(
        "id", (1 + F.col("id") % 7).cast("double").alias("w"),
        (F.lit(2.0) + F.hash("id") / 2**32).alias("x"),
        F.exp(F.lit(2.0) + F.xxhash64("id") / F.lit(2.0**64)).alias("y"),
    )
    flagged = replicate_bits(df, "id", reps, 8).cache()
    packed = packed_rows(flagged, "id", F.col("y"), F.col("w"), [F.col("x")])
    linear = linear_values(1 + np.arange(reps)[:, None] / 1e4)
    asked = spark.sparkContext.accumulator(0)

    class Counted:
        by_row = True

        def __call__(self, c):
            asked.add(len(c.y))
            return linear(c)

        def bounds(self, c):
            return linear.bounds(c)

    z = replicate_quantiles(packed, reps, lambda c: c.y, False, qs)
    zhat = replicate_quantiles(packed, reps, Counted(), True, qs)
    got = replicate_targeting(packed, reps, Counted(), z, zhat, qs).collect()
    assert asked.value < n  # of at least three passes over the rows
    rows = flagged.toPandas()
    test = np.array([[w[0] >> r & 1 for r in range(reps)] for w in rows.test_bits], bool)
    for r in got:
        own = rows[test[:, r.replicate - 1]]
        i, j = r.replicate - 1, qs.index(r.z)
        yhat = np.exp(own.x * linear.beta[i, 0])
        poor, chosen = own.y <= z[i, j], yhat <= z[i, j]
        want = [own.w[c].sum() / own.w[of].sum() for c, of in (
            (chosen, own.w > 0), (chosen & ~poor, chosen), (poor & ~chosen, poor),
            (poor & (yhat > zhat[i, j]), poor))]
        assert [r.H, r.IER, r.EER, r.TER] == pytest.approx(want)
        assert own.w[yhat <= zhat[i, j]].sum() / own.w.sum() == pytest.approx(r.z, abs=1e-3)


def test_values_of_which_nothing_is_known(spark):
    """Values without bounds, some unknown, infinite or of a replicate without a fit."""
    reps, qs = 3, (0.3,)
    df = spark.range(3_000).withColumn("w", (F.col("id") % 3).cast("double"))
    flagged = replicate_bits(df, "id", reps, 8).cache()
    x = F.when(F.col("id") % 10 == 0, F.lit(float("inf"))).when(F.col("id") % 10 != 1, F.sin("id"))
    packed = packed_rows(flagged, "id", F.col("id"), F.col("w"), [x])
    beta = np.array([[1.0], [np.nan], [-2.0]])
    got = replicate_quantiles(packed, reps, linear_values(beta), True, qs)
    long = with_replicates(flagged.withColumn("x", x), reps).filter("test")
    v = F.exp(F.col("x") * F.get(F.array(F.lit(1.0), F.lit(None), F.lit(-2.0)), F.col("replicate") - 1))
    known = weighted_quantile(long.withColumn("v", v), "v", "w", qs, "id", by=["replicate"])
    assert {r.replicate: got[r.replicate - 1, 0] for r in known.collect()} == pytest.approx(
        {r.replicate: r.value for r in known.collect()}
    )
    assert np.isnan(got[1, 0])
    plain = replicate_quantiles(packed, reps, lambda c: np.exp(c.x @ beta.T), True, qs)
    assert plain == pytest.approx(got, nan_ok=True)


def test_bootstrap_rows_are_dealt_by_their_number(spark):
    """One small file is split over all cores, and 125 hashes a row are taken once, not in the plan."""
    flagged = replicate_bits(spark.range(5_000).coalesce(1), "id", 500, 9)
    assert "md5" not in flagged._jdf.queryExecution().toString()
    assert flagged.rdd.getNumPartitions() > 1


def test_replicates_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, y double, w double")
    flagged = replicate_bits(df, "id", 3, 8)
    packed = packed_rows(flagged, "id", F.col("y"), F.col("w"), [F.col("y")])
    lines = replicate_quantiles(packed, 3, lambda c: c.y, True, (0.2,))
    assert flagged.count() == 0 and np.isnan(lines).all()
    out = replicate_targeting(packed, 3, lambda c: c.y, lines, lines, (0.2,)).collect()
    assert all(r.H is None and r.line is None for r in out)


def test_density(spark, sample):
    df = sample.select("HHID", F.log("cpp").alias("x"), "mult")
    total = df.agg(F.sum("mult")).first()[0]
    df = df.withColumn("w", F.col("mult") / total)
    curve = weighted_density(df, "x", "w")
    rows = curve.orderBy("grid_x").collect()
    data = df.select("x", "w").toPandas()
    x, w = data["x"].to_numpy(), data["w"].to_numpy()
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 512)
    u = (grid[:, None] - x[None]) / bw
    exact = (w * np.exp(-0.5 * u * u)).sum(1) / (bw * np.sqrt(2 * np.pi))
    assert [r.grid_x for r in rows] == pytest.approx(grid)
    for fineness, got in ((256, rows), (8, weighted_density(df, "x", "w", fineness=8).orderBy("grid_x").collect())):
        error = np.abs(np.array([r.density for r in got]) - exact).max()
        assert error < 0.05 / (bw * fineness**2)  # the stated bound
    line = weighted_quantile(df, "x", "w", [0.5], "HHID").select(F.col("value").alias("line"))
    assert below_line(curve, line).count() < 512
    assert mass_below(curve, line).first().mass == pytest.approx(0.5, abs=0.05)
    whole = line.select((F.col("line") + 1e6).alias("line"))
    assert mass_below(curve, whole).first().mass == pytest.approx(1, abs=1e-3)


def test_all_models_give_48_rows(sample):
    df = X.holdout_flag(sample, SETUP)
    out = X.collect_results(df, covariates=SETS, setup=SETUP, test="test")
    rows = out.collect()
    assert len(rows) == 48
    keys = {(r.z, r.covariates, r.model, r.measure) for r in rows}
    assert len(keys) == 48
    # at equal predicted and true headcounts the two errors agree, which TER sets out to do
    assert all(0 <= r.value <= 1 for r in rows if r.value is not None)
    insample = X.collect_results(sample, covariates=SETS, models=("OLS",), setup=SETUP)
    joined = X.compare_results(out, insample)
    assert joined.count() == 16 and "value_insample" in joined.columns
    with pytest.raises(ValueError):
        X.estimate(sample, SETS["Basic"], model="Boosting", setup=SETUP)


def test_equal_headcounts_equal_errors(spark):
    rng = np.random.default_rng(5)
    y, yhat = rng.permutation(100), rng.permutation(100)
    df = spark.createDataFrame(
        [(float(a), float(b), 1.0) for a, b in zip(y, yhat)], "y double, yhat double, w double"
    )
    row = M.targeting_measures(lines(df, 30.0, 30.0), [0.3]).first()
    assert row.IER == pytest.approx(row.EER) == pytest.approx(row.TER)


def test_grid_order(spark):
    rows = X.experiment_grid(spark, (0.2, 0.4), ("Basic", "Extended")).collect()
    assert [tuple(r) for r in rows] == [(0.2, "Basic"), (0.4, "Basic"), (0.2, "Extended"), (0.4, "Extended")]


def test_bootstrap_matches_single_splits(sample):
    """Each replicate of the one-scan bootstrap equals an ordinary holdout run."""
    reps = 2
    design = {n: X.Design.of(sample, t) for n, t in SETS.items()}["Extended"]
    boot = X.ols_replicates(sample, design, SETUP, reps)
    flagged = replicate_bits(sample, "HHID", reps, SETUP.seed)
    for rep in range(1, reps + 1):
        df = flagged.withColumn("test", drawn("test_bits", F.lit(rep - 1))).drop("test_bits")
        alone = X.estimate(df, SETS["Extended"], setup=SETUP, test="test", design=design)
        got = {r.z: r for r in boot.filter(F.col("replicate") == rep).collect()}
        for r in alone.collect():
            for m in ("H", "IER", "EER", "TER", "line", "rate_line"):
                assert got[r.z][m] == pytest.approx(r[m])


def test_bootstrap_of_all_models_and_report(sample):
    boot = X.bootstrap_results(sample, 2, covariates={"Basic": SETS["Basic"]}, setup=SETUP)
    rows = boot.collect()
    assert len(rows) == 2 * 3 * 2 * 4
    ci = X.bootstrap_ci(boot)
    row = ci.filter("measure = 'H' AND model = 'OLS' AND z = 0.2").first()
    both = [r.value for r in rows if (r.measure, r.model, r.z) == ("H", "OLS", 0.2)]
    assert row.mean == pytest.approx(np.mean(both))
    assert row.ci_low == pytest.approx(np.quantile(both, 0.05))
    errors = error_report(ci, 0.2)
    assert {r.measure for r in errors.collect()} == {
        "Exclusion Error Rate", "Inclusion Error Rate", "Targeting Error Rate"
    }
    heads = headcount_report(ci).collect()
    assert len(heads) == 6 and all((r.flag == "red") == (r.gap < 0) for r in heads)
    label = ci.sparkSession.createDataFrame([(14925.2,)], "z double").select(line_label("z", 0.2))
    assert label.first()[0] == "F(14,925) = 0.2"


def test_oob_uses_the_full_fit(sample):
    design = X.Design.of(sample, SETS["Basic"])
    rows = X.oob_replicates(sample, design, SETUP, 3).collect()
    assert len(rows) == 6
    assert len({r.line for r in rows if r.z == 0.2}) == 1
    assert len({r.rate_line for r in rows if r.z == 0.2}) == 3


def test_bootstrap_searches_the_outcome_lines_once(sample, monkeypatch):
    """Models and covariate sets share the lines of the outcome, which depend on the rows alone."""
    searched = []

    def counted(packed, replicates, values, test, qs):
        searched.append(test)
        return np.tile(np.array(qs, float), (replicates, 1))

    monkeypatch.setattr(X, "replicate_quantiles", counted)
    X.bootstrap_results(sample, 2, covariates=SETS, models=("OLS", "LASSO"), setup=SETUP)
    assert searched.count(False) == 1
    assert searched.count(True) == 2 * len(SETS)


def test_forest_bootstrap_scores_test_halves_only(sample, monkeypatch):
    """Every replicate's test rows have a prediction, its training rows their outcome alone."""
    kept, plain = [], X.replicate_measures

    def measured(scored, *args):
        kept.append({(r.replicate, r.HHID): (r.test, r._yhat) for r in scored.collect()})
        return plain(scored, *args)

    monkeypatch.setattr(X, "replicate_measures", measured)
    X.bootstrap_results(sample, 2, covariates=SETS, models=("Random Forest",), setup=SETUP).collect()
    ids = [r.HHID for r in sample.select("HHID").collect()]
    halves = {
        (r.replicate, r.HHID): r.test
        for r in with_replicates(replicate_bits(sample.select("HHID"), "HHID", 2, SETUP.seed), 2).collect()
    }
    assert len(kept) == len(SETS) and len(halves) == 2 * len(ids)
    for rows in kept:
        assert {k: test for k, (test, _) in rows.items()} == halves
        assert all((yhat is not None and yhat > 0) == test for test, yhat in rows.values())


def test_split_rows_are_written_once(sample):
    """Passes over a split's rows do not hash their ids again."""
    designs = {n: X.Design.of(sample, t) for n, t in SETS.items()}
    split = X.holdout_flag(sample, SETUP)
    rows = X.model_rows(split, designs, SETUP, "test")
    assert rows.inputFiles() != sample.inputFiles() and "test" in rows.columns
    assert "md5" in split._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.select("HHID", "test").collect())) == sorted(
        map(tuple, X.complete_for(split, designs).select("HHID", "test").collect())
    )
