"""Three-valued logic, bins and other column builders on micro-tables."""

from pyspark.sql import functions as F

from pmtspark.functions import (
    any3,
    bin_left,
    bin_right,
    collapse_levels,
    cross_levels,
    if_known,
    in_set,
    max_or_neg_inf,
    recode,
    safe_ratio,
    thousands,
    yes_no,
)
from pmtspark.operators.reshape import (
    pivot_any,
    pivot_composite,
    stack_frames,
    unpivot_measures,
)
from pmtspark.sources import (
    drop_range,
    literal_table,
    materialise,
    pick,
    read_table,
    strip_labels,
    write_table,
)


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_membership_of_missing_is_false(spark):
    df = spark.createDataFrame([(None,), (1,), (9,)], "x int").coalesce(1)
    assert values(df, in_set(F.col("x"), (1, 2))) == [False, True, False]


def test_any_keeps_unknown(spark):
    rows = [("a", False), ("a", None), ("b", True), ("b", None), ("c", False), ("c", False)]
    df = spark.createDataFrame(rows, "k string, v boolean")
    got = {r.k: r.v for r in df.groupBy("k").agg(any3(F.col("v")).alias("v")).collect()}
    assert got == {"a": None, "b": True, "c": False}


def test_max_of_nothing_known(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    top = df.agg(max_or_neg_inf(F.col("x")).alias("m"))
    assert top.first().m == float("-inf")
    assert top.select((F.col("m") >= 1).alias("b")).first().b is False


def test_bins(spark):
    ages = [0, 5, 6, 14, 15, 64, 65, 110, 111]
    df = spark.createDataFrame([(a,) for a in ages], "x int").coalesce(1)
    got = values(df, bin_right(F.col("x"), (0, 5, 14, 64, 110), ("5", "14", "64", "65")))
    assert got == ["5", "5", "14", "14", "64", "64", "65", "65", None]
    sizes = spark.createDataFrame([(a,) for a in [0, 1, 2, 3, 9, 40]], "x int").coalesce(1)
    got = values(sizes, bin_left(F.col("x"), (1, 3, 5, 7, 9, float("inf"))))
    assert got == [None, "[1,3)", "[1,3)", "[3,5)", "[9,Inf)", "[9,Inf)"]


def test_scalars(spark):
    df = spark.createDataFrame([("f", None, 1, 4, 0.0), ("m", "5", 2, 9, 2.0)],
                               "a string, b string, c int, d int, e double").coalesce(1)
    assert values(df, cross_levels(F.col("a"), F.col("b"))) == [None, "m_5"]
    assert values(df, yes_no(F.col("c"))) == [True, False]
    assert values(df, collapse_levels(F.col("d"), {"wood": (4, 5)})) == ["wood", "9"]
    assert values(df, safe_ratio(F.lit(1.0), F.col("e"))) == [None, 0.5]
    assert values(df, recode(F.col("a"), {"f": "female"})) == ["female", "m"]
    assert values(df, if_known(F.col("b") == "5", F.lit("y"), F.lit("n"))) == [None, "y"]
    assert values(df.limit(1), thousands(F.lit(14925.4))) == ["14,925"]


def test_pivot_fills_only_missing_combinations(spark):
    df = spark.createDataFrame(
        [("h1", "wood", 1), ("h2", "coal", None)], "h string, fuel string, used int"
    )
    names = {"wood": "wood", "coal": "coal"}
    got = pivot_any(df, ["h"], "fuel", F.col("used") == 1, names).orderBy("h").collect()
    assert [tuple(r) for r in got] == [("h1", True, False), ("h2", False, None)]


# The published comparison (six models, four measures).
PUBLISHED = {
    "Undercoverage (EER)": [0.40, 0.33, 0.40, 0.30, 0.35, 0.30],
    "Leakage (IER)": [0.24, 0.34, 0.24, 0.31, 0.36, 0.31],
    "Precision": [0.70, 0.64, 0.70, 0.68, 0.62, 0.68],
    "Accuracy": [0.68, 0.64, 0.70, 0.68, 0.62, 0.68],
}


def test_published_table_wide(spark):
    long = literal_table(
        spark,
        {
            "Value": [v for row in PUBLISHED.values() for v in row],
            "Model": ["OLS", "Random Forest", "LASSO", "Logit", "Random Forest", "LASSO"],
            "Measure": [m for m in PUBLISHED for _ in range(6)],
            "Outcome": ["Continuous"] * 3 + ["Binary"] * 3,
        },
        "Value double, Model string, Measure string, Outcome string",
    )
    names = ["Continuous_OLS", "Continuous_Random Forest", "Continuous_LASSO", "Binary_Logit",
             "Binary_Random Forest", "Binary_LASSO"]
    wide = pivot_composite(long, ["Measure"], ["Outcome", "Model"], "Value", names)
    assert wide.columns == ["Measure", *names]
    assert {r[0]: list(r[1:]) for r in wide.collect()} == PUBLISHED


def test_unpivot_and_stack(spark):
    df = spark.createDataFrame([(0.2, 0.1, 0.2, None, 0.4)], "z double, H double, IER double, EER double, TER double")
    long = unpivot_measures(df, ["z"])
    assert {(r.measure, r.value) for r in long.collect()} == {
        ("H", 0.1), ("IER", 0.2), ("EER", None), ("TER", 0.4)
    }
    assert stack_frames([df, df.drop("TER")]).filter("TER IS NULL").count() == 1


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "i int, s string, d double")
    write_table(df, str(tmp_path / "t"), partition_by=["s"])
    assert read_table(spark, str(tmp_path / "t"), ["i"]).columns == ["i"]
    assert materialise(df).schema == df.schema
    df.write.option("header", "true").csv(str(tmp_path / "c"))
    back = read_table(spark, str(tmp_path / "c"), ["d", "i"], df.schema, "csv")
    assert sorted(tuple(r) for r in back.collect()) == [(2.0, 1), (3.0, 2)]
    assert pick(df, "i", name="s").columns == ["i", "name"]
    assert drop_range(df, "s", "d").columns == ["i"]
    labelled = df.withColumn("i", F.col("i").alias("i", metadata={"label": "x"}))
    assert strip_labels(labelled).schema["i"].metadata == {}
