"""Survey modules to household table, on hand-made modules."""

import math
from functools import reduce

import pytest
from pyspark.sql import functions as F

from pmtspark.operators import households as H
from pmtspark.plans.survey import prepare_households
from pmtspark.sources import MODULES
from proxy import frames


def make(spark, module, rows):
    names = MODULES[module].names
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], MODULES[module]
    )


@pytest.fixture(scope="module")
def modules(spark):
    homes = ["h1", "h2", "h3", "205300170503"]
    assets = [1, 5, 6, 7, 8, 10, 11, 12, 16, 17]
    work = {f"h8q{i}": 2 for i in range(4, 16)}
    person = [("h1", "p1", 1), ("h1", "p2", 2), ("h2", "p1", 1), ("h3", "p1", 1),
              ("205300170503", "p1", 1)]
    data = {
        "gsec1": [dict(HHID=h, region=i, urban=i % 2, month=3, mult=10.0) for i, h in enumerate(homes)],
        "gsec2": [
            dict(HHID=h, PID=p, h2q3=2 if p == "p2" else 1, h2q4=r, h2q8=40 if r == 1 else None, h2q10=1)
            for h, p, r in person
        ],
        "gsec4": [
            dict(HHID="h1", PID="p1", h4q5=2, h4q7=17), dict(HHID="h1", PID="p2", h4q5=3, h4q9=33),
            dict(HHID="h2", PID="p1", h4q5=1), dict(HHID="h3", PID="p1", h4q5=2, h4q7=99),
            dict(HHID="205300170503", PID="p1", h4q5=1),
        ],
        "gsec8": [dict(HHID=h, PID=p, **{**work, "h8q5": 1, "h8q15": None}) for h, p, _ in person],
        "gsec9a": [dict(HHID=h, h9q3=i, h9q4=5, h9q5=24, h9q6=96, h9q7=1, h9q22=None)
                   for i, h in enumerate(homes)],
        "gsec10a": [dict(HHID=h, h10q1=1, h10q12=2) for h in homes],
        "gsec10b": [dict(HHID=h, h10q8_1=4, h10q8_2=1) for h in homes],
        "gsec14": [dict(HHID=h, h14q2=a, h14q3=1 + a % 2) for h in homes for a in assets],
        "consumption": [dict(HHID=h, cpexp30=100.0, welfare=1.0, poor=0) for h in homes],
    }
    return {m: make(spark, m, rows) for m, rows in data.items()}


def test_full_build(spark, modules):
    df = H.build_households(modules)
    rows = {r.HHID: r for r in df.collect()}
    # the excluded id is gone; h3's head has an education code but no level for members
    assert set(rows) == {"h1", "h2", "h3"}
    h1 = rows["h1"]
    assert (h1.hhsize, h1.shares_m_64, h1.shares_f_64) == (2, 0.5, 0.0)
    assert (h1.head_educ_primary, h1.head_educ_secondary) == (True, False)
    assert (h1.hh_educ_primary, h1.hh_educ_secondary) == (True, True)
    assert h1.rooms == 2.0 and rows["h2"].rooms == 1.0  # zero rooms gives the size
    assert h1.cpp == 600.0 and rows["h2"].cpp == 1200.0
    assert (h1.head_work_salary, h1.head_work_farm, h1.head_work_daily) == (True, False, False)
    assert (h1.fuel_wood, h1.fuel_coal, h1.stove_any) == (True, False, True)
    assert (h1.own_house, h1.television) == (False, True)
    assert (h1.toilet_flush, h1.wall_finished, h1.floor_finished) == (False, True, True)
    assert (h1.hhsize_fct, h1.head_age_fct) == ("[1,3)", "[39,44)")
    assert (rows["h3"].hh_educ_primary, rows["h3"].head_educ_primary) == (False, False)


def test_unknown_education_survives(spark):
    df = make(spark, "gsec4", [dict(HHID="a", PID="1"), dict(HHID="b", PID="115300270402"),
                               dict(HHID="c", PID="1", h4q9=15)])
    got = {r.HHID: (r.hh_educ_primary, r.hh_educ_secondary) for r in H.education(df).collect()}
    assert got == {"a": (False, False), "b": (True, True), "c": (False, False)}


def test_share_denominator_counts_unknown_age(spark):
    df = make(spark, "gsec2", [dict(HHID="a", PID="1", h2q3=2, h2q8=3),
                               dict(HHID="a", PID="2", h2q3=2)])
    row = H.composition(df).first()
    assert (row.hhsize, row.shares_f_5) == (2, 0.5)


def test_fuel_and_stove_agree_with_separate_forms(spark):
    rows = [dict(HHID=f"h{i % 5}", h10q8_1=1 + (i * 7) % 8, h10q8_2=[1, 2, None][i % 3])
            for i in range(14)]
    df = make(spark, "gsec10b", rows)
    apart = H.fuel_use(df).join(H.stove_any(df), "HHID")
    both = H.fuel_and_stove(df)
    assert sorted(apart.collect()) == sorted(both.select(apart.columns).collect())


def test_merge_equals_chain_of_full_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "HHID int, a string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "HHID int, b double")
    c = spark.createDataFrame([(4, True)], "HHID int, c boolean")
    heads = spark.createDataFrame([(1, 30), (1, 40), (5, 50)], "HHID int, age int")
    chain = reduce(lambda l, r: l.join(r, ["HHID"], "full"), [a, b, c, heads])
    merged = H.merge_blocks([a, b, c, heads])
    order = F.col("HHID"), F.col("age")
    assert merged.columns == chain.columns
    assert merged.orderBy(*order).collect() == chain.orderBy(*order).collect()
    assert [r.HHID for r in H.repeated_keys(heads, ["HHID"]).collect()] == [1]


def test_merge_keeps_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, None)], "HHID int, a string")
    b = spark.createDataFrame([(1, 5.0), (1, 6.0), (3, 7.0), (3, 8.0)], "HHID int, b double")
    c = spark.createDataFrame([(1, True), (4, False)], "HHID int, c boolean")
    heads = spark.createDataFrame([(1, 30), (1, 40), (3, 50), (5, 50)], "HHID int, age int")
    frames = [a, b, c, heads]
    chain = reduce(lambda l, r: l.join(r, ["HHID"], "full"), frames)
    for piece in (1, 2, 8192):
        merged = H.merge_blocks(frames, piece=piece)
        assert merged.columns == chain.columns
        assert sorted(map(str, merged.collect())) == sorted(map(str, chain.collect()))


def test_merge_takes_a_null_key_as_a_household(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y"), (1, "z")], "HHID int, a string")
    b = spark.createDataFrame([(None, 5.0), (None, 6.0), (2, 7.0)], "HHID int, b double")
    for piece in (1, 8192):
        got = H.merge_blocks([a, b], piece=piece).collect()
        assert sorted(map(tuple, got), key=str) == sorted(
            [(None, "x", 5.0), (None, "x", 6.0), (1, "y", None), (1, "z", None), (2, None, 7.0)],
            key=str,
        )


def test_merge_of_empty_blocks(spark):
    a = spark.createDataFrame([], "HHID int, a string")
    b = spark.createDataFrame([(1, 2), (1, 3)], "HHID int, b int")
    assert H.merge_blocks([a, a.withColumnRenamed("a", "c")]).count() == 0
    assert sorted(r.b for r in H.merge_blocks([a, b]).collect()) == [2, 3]


def test_merge_of_a_hot_household(spark):
    """A household with very many rows in two blocks is spread over pieces of a few rows."""
    n, piece = 3_000, 500
    a = spark.range(n).select(F.lit(7).alias("HHID"), F.col("id").alias("a"))
    b = spark.range(n).select(F.lit(7).alias("HHID"), F.col("id").alias("b"))
    c = spark.range(20).select(F.col("id").cast("int").alias("HHID"), F.lit(1).alias("c"))
    merged = H.merge_blocks([a, b, c], piece=piece).withColumn("task", F.spark_partition_id())
    row = merged.groupBy("HHID").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"),
        F.countDistinct("task").alias("tasks"),
    ).filter("HHID = 7").first()
    each = n * (n - 1) // 2 * n
    assert (row.n, row.a, row.b, row.c) == (n * n, each, each, n * n)
    assert row.tasks > 4


def test_merge_shuffles_unique_blocks_once(spark):
    frames = [spark.range(10).select(F.col("id").alias("HHID"), F.lit(i).alias(f"c{i}")) for i in range(5)]
    merged = H.merge_blocks(frames)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_prepare_from_files(spark, modules, tmp_path, fmt):
    for name, df in modules.items():
        writer = df.write.option("header", "true") if fmt == "csv" else df.write
        getattr(writer, fmt)(str(tmp_path / f"{name}.{fmt}"))
    out = prepare_households(spark, str(tmp_path), str(tmp_path / "households"), fmt)
    expected = H.build_households(modules)
    assert out.columns == expected.columns
    assert out.orderBy("HHID").collect() == expected.orderBy("HHID").collect()


def test_merge_takes_one_slot_a_column(spark):
    """Few enough slots for generated code with all published columns; values of every kind are kept."""
    a = spark.range(3).select(F.col("id").alias("HHID"), F.lit("x").alias("t"), F.lit(float("nan")).alias("d"))
    b = spark.range(2, 4).select(
        F.col("id").alias("HHID"), F.lit(False).alias("f"), F.create_map(F.lit("k"), F.col("id")).alias("m")
    )
    merged = H.merge_blocks([a, b])
    got = {r.HHID: r for r in merged.collect()}
    assert set(got) == {0, 1, 2, 3} and got[2].t == "x" and math.isnan(got[2].d)
    assert got[2].f is False and got[2].m == {"k": 2} and got[0].m is None and got[3].d is None
    assert "first(_b0" not in merged._jdf.queryExecution().toString()


def test_merge_deals_narrow_rows_by_key(spark):
    """A block is one slot of the grouping, which does not combine rows before they are dealt."""
    names = [f"c{i}" for i in range(20)]
    a = spark.range(6).select(F.col("id").alias("HHID"), *[F.col("id").alias(c) for c in names])
    b = spark.range(3, 9).select(F.col("id").alias("HHID"), F.lit(None).cast("string").alias("t"))
    bare = spark.range(8, 12).select(F.col("id").alias("HHID"))
    merged = H.merge_blocks([a, b, bare])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "max(" not in plan
    assert plan.index("REPARTITION_BY_COL") > plan.rindex("Aggregate(")
    got = {r.HHID: r for r in merged.collect()}
    assert set(got) == set(range(12))
    assert all(got[k][c] == (k if k < 6 else None) for k in got for c in names)


def test_prepared_rows_stand_evenly_in_files(spark):
    sizes = [
        r["count"]
        for r in frames.prepared(spark, "/root/testdata/sf0.01").groupBy(F.input_file_name()).count().collect()
    ]
    assert len(sizes) == spark.sparkContext.defaultParallelism
    assert max(sizes) < 1.2 * sum(sizes) / len(sizes)
