"""Survey modules derived from the test tables: order = household, line = member.

Codes are arithmetic on keys; answers are left out on purpose (NULL) so that the
three-valued rules matter. ``sql.py`` states the same tables for the checker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pmtspark.operators.households import finish, merge_households
from pmtspark.sources import write_scratch

ASSET_CODES = (1, 5, 6, 7, 7, 8, 10, 11, 12, 16, 17, 20)
FUEL_CODES = (1, 2, 3, 4, 5, 6, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unless(missing: Column, value: Column) -> Column:
    return F.when(~missing, value.cast("int"))


def modules(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    place = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    )
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    home = ok.alias("HHID")

    gsec1 = orders.join(place, "o_custkey").select(
        home,
        F.col("n_regionkey").cast("int").alias("region"),
        F.when(ok % 3 == 0, 1).otherwise(0).alias("urban"),
        F.month("o_orderdate").cast("int").alias("month"),
        (1 + ok % 7).cast("double").alias("mult"),
    )
    gsec2 = lines.select(
        F.col("l_orderkey").alias("HHID"),
        line.alias("PID"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("h2q3"),
        F.when(line == 1, 1).otherwise(2 + line % 4).cast("int").alias("h2q4"),
        unless(line == 7, F.col("l_quantity") * 2).alias("h2q8"),
        unless(part % 29 == 0, 1 + part % 5).alias("h2q10"),
    )
    persons = lines.groupBy(F.col("l_orderkey").alias("HHID"), line.alias("PID")).agg(
        F.min(part).alias("pk"), F.min(supp).alias("sk")
    )
    pk, sk = F.col("pk"), F.col("sk")
    gsec4 = persons.select(
        "HHID",
        "PID",
        unless(pk % 31 == 0, 1 + pk % 3).alias("h4q5"),
        F.when(pk % 7 == 0, 99).otherwise(10 * (1 + sk % 6) + pk % 7).cast("int").alias("h4q7"),
        (10 * (1 + pk % 6) + sk % 7 - 1).cast("int").alias("h4q9"),
    )
    gsec8 = persons.select(
        "HHID",
        "PID",
        *[unless((sk + j) % 41 == 0, 1 + (pk + j) % 3).alias(f"h8q{j}") for j in range(4, 16)],
    )
    gsec9a = orders.select(
        home,
        unless(ok % 89 == 0, ok % 6).alias("h9q3"),
        unless(ck % 17 == 0, 1 + ck % 9).alias("h9q4"),
        (1 + ck % 24).cast("int").alias("h9q5"),
        F.when(ck % 11 == 0, 96).otherwise(1 + ck % 7).cast("int").alias("h9q6"),
        (1 + ok % 8).cast("int").alias("h9q7"),
        unless(ok % 13 == 0, 1 + (ok + ck) % 9).alias("h9q22"),
    )
    gsec10a = orders.select(
        home,
        (1 + ck % 2).cast("int").alias("h10q1"),
        unless(ok % 53 == 0, 1 + ok % 2).alias("h10q12"),
    )
    code = F.col("code")
    gsec10b = (
        orders.select(home, ck.alias("ck"), F.explode(F.array(*map(F.lit, FUEL_CODES))).alias("code"))
        .filter((F.col("HHID") + code) % 5 != 0)
        .select(
            "HHID",
            code.alias("h10q8_1"),
            unless((F.col("ck") + code) % 37 == 0, 1 + (F.col("ck") * code) % 2).alias("h10q8_2"),
        )
    )
    gsec14 = orders.select(
        home, F.posexplode(F.array(*map(F.lit, ASSET_CODES))).alias("pos", "code")
    ).select(
        "HHID",
        code.alias("h14q2"),
        unless((F.col("HHID") + F.col("pos")) % 61 == 0, 1 + (F.col("HHID") + F.col("pos")) % 2).alias(
            "h14q3"
        ),
    )
    spend = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    consumption = (
        lines.groupBy(F.col("l_orderkey").alias("HHID"))
        .agg(spend.alias("cpexp30"))
        .select(
            "HHID",
            "cpexp30",
            (F.col("cpexp30") / 30).alias("welfare"),
            F.when(F.col("cpexp30") < 100000, 1).otherwise(0).alias("poor"),
        )
    )
    return {
        "gsec1": gsec1,
        "gsec2": gsec2,
        "gsec4": gsec4,
        "gsec8": gsec8,
        "gsec9a": gsec9a,
        "gsec10a": gsec10a,
        "gsec10b": gsec10b,
        "gsec14": gsec14,
        "consumption": consumption,
    }


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hhid"),
        line.alias("pid"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sex"),
        F.when(line != 7, (F.col("l_quantity") * 2).cast("int")).alias("age"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("spend"),
    )


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HH: one row per order with size, two shares, head, consumption and design."""
    people = members(spark, sf_dir)
    sex, age, head = F.col("sex"), F.col("age"), F.col("pid") == 1

    def share(cond: Column) -> Column:
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    per_home = people.groupBy("hhid").agg(
        F.count(F.lit(1)).cast("int").alias("hhsize"),
        F.sum("spend").cast("double").alias("cpexp30"),
        share((sex == 2) & (age >= 0) & (age <= 5)).alias("shares_f_5"),
        share((sex == 1) & (age > 14) & (age <= 64)).alias("shares_m_64"),
        F.min(F.when(head, age)).alias("head_age"),
        (F.min(F.when(head, sex)) == 2).alias("head_female"),
    )
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    place = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("region")
    )
    base = (
        table(spark, sf_dir, "orders")
        .join(place, "o_custkey")
        .select(
            F.col("o_orderkey").alias("hhid"),
            "region",
            F.month("o_orderdate").cast("int").alias("month"),
            (1 + F.col("o_orderkey") % 7).cast("double").alias("mult"),
            F.col("o_orderpriority").alias("roof"),
        )
    )
    return base.join(per_home, "hhid", "left").withColumn(
        "cpp", F.try_divide(F.col("cpexp30"), F.col("hhsize")) * 12
    )


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling rows: HH with members, label and the two regressors."""
    return (
        households(spark, sf_dir)
        .filter("hhsize IS NOT NULL")
        .select(
            "hhid", "region", "month", "mult", "hhsize", "shares_f_5", "shares_m_64", "head_age",
            "head_female", "cpexp30", "cpp", F.log("hhsize").alias("ln_size"),
            F.log("cpexp30").alias("ln_y"),
        )
    )


_written: dict[tuple, tuple] = {}


def written(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The analysis table, prepared once per application and scanned from then on.

    Models pass over it several times, and each consumer reads one prepared file.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        df = build(spark, sf_dir)
        _written[key] = (write_scratch(df, name), df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def hh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "sample", sample)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modules merged, before incomplete households are dropped."""
    return merge_households(modules(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The household analysis table of the module proxies.

    Its rows are few bytes, so files and splits by bytes would leave most of them to one task;
    they are dealt evenly as they are written.
    """
    tasks = spark.sparkContext.defaultParallelism

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = finish(merged(spark, sf_dir))
        return df.repartition(tasks, *df.columns)

    return written(spark, sf_dir, "households", build)
