"""Sampling and summary statistics of extraction runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """About ``n`` rows: of each stratum its share of n, rounded half to even and one at least, in hashed order; then cut to n in hashed order."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    total = df.agg(F.count("*").alias("_all"))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size")).crossJoin(F.broadcast(total))  # one row
    take = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.col("_all")).cast("int"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in strata]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    rows = df.withColumn("_o", order).alias("x").join(F.broadcast(sizes.withColumn("_take", take)).alias("y"), cond).select("x.*", "_take")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key))).filter(F.col("_n") <= F.col("_take"))
    return ranked.orderBy("_o", key).limit(n).drop("_o", "_n", "_take")


def rounded(x: Column) -> Column:
    """A number of at least 1e-6 or 0, not negative, to two places; the binary number itself is compared with the middle between two, and a true middle goes to the even one.

    Its mantissa is a whole number of 53 bits, so the comparison is one of whole numbers.
    """
    low = F.floor(x.cast("decimal(38, 12)") * 100).cast("long")
    power = F.lit(52) - F.floor(F.log2(F.greatest(x, F.lit(1e-6)))).cast("int")
    power = F.least(power, F.lit(62))
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), power)
    exact = (x * scale).cast("long").cast("decimal(20, 0)") * F.lit(1000).cast("decimal(5, 0)")
    middle = (low * 10 + 5).cast("decimal(17, 0)") * scale.cast("decimal(20, 0)")
    return (low + F.when(exact > middle, 1).when((exact == middle) & (low % 2 == 1), 1).otherwise(0)) / 100


def ranks(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) -> (group, value, upto, n): each value with the rank of its last row and the group's rows.

    Counts of whole units are added up first and then the values inside a unit, so no task holds all values of a group.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c")).withColumn("_unit", F.floor(value))
    before = Window.partitionBy(group).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(group)
    units = counted.groupBy(group, "_unit").agg(F.sum("_c").alias("_u"))
    units = units.select(group, "_unit", F.coalesce(F.sum("_u").over(before), F.lit(0)).alias("_before"), F.sum("_u").over(every).alias("n"))
    inside = Window.partitionBy(group, "_unit").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.join(units, [group, "_unit"]).select(group, value, (F.col("_before") + F.sum("_c").over(inside)).alias("upto"), "n")


def at_ranks(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, p90): the 90th percentile is the value at rank floor(0.9 n), one at least."""
    r = ranks(values, group, value)
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    n = F.col("n")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return r.groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"), at(F.greatest(F.floor(n * 9 / 10), F.lit(1))).alias("p90"))


def condition_summary(calls: DataFrame) -> DataFrame:
    """(condition, seconds, gen_tokens, entities, relations, ok) -> counts and times per condition; one without a successful call says so in ``note``."""
    good = calls.filter("ok")
    base = calls.groupBy("condition").agg(
        F.count(F.when(F.col("ok"), F.col("seconds"))).alias("n"),
        F.sum((~F.col("ok")).cast("int")).alias("failures"),
        rounded(F.avg(F.when(F.col("ok"), F.col("seconds")))).alias("mean_s"),
        rounded(F.min(F.when(F.col("ok"), F.col("seconds")))).alias("min_s"),
        rounded(F.max(F.when(F.col("ok"), F.col("seconds")))).alias("max_s"),
    )
    # the fields as rows, so that all are ranked in one pass over the calls
    fields = {"gen_tokens": "median_tokens", "entities": "median_entities", "relations": "median_relations"}
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in ("seconds", *fields)))).alias("x")
    ranked = at_ranks(good.select("condition", each).select(F.struct("condition", "x.field").alias("of"), "x.value"), "of", "value")
    of = lambda f, c: F.max(F.when(F.col("of.field") == f, F.col(c)))
    found = ranked.groupBy(F.col("of.condition").alias("condition")).agg(of("seconds", "median").alias("_median"), of("seconds", "p90").alias("_p90"), *(of(f, "median").cast("int").alias(name) for f, name in fields.items()))
    out = base.join(found, "condition", "left")
    medians = [F.when(F.col("n") > 0, F.coalesce(name, F.lit(0))).alias(name) for name in fields.values()]
    out = out.select(*base.columns, rounded(F.col("_median")).alias("median_s"), rounded(F.col("_p90")).alias("p90_s"), *medians)
    return out.withColumn("note", F.when(F.col("n") == 0, "no successful calls"))


def condition_deltas(summary: DataFrame, open_: str, schema: str, glean: str) -> DataFrame:
    m = lambda c: F.max(F.when(F.col("condition") == c, F.col("median_s")))
    return summary.agg(((1 - m(schema) / m(open_)) * 100).alias("schema_saving_pct"), ((m(glean) / m(open_) - 1) * 100).alias("glean_cost_pct"))


def extrapolate(summary: DataFrame, condition: str, concurrency: int = 1) -> DataFrame:
    """Serial time for 80,000, 300,000 and 1,000,000 chunks from a condition's median."""
    from folio.functions.text import human_time

    sizes = F.explode(F.array(*(F.lit(n) for n in (80_000, 300_000, 1_000_000)))).alias("chunks")
    out = summary.filter(F.col("condition") == condition).select("median_s", sizes)
    seconds = F.col("chunks") * F.col("median_s") / concurrency
    return out.select("chunks", seconds.alias("seconds"), human_time(seconds).alias("duration"))
