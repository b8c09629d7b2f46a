"""Content classification and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.functions.text import UNICODE, file_name, matches, stem
from folio.session import spread

TYPES = list(P.PATTERNS)


def labels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.LABELS, "title string, content_type array<string>")


def fence_count(text: Column, compat: bool = True) -> Column:
    """Fenced blocks that hold code. ``compat`` looks from the ninth character of a block on, as the classifier's scores were set with."""
    token = UNICODE + (r"(?s:^.{8}.*?)" if compat else "") + f"(?:{P.FENCE_TOKEN})"
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(UNICODE + P.FENCE), F.lit(1)), lambda b: b.rlike(token)))


def with_densities(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns d_TYPE: pattern matches per 1,000 characters, 0 for an empty text. One compiled projection.

    A pattern is only counted where letters occur without which it can't match; a pattern of several types is counted once.
    """
    k = F.length(text) / 1000
    distinct = {p: guards for t in TYPES for p, guards in zip(P.PATTERNS[t], P.GUARDS[t], strict=True)}
    names = {p: f"_n{i}" for i, p in enumerate(distinct)}
    odd = F.col("_odd")

    def count(p, guards):
        possible = odd
        for g in guards:
            possible = possible | F.col("_low").contains(g)
        return F.when(possible, matches(F.col(text), p)).otherwise(F.lit(0))

    spare = spread(df).withColumns({"_low": F.lower(text), "_odd": F.col(text).rlike(P.CASE_FOLDS)})
    counted = spare.withColumns({names[p]: count(p, g) for p, g in distinct.items()})
    density = lambda t: F.when(F.length(text) > 0, sum((F.col(names[p]) for p in P.PATTERNS[t]), F.lit(0)) / k).otherwise(F.lit(0.0))
    return counted.withColumns({f"d_{t}": density(t) for t in TYPES}).drop("_low", "_odd", *names.values())


def with_fences(df: DataFrame, text: str = "text", compat: bool = True) -> DataFrame:
    """Column ``fences``; in a projection of its own, as it doesn't compile."""
    return df.withColumn("fences", fence_count(F.col(text), compat))


def labels_of(threshold: float = P.LABEL_DENSITY) -> Column:
    """The sorted label set from the densities and fences."""
    found = [F.when((F.col(f"d_{t}") >= threshold) | ((F.col("fences") >= 1) if t == "software" else F.lit(False)), F.lit(t)) for t in TYPES]
    some = F.array_sort(F.array_compact(F.array(*found)))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("foundation")))


def classify_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``content_type``: the labels whose density reaches the threshold, ``software`` for fenced code, else ``foundation``."""
    out = with_fences(with_densities(df, text), text).withColumn("content_type", labels_of())
    return out.drop("fences", *(f"d_{t}" for t in TYPES))


def classify_two_tier(df: DataFrame, text: str = "text", path: str = "source_path") -> DataFrame:
    """As ``classify_chunks``, but a title of the label table takes its hand-made labels; ``tier`` says which applied."""
    own = classify_chunks(df.withColumn("_title", stem(F.col(path))), text)
    table = labels_table(df.sparkSession).withColumnRenamed("content_type", "_labels").withColumnRenamed("title", "_title")
    out = own.join(F.broadcast(table), "_title", "left")
    out = out.withColumn("tier", F.when(F.col("_labels").isNotNull(), 1).otherwise(2))
    return out.withColumn("content_type", F.coalesce("_labels", "content_type")).drop("_labels", "_title")


def is_curated(path: Column) -> Column:
    return stem(path).isin([t for t, _ in P.LABELS])


def route(df: DataFrame, text: str = "text", path: str = "source_path") -> DataFrame:
    """Adds ``route``: software before math before selfhelp, by hand labels, chunk labels and the document's densities."""
    table = labels_table(df.sparkSession).select(F.col("title").alias("_title"), F.col("content_type").alias("_hand"))
    scored = with_fences(with_densities(df.withColumn("_title", stem(F.col(path))), text), text)
    scored = scored.join(F.broadcast(table), "_title", "left").withColumn("_labels", F.coalesce("_hand", labels_of()))
    has = lambda *names: F.arrays_overlap("_labels", F.array(*map(F.lit, names)))
    code = has("software", "python") | (F.col("fences") >= P.FENCES) | (F.col("d_software") >= P.CODE_DENSITY)
    maths = has("math", "discrete_math") | (F.col("d_math") >= P.MATH_DENSITY)
    out = scored.withColumn("route", F.when(code, "software").when(maths, "math").otherwise("selfhelp"))
    return out.drop("_title", "_hand", "_labels", "fences", *(f"d_{t}" for t in TYPES))


def path_type(path: Column) -> Column:
    """The first rule whose keyword stands in a part of the path, part by part; else selfhelp."""
    of_part = lambda part: F.coalesce(*(F.when(part.contains(k), F.lit(v)) for k, v in P.PATH_RULES))
    found = F.array_compact(F.transform(F.split(F.lower(path), r"[/\\]"), of_part))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("selfhelp"))


def suffix_kind(path: Column) -> Column:
    """Which extractor a file name asks for: pdf, epub or none."""
    name = F.lower(file_name(path))
    return F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".epub"), "epub").otherwise("none")
