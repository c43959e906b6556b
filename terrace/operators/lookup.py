"""Lookup of names by a cascade of keys, and isolation of failures by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import fold


def lookup_cascade(wanted: DataFrame, label: str, teams: DataFrame, team: str, name: str, division: str) -> DataFrame:
    """Wanted rows with `found` and `by`: the team of the whole label, else of the bare name if just one team has it.

    A whole label is name and division in parentheses, folded; of equal ones the first team counts. A trailing parenthesis is
    dropped for the bare name. Each step is an equi-join on a key that one team has, so no row is doubled.
    """
    whole = F.concat(F.col(name), F.lit(" ("), F.col(division), F.lit(")"))
    by_label = teams.groupBy(fold(whole).alias("_label")).agg(F.min(team).alias("_first"))
    by_name = teams.groupBy(fold(F.col(name)).alias("_name")).agg(F.min(team).alias("_only"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    asked = wanted.withColumn("_label", fold(F.col(label)))
    asked = asked.withColumn("_name", F.regexp_replace("_label", r"\s*\([^)]*\)\s*$", ""))
    found = asked.join(by_label, "_label", "left").join(by_name, "_name", "left")
    return found.select(*wanted.columns, F.coalesce("_first", "_only").alias("found"), F.when(F.col("_first").isNotNull(), "label").when(F.col("_only").isNotNull(), "name").alias("by"))


def isolated(rows: DataFrame, checks: dict[str, Column], values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows with their values, and the quarantine: failed rows as they came, with `error`, the first check that failed.

    Values are computed with try_ functions, so no row stops the job: a value that cannot be had is a failed check of its own.
    """
    held = rows.withColumns({f"_{k}": v for k, v in values.items()})
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()], *[F.when(F.col(f"_{k}").isNull(), F.lit(f"no {k}")) for k in values])
    held = held.withColumn("error", failed)
    good = held.filter("error is null").select(*rows.columns, *[F.col(f"_{k}").alias(k) for k in values])
    return good, held.filter("error is not null").select(*rows.columns, "error")


def results_by_key(keys: DataFrame, key: str, results: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Every key once with its results, or without them; `failed` rows and the first `error` are beside, so no key vanishes."""
    bad = quarantine.groupBy(key).agg(F.count("*").alias("failed"), F.min("error").alias("error"))
    out = keys.select(key).distinct().join(results, key, "left").join(bad, key, "left")
    return out.withColumn("failed", F.coalesce("failed", F.lit(0)))
