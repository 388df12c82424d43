"""Contracts on tables: required fields, types, sizes, completeness, and quality reports with a status per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FAMILIES = {"int": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double", "tinyint", "smallint", "int", "bigint")}


def missing_fields(record: Column, required: tuple[str, ...]) -> Column:
    """The required keys that a JSON object, as text, lacks; all of them if the text is no object."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, required)), keys)


def record_faults(df: DataFrame, record: str, key: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing, message) of the records that lack a field. Empty lines are no records."""
    out = df.where(F.btrim(F.col(record)) != "").select(key, missing_fields(F.col(record), required).alias("missing"))
    message = F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(": missing fields "), F.array_join("missing", ", "))
    return out.where(F.size("missing") > 0).withColumn("message", message)


def record_check(df: DataFrame, record: str, required: tuple[str, ...], least: int | None = None) -> DataFrame:
    """One row: rows, faulty ones, whether there are enough, and whether all is well."""
    rows = df.where(F.btrim(F.col(record)) != "")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.size(missing_fields(F.col(record), required)) > 0).alias("faulty"))
    enough = F.lit(True) if least is None else F.col("n") >= least
    return out.withColumn("enough", enough).withColumn("passed", (F.col("faulty") == 0) & F.col("enough"))


def schema_faults(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What a table's schema lacks of columns and loose types (int; float, which takes integers too; others are not looked at)."""
    kinds = dict(df.dtypes)
    gone = [f"missing column {c}" for c in sorted(expected) if c not in kinds]
    wrong = [f"{c}: expected {t}, got {kinds[c]}" for c, t in expected.items() if c in kinds and t in _FAMILIES and kinds[c] not in _FAMILIES[t]]
    return gone + wrong


def strict_schema_faults(actual: StructType, expected: StructType) -> list[str]:
    """The first fault of each expected field: it is not there, or differs in type or in whether it may be null. More fields do no harm."""
    have, out = {f.name: f for f in actual}, []
    for f in expected:
        if f.name not in have:
            out.append(f"{f.name}: missing")
        elif have[f.name].dataType != f.dataType:
            out.append(f"{f.name}: expected {f.dataType.simpleString()}, got {have[f.name].dataType.simpleString()}")
        elif have[f.name].nullable != f.nullable:
            out.append(f"{f.name}: expected nullable {f.nullable}, got {have[f.name].nullable}")
    return out


def readiness(df: DataFrame, required: tuple[str, ...], least: int, filled: tuple[str, ...] = ()) -> DataFrame:
    """(check, ok): required columns, the least number of rows, and columns that have a value in every row. One pass."""
    missing = [c for c in required if c not in df.columns]
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"_{c}") for c in filled])
    checks = [("required_columns", F.lit(not missing)), ("minimum_rows", F.col("n") >= least), *((f"filled_{c}", F.col(f"_{c}") == F.col("n")) for c in filled)]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks])))


def completeness_status(report: DataFrame, warn: float = 0.90, good: float = 0.95) -> DataFrame:
    """completeness()'s rows with a status: ok from good on, warn from warn on, else fail."""
    c = F.col("completeness")
    return report.withColumn("status", F.when(c >= good, "ok").when(c >= warn, "warn").otherwise("fail"))


def attrition(df: DataFrame, reason: str, integrity: tuple[str, ...]) -> DataFrame:
    """One row: total, errors of integrity and their rate, other rejects and their rate. reason: null or `ok` for what is kept."""
    lost = F.col(reason).isNotNull() & (F.col(reason) != "ok")
    broken = lost & F.col(reason).isin(*integrity)
    n = F.count("*")

    def rate(hit: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(hit), n), F.lit(0.0))

    return df.agg(n.alias("total"), F.count_if(broken).alias("integrity_errors"), rate(broken).alias("integrity_error_rate"), F.count_if(lost & ~broken).alias("attrition"), rate(lost & ~broken).alias("attrition_rate"))


def quality_report(counts: DataFrame, duplicates: Column, checksum_failures: Column, unready: Column, warn: float = 0.0001, fail: float = 0.001) -> DataFrame:
    """attrition()'s row with a status for canonicalisation, shards and readiness, the overall one (PASS or WARN), and recommendations."""
    rate = F.col("integrity_error_rate")
    out = counts.withColumns(
        {
            "canonicalization": F.when(rate > fail, "FAIL").when(rate > warn, "WARN").otherwise("PASS"),
            "shard_construction": F.when((duplicates > 0) | (checksum_failures > 0), "FAIL").otherwise("PASS"),
            "training_readiness": F.when(unready > 0, "FAIL").otherwise("PASS"),
        }
    )
    stages = F.array("canonicalization", "shard_construction", "training_readiness")
    advice = F.array_compact(F.array(F.when(rate > fail, "integrity errors above the limit"), F.when(duplicates > 0, "repeated sample ids")))
    return out.withColumn("overall", F.when(F.forall(stages, lambda s: s == "PASS"), "PASS").otherwise("WARN")).withColumn("recommendations", advice)


def quarantined(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `fault`, the first rule (a condition that a good row meets) that a row fails; null for good rows. A rule that is null fails."""
    fault = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        fault = F.when(bad, name) if fault is None else fault.when(bad, name)
    return df.withColumn("fault", fault)


def shard_faults(df: DataFrame, shard: str, rules: dict[str, Column]) -> DataFrame:
    """Per shard: rows, and how many fail each rule first."""
    out = quarantined(df, rules).groupBy(shard)
    return out.agg(F.count("*").alias("n"), *[F.count_if(F.col("fault") == r).alias(r) for r in rules])
