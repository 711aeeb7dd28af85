"""Persisted offline evaluation reports with provenance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
PROVENANCE = ("run_id", "ranker_model_version", "retrieval_model_version", "data_source", "dataset_fingerprint")
_SCHEMA = "schema_version int, generated_at string, " + ", ".join(f"{c} string" for c in PROVENANCE) + \
    ", recency_half_life_days double, top_n int, split string, cases bigint, metric string, k bigint, value double"
_CHECKED = ("ranker_model_version", "retrieval_model_version", "run_id", "dataset_fingerprint")
_SPLITS = ("val", "test")


class ReportError(Exception):
    pass


class ReportMissing(ReportError):
    pass


class ReportMalformed(ReportError):
    pass


class ReportMismatch(ReportError):
    pass


def build(metrics: DataFrame, provenance: dict[str, str], top_n: int, half_life_days: float | None, generated_at: str) -> DataFrame:
    """`metrics`: split, cases, metric, k, value."""
    missing = [c for c in PROVENANCE if c not in provenance]
    if missing:
        raise ValueError(f"provenance lacks {missing}")
    fixed = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"), *[F.lit(provenance[c]).alias(c) for c in PROVENANCE],
             F.lit(half_life_days).cast("double").alias("recency_half_life_days"), F.lit(top_n).alias("top_n")]
    return metrics.select(*fixed, "split", "cases", "metric", "k", "value")


def save(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads and checks a report; never returns a partial one."""
    try:
        report = spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(path).persist()
    except AnalysisException as e:
        raise ReportMissing(f"no offline report at {path}") from e
    try:
        required = [c for c in report.columns if c != "recency_half_life_days"]
        seen = report.agg(F.count(F.lit(1)).alias("n"), F.collect_set("schema_version").alias("versions"), F.collect_set("split").alias("splits"),
                          *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required]).first()
    except Exception as e:
        raise ReportMalformed(f"offline report at {path} cannot be read: {e}") from e
    if seen["n"] == 0 or seen["versions"] != [SCHEMA_VERSION]:
        raise ReportMalformed(f"offline report at {path} has schema versions {seen['versions']}, expected {SCHEMA_VERSION}")
    holes = [c for c in required if seen[f"null_{c}"]]
    if holes or not set(_SPLITS) <= set(seen["splits"]):
        raise ReportMalformed(f"offline report at {path} is incomplete: missing fields {holes}, splits {sorted(seen['splits'])}")
    return report


def mismatches(report: DataFrame, loaded: dict[str, str]) -> DataFrame:
    """One row per identity field in which the report differs from what is loaded (empty counts as different)."""
    checks = [F.when(~F.coalesce((F.col(c) == F.lit(loaded.get(c))) & (F.lit(loaded.get(c)) != ""), F.lit(False)),
                     F.struct(F.lit(c).alias("field"), F.col(c).alias("report"), F.lit(loaded.get(c)).cast("string").alias("loaded"))) for c in _CHECKED]
    return report.select(F.explode(F.array_compact(F.array(*checks))).alias("m")).select("m.*").distinct()


def validate(report: DataFrame, loaded: dict[str, str]) -> None:
    bad = [f"{m.field}: report={m.report!r} loaded={m.loaded!r}" for m in mismatches(report, loaded).orderBy("field").collect()]  # at most one row per field
    if bad:
        raise ReportMismatch("report does not describe the loaded model and data: " + "; ".join(bad))
