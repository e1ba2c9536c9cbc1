"""JSON sources: decision cohorts and consent text catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import strings
from vigilframe.operators.cases import with_defaults
from vigilframe.operators.deviation import tier_of, weight_of

# ``expected`` and ``note`` exist in the files and are deliberately not part of the schema.
PERSON = """pid STRING, unit_id STRING,
 consent STRUCT<scope: ARRAY<STRING>, welfare_contact: BOOLEAN, status: STRING>,
 unit STRUCT<unit_id: STRING, cohort_size: INT, cohort_deviating_fraction: MAP<STRING, DOUBLE>,
   sanctioned_leave_domains: ARRAY<STRING>, training_domains: ARRAY<STRING>,
   seasonal_domains: ARRAY<STRING>, welfare_capacity_available: BOOLEAN>,
 deviations ARRAY<STRUCT<domain: STRING, z_self: DOUBLE, z_unit: DOUBLE, direction: STRING,
   windows_breached: BIGINT, daily_breach: MAP<STRING, DOUBLE>, missing_fraction: DOUBLE>>,
 active_interventions ARRAY<STRING>, suppressed_drivers ARRAY<STRING>,
 acute_items ARRAY<STRING>, clinician_concern BOOLEAN"""


def _struct(ddl: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).simpleString()


def cohort_schema() -> str:
    return (f"cohort STRING, description STRING, as_of DATE, personnel ARRAY<{_struct(PERSON)}>")


def cohorts(spark: SparkSession, path: str) -> DataFrame:
    """One row per person of every cohort document under ``path`` (a glob is fine)."""
    files = spark.read.schema(cohort_schema()).option("multiLine", True).json(path)
    return files.select("cohort", "as_of", F.inline("personnel"))


def cohort_names(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"cohort_(.+)\.json$", 1)
    files = spark.read.schema("cohort STRING").option("multiLine", True).json(path)
    return files.select(name.alias("cohort")).distinct().orderBy("cohort")


def cohort_cases(people: DataFrame, cfg: Config) -> DataFrame:
    """Cohort rows in the case shape.  Tier and weight come from config, never from the file."""
    def context(d: Column) -> Column:
        unit = F.col("unit")
        breaches = [F.try_element_at(d["daily_breach"], F.lit(str(days))).alias(f"breach_{i}")
                    for i, days in enumerate(cfg.persistence_windows)]

        def listed(name: str) -> Column:
            return F.coalesce(F.array_contains(unit[name], d["domain"]), F.lit(False))

        return F.struct(
            d["domain"].alias("domain"), d["z_self"].alias("z_self"), d["z_unit"].alias("z_unit"),
            d["direction"].alias("direction"), d["windows_breached"].alias("windows_breached"),
            tier_of(d["domain"], cfg).alias("tier"), weight_of(d["domain"], cfg).alias("weight"),
            *breaches, F.coalesce(d["missing_fraction"], F.lit(0.0)).alias("missing"),
            F.coalesce(F.try_element_at(unit["cohort_deviating_fraction"], d["domain"]),
                       F.lit(0.0)).alias("unit_fraction"),
            listed("sanctioned_leave_domains").alias("planned_leave"),
            listed("training_domains").alias("training"),
            listed("seasonal_domains").alias("seasonal"))

    cases = people.select(
        *[c for c in ("cohort", "as_of") if c in people.columns], "pid", "unit_id",
        F.col("consent.status").alias("status"), F.col("consent.scope").alias("scope"),
        F.col("consent.welfare_contact").alias("welfare_contact"),
        F.col("unit.cohort_size").alias("cohort_size"),
        F.col("unit.welfare_capacity_available").alias("capacity"),
        F.transform("deviations", context).alias("deviations"),
        F.coalesce("active_interventions", strings(())).alias("active_codes"),
        F.coalesce("suppressed_drivers", strings(())).alias("suppressed_drivers"),
        F.coalesce("acute_items", strings(())).alias("acute_items"), "clinician_concern")
    return with_defaults(cases)


# ------------------------------------------------------------------- text catalogue ---
META = ("locale", "name", "englishName", "direction", "textVersion", "reviewStatus", "reviewedBy",
        "reviewedOn")


def locales(spark: SparkSession, path: str) -> DataFrame:
    """One row per text catalogue: its metadata and a hash of everything but the metadata.

    A document is read whole as one value and hashed as parsed: key order and white space in the
    file do not change the hash, and a new reviewer name does not either.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.try_parse_json("value").alias("doc"))
    parts = parsed.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    meta = {name: F.try_variant_get("doc", f"$._meta.{name}", "string") for name in META}
    entry = F.struct("key", F.concat(F.lit('"'), "key", F.lit('":'), F.to_json("value")).alias("t"))
    # a catalogue has a few dozen top-level groups
    grouped = parts.select(*[c.alias(n) for n, c in meta.items()], "key", "value").groupBy(
        *META).agg(F.array_sort(F.collect_list(F.when(F.col("key") != "_meta", entry)))
                   .alias("entries"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: e["t"]), ","),
                    F.lit("}"))
    return grouped.select(
        "locale", "name", F.col("englishName").alias("english_name"), "direction",
        F.col("textVersion").alias("text_version"), F.col("reviewStatus").alias("review_status"),
        F.col("reviewedBy").alias("reviewed_by"), F.col("reviewedOn").alias("reviewed_on"),
        F.sha2(body, 256).alias("content_hash"))
