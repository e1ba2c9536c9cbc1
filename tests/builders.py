"""Small hand-made case rows."""

from pyspark.sql import functions as F

from vigilframe.config import DOMAINS, Config
from vigilframe.operators.cases import with_defaults

CFG = Config()
BREACH = (1.0, 1.0, 0.9)

CASE_SCHEMA = """pid STRING, unit_id STRING, status STRING, scope ARRAY<STRING>,
 welfare_contact BOOLEAN, cohort_size INT, capacity BOOLEAN,
 deviations ARRAY<STRUCT<domain: STRING, z_self: DOUBLE, z_unit: DOUBLE, direction: STRING,
   windows_breached: BIGINT, tier: STRING, weight: DOUBLE, breach_0: DOUBLE, breach_1: DOUBLE,
   breach_2: DOUBLE, missing: DOUBLE, unit_fraction: DOUBLE, planned_leave: BOOLEAN,
   training: BOOLEAN, seasonal: BOOLEAN>>,
 active_codes ARRAY<STRING>, suppressed_drivers ARRAY<STRING>, acute_items ARRAY<STRING>,
 clinician_concern BOOLEAN"""


def deviation(domain, direction="elevated", breach=BREACH, missing=0.0, fraction=0.0,
              leave=False, training=False, seasonal=False, z_self=2.6):
    tier = CFG.domain_tier[domain]
    return (domain, z_self, 2.1, direction, 3, tier, CFG.tier_weight[tier], *breach, missing,
            fraction, leave, training, seasonal)


def case(pid, *devs, scope=DOMAINS, status="ACTIVE", contact=True, capacity=True, active=(),
         suppressed=(), acute=(), clinician=False):
    return (pid, "unit-A", status, list(scope), contact, 120, capacity, list(devs), list(active),
            list(suppressed), list(acute), clinician)


def frame(spark, *rows):
    return with_defaults(spark.createDataFrame(list(rows), CASE_SCHEMA)).withColumn(
        "risk_status", F.lit("unavailable"))
