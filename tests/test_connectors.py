"""Connectors: folders before the period are not opened, late rows are read, refused rows are kept."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from vigilframe.sources import connectors
from vigilframe.sources import tables as T

CFG, AS_OF = T.EVENTS_CONFIG, date(2024, 1, 30)
ROWS = [("1", "U1", "2024-01-02", "5", None, "2024-01-02"),   # before the period
        ("2", "U1", "2024-01-20", "50", None, "2024-01-20"),
        ("3", "U1", "2024-01-21", "7", "2024-01-21 10:00:00", "2024-01-29"),  # eight days late
        ("4", "U1", "2024-01-20", "much", None, "2024-01-20"),
        ("", "U1", "2024-01-22", "1", None, "2024-01-22"),
        ("5", "U1", "2023-12-01", "1", None, "2024-01-25")]  # loaded in the period, dated before it


def extract(spark, path, domain="leave", **more):
    rows = spark.createDataFrame(ROWS, "service_no STRING, unit STRING, date STRING, value STRING, "
                                       "timestamp STRING, loaded STRING").withColumn("loaded", F.to_date("loaded"))
    out = connectors.DelimitedFolder(domain, str(path), **more)
    connectors.write_extract(rows, out)
    return out


def test_period_reaches_the_folders(spark, tmp_path):
    source = extract(spark, tmp_path / "leave", delimiter=";", columns={"service_no": "id", "value": "days lost"})
    rows = source(spark, date(2024, 1, 15))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(loaded" in plan and "2024-01-15" in plan
    assert {r.service_no for r in rows.collect()} == {"2", "3", "4", None, "5"}
    assert rows.columns == [*connectors.CANONICAL, "domain"]


def test_pull_splits_good_and_refused(spark, tmp_path):
    registry = connectors.Registry(extract(spark, tmp_path / "leave"))
    registry.register("workload", connectors.DelimitedFolder("workload", str(tmp_path / "absent")), 2.0)
    registry.register("training", lambda spark, first: spark.createDataFrame(  # any reader may serve a domain
        [("9", "U2", "2024-01-30", "200", None, "training")], ", ".join(f"{c} STRING" for c in (
            *connectors.CANONICAL, "domain"))))
    path = str(tmp_path / "quarantine")
    for _ in range(2):  # a repeated run replaces its quarantine
        got = connectors.pull(spark, registry, CFG, AS_OF, 16, 1, quarantine=path)
    assert {(r.service_number, r.domain, r.value) for r in got.signals.collect()} == {
        ("2", "leave", 0.5), ("3", "leave", 0.07), ("9", "training", 1.0)}
    kept = spark.read.parquet(path)
    assert {(r.service_no, r.value, r.reject_reason) for r in kept.collect()} == {
        ("4", "much", "bad_number"), ("", "1", "blank_id")} and kept.count() == 2
    status = {r.domain: (r.status, r.rows, r.rejected, r.out_of_window, r.expected_rows) for r in got.status.collect()}
    assert status == {"leave": ("partial", 2, 2, 1, 16), "workload": ("unavailable", 0, 0, 0, 32),
                      "training": ("ok", 1, 0, 0, 16)}


def test_what_a_registry_refuses(spark, tmp_path):
    registry = connectors.Registry(extract(spark, tmp_path / "leave"))
    with pytest.raises(ValueError):
        registry.register("voice", registry.readers["leave"])
    with pytest.raises(ValueError):
        registry.register("leave", registry.readers["leave"])
    with pytest.raises(ValueError):
        connectors.pull(spark, connectors.Registry(), CFG, AS_OF, 16, 1)
    wrong = connectors.DelimitedFolder("leave", str(tmp_path / "leave"), columns={"value": "nowhere"})
    with pytest.raises(ValueError):
        wrong(spark, AS_OF)
