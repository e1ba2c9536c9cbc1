"""Extracts, catalogues, exports, pseudonyms and sealing."""

import hashlib
import hmac
import json
from datetime import date

from conftest import SMALL
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.operators import protect
from vigilframe.operators.consent import consent_locales
from vigilframe.plans.screening import profile_of
from vigilframe.sources import delimited, documents, sinks
from vigilframe.sources import tables as T

CFG = Config()
AS_OF = date(2026, 9, 5)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_extract(spark, tmp_path):
    work = write(tmp_path / "work.csv", "﻿id;unit;date;value\n"
                 "A1;U1;2026-09-01;14.5\nA2;U1;2026-09-02;22.0\n A3 ;U1;2026-09-03; 8.0 \n"
                 "A4;U2;2026-09-03;-3.0\nA5;U2;2026-09-03;not-a-number\n;U2;2026-09-03;4\n"
                 "A6;U2;2026-09-03;nan\nA7;U2;1999-01-01;4\nA8;U2;2026-13-40;4\n")
    leave = write(tmp_path / "leave.csv", "service_no,unit,date,value,timestamp\n"
                  "A1,U1,2026-09-01,15,2026-09-02T10:00:00\nA2,U1,2026-09-01,3,garbled\n")
    sources = [
        delimited.Extract("workload", work, ";", {"service_no": "id"}),
        delimited.Extract("leave", leave),
        delimited.Extract("training", str(tmp_path / "absent.csv"))]
    rows, status = delimited.pull(spark, sources, CFG, AS_OF, 30, roster_size=1)
    got = {(r.service_number, r.domain): (r.observed_at.isoformat(), r.value)
           for r in rows.collect()}
    assert got[("A2", "workload")][1] == 1.0  # clamped
    assert got[("A3", "workload")] == ("2026-09-03T00:00:00", 0.4)
    assert got[("A1", "leave")] == ("2026-09-02T10:00:00", 0.5)
    assert got[("A2", "leave")][0] == "2026-09-01T00:00:00"
    assert len(got) == 5
    by = {r.domain: r for r in status.collect()}
    assert (by["workload"].status, by["workload"].rejected, by["workload"].out_of_window) == (
        "partial", 5, 1)
    assert by["leave"].status == "ok" and round(by["leave"].missing_fraction, 4) == 0.9333
    assert by["training"].status == "unavailable" and by["training"].missing_fraction == 1.0


def test_voice_is_not_a_records_source(spark):
    import pytest

    with pytest.raises(ValueError):
        delimited.pull(spark, [delimited.Extract("voice", "x")], CFG, AS_OF, 30, 1)
    with pytest.raises(ValueError):
        CFG.but(domain_scale={"leave": 0.0}).scale_of("leave")


def test_pseudonym_is_an_hmac_and_rotates(spark):
    rows = spark.createDataFrame([("A1",), ("ß-9",)], "service_number STRING")
    for on, label in ((date(2026, 9, 5), "E0002"), (date(2025, 12, 31), "E-001")):
        got = protect.pseudonymise(rows.withColumn("n", F.col("service_number")), "s3cret", on, CFG)
        for r in got.collect():
            want = hmac.new(b"s3cret", f"{label}:{r.n}".encode(), hashlib.sha256).hexdigest()[:32]
            assert r.pid == want
        assert "service_number" not in got.columns


def test_sealed_rows_open_only_for_their_person(spark):
    key = F.lit(b"k" * 32)
    rows = spark.createDataFrame([("p1", "x"), ("p2", "y")], "pid STRING, body STRING").withColumn(
        "blob", protect.seal(F.col("body"), key, F.col("pid")))
    rows = rows.withColumn("own", protect.unseal(F.col("blob"), key, F.col("pid"))).withColumn(
        "moved", protect.unseal(F.col("blob"), key, F.lit("p1")))
    got = {r.pid: (r.own, r.moved) for r in rows.collect()}
    assert got == {"p1": ("x", "x"), "p2": ("y", None)}


def test_locale_hash_ignores_metadata(spark, tmp_path):
    body = {"b": {"x": "één", "y": "2"}, "a": "1"}
    meta = {"locale": "en", "name": "English", "englishName": "English", "direction": "ltr",
            "textVersion": "v1", "reviewStatus": "source", "reviewedBy": "", "reviewedOn": ""}
    write(tmp_path / "en.json", json.dumps({"_meta": meta, **body}, indent=2))
    write(tmp_path / "hi.json", json.dumps(
        {"a": "1", "b": {"y": "2", "x": "één"},
         "_meta": {**meta, "locale": "hi", "reviewStatus": "draft"}}))
    write(tmp_path / "fr.json", json.dumps({"_meta": {**meta, "locale": "fr"}, **body, "a": "3"}))
    got = {r.locale: r for r in documents.locales(spark, str(tmp_path / "*.json")).collect()}
    assert got["en"].content_hash == got["hi"].content_hash != got["fr"].content_hash
    canonical = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert got["en"].content_hash == hashlib.sha256(canonical.encode()).hexdigest()
    assert (got["en"].text_version, got["hi"].review_status) == ("v1", "draft")
    usable = consent_locales(documents.locales(spark, str(tmp_path / "*.json")))
    assert sorted(r.locale for r in usable.collect()) == ["en", "fr"]


def test_exports(spark, tmp_path):
    from vigilframe.operators import features

    signals = T.event_signals(spark, SMALL)
    sample = sinks.recent_sample(signals, "U1", 25)
    sinks.write_csv(sample, str(tmp_path / "sample"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sample"))
    assert back.count() == 25 and {r.unit_id for r in back.collect()} == {"U1"}
    oldest = sample.agg(F.min("observed_at")).first()[0]
    newer = signals.filter((F.col("unit_id") == "U1") & (F.col("observed_at") > F.lit(oldest)))
    assert newer.count() <= 25
    people = spark.createDataFrame([("p", "U1", 0.55), ("q", "U1", 0.54)],
                                   "pid STRING, unit_id STRING, score DOUBLE")
    units = spark.createDataFrame([("U1", "field")], "unit_id STRING, kind STRING")
    assert [r.label_positive for r in sinks.labelled_roster(people, units).orderBy("pid")
            .collect()] == [1, 0]
    matrix = features.feature_matrix(profile_of(spark, SMALL), T.EVENTS_CONFIG)
    groups = matrix.select("pid", F.lit("a").alias("rank"), F.lit(1).alias("label"))
    out = sinks.training_matrix(matrix, groups, T.EVENTS_CONFIG)
    assert len(out.columns) == 5 * 5 + 2
    sinks.write_parquet(signals.select("pid", "domain", "value"), str(tmp_path / "p"), "domain")
    only = signals.filter("domain = 'leave'").select("pid", "domain", F.lit(0.5).alias("value"))
    sinks.write_parquet(only, str(tmp_path / "p"), "domain")
    assert spark.read.parquet(str(tmp_path / "p")).count() == signals.count()


def test_snapshot_merge(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "pid STRING, seq INT, v STRING")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, "w"), ("b", 1, "late")], old.schema)
    got = {r.pid: r.v for r in sinks.merged_snapshot(old, new, "pid", "seq").collect()}
    assert got == {"a": "x", "b": "z", "c": "w"}
