"""No identity without a committed record."""

import pytest
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vigilframe.operators import access
from vigilframe.plans import disclosure as plans
from vigilframe.sources import commit_log
from vigilframe.sources import tables as T


@pytest.fixture(scope="module")
def parts(spark):
    directory = T.read(spark, SMALL, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), F.col("c_name").alias("identity"))
    people = directory.select("pid")
    consent = people.select("pid", F.lit("ACTIVE").alias("status"), F.lit(True).alias("welfare_contact"))
    verdicts = people.select("pid", F.lit("ESCALATE").alias("decision"), F.lit(0.9).alias("composite"))
    return plans.requests(spark, SMALL), consent, verdicts, directory


def test_identities_follow_the_record(spark, parts, tmp_path):
    requests, consent, verdicts, directory = parts
    out = access.disclose(*parts, str(tmp_path / "log"))
    granted = {r.seq for r in out.where("granted").collect()}
    logged = commit_log.committed(spark, str(tmp_path / "log"))
    assert granted and granted <= {r.seq for r in logged.where("action = 'disclosure.granted'").collect()}
    assert out.count() == requests.count() and out.where("identity is not null and not granted").count() == 0
    assert "identity" not in access.decide(requests, consent, verdicts).columns
    # a later batch does not read the grants of an earlier one
    again = access.disclose(requests.where("seq < 0"), consent, verdicts, directory, str(tmp_path / "log"), 1)
    assert again.count() == 0


def test_a_failing_ledger_shows_nobody(spark, parts, tmp_path, monkeypatch):
    def broken(rows, path, batch):
        raise OSError("storage rejected the append")

    monkeypatch.setattr(commit_log, "append", broken)
    asked = []

    class Directory:
        def __getattr__(self, name):
            asked.append(name)
            raise AssertionError("the directory was read")

    with pytest.raises(OSError):
        access.disclose(*parts[:3], Directory(), str(tmp_path / "log"))
    assert asked == []


def test_rows_without_a_commit_release_nobody(spark, parts, tmp_path):
    """Power lost between the rows and their manifest; files changed after it."""
    path, decided = str(tmp_path / "log"), access.decide(*parts[:3]).cache()
    rows = access.ledger_rows(decided, "seq")
    rows.write.parquet(f"{path}/rows/batch=0")
    commit_log.append(rows.limit(0), path, 5)  # some other batch is committed
    out = access.resolve(decided, commit_log.committed(spark, path), parts[3])
    assert out.where("granted or identity is not null").count() == 0
    refused = out.where("action = 'disclosure.granted'").select("refused_because").distinct().collect()
    assert [r[0] for r in refused] == [access.NOT_RECORDED]
    commit_log.append(rows, path, 0)  # the batch is handed over again
    whole = commit_log.committed(spark, path)
    assert whole.count() == rows.count() and set(whole.columns) == {*rows.columns, "batch"}
    assert access.resolve(decided, whole, parts[3]).where("granted").count() > 0
    rows.limit(1).write.mode("append").parquet(f"{path}/rows/batch=0")
    assert commit_log.committed(spark, path).count() == 0


def test_an_empty_log(spark, tmp_path):
    with pytest.raises(AnalysisException):
        commit_log.committed(spark, str(tmp_path / "none"))
