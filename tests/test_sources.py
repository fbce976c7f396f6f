"""Files of logs, drifts and results."""

import pytest
from pyspark.sql import functions as F

from tracelens.sources import logs, results

XES = """<?xml version="1.0"?><log><trace><string key="concept:name" value="c1"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="r"/><date key="time:timestamp" value="2023-01-01T10:00:00.000+00:00"/></event>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2023-01-01T10:01:00.000+00:00"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="A"/><date key="time:timestamp" value="2023-01-01T09:00:00.000+00:00"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    (tmp_path / "log.xes").write_text(XES)
    rows = logs.read_xes(spark, str(tmp_path / "log.xes")).orderBy("case_id", "o0").collect()
    assert [(r["case_id"], r["activity"], r["o0"], r["resource"]) for r in rows] == [("c1", "A", 0, "r"), ("c1", "B", 1, None), ("c2", "A", 0, None)]
    assert rows[1]["ts"].minute == 1


def test_csv_log_and_parquet(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Case;Act;When;Who\n1;A;01.02.2020 10:30;x\n1;B;01.02.2020 11:00;y\n")
    log = logs.read_csv_log(spark, str(tmp_path / "log.csv"), "Case", "Act", "When", "Who", ";", "dd.MM.yyyy HH:mm")
    assert log.orderBy("ts").first()["ts"].month == 2
    logs.write_log(log.withColumn("dataset", F.lit("d")), str(tmp_path / "out"), ["dataset"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_drift_tables(spark, tmp_path):
    head = "calc_change_id,calc_change_index,calc_change_type,calc_change_moment,calc_drift_id\n"
    (tmp_path / "a.csv").write_text(head + "0,10,sudden,2020-01-01 00:00:00,1\n1,20,sudden,2020-01-02 00:00:00,na\n2,30,sudden,2020-01-03 00:00:00,2\n")
    (tmp_path / "b.csv").write_text(head + "na,na,na,na,na\n")
    got = results.union_drifts(spark, [("A", "x", str(tmp_path / "a.csv")), ("B", "x", str(tmp_path / "b.csv")), ("C", "x", str(tmp_path / "none.csv"))]).collect()
    assert [(r["dataset"], r["change_point"]) for r in got] == [("A", 10)]
    assert [r["change_index"] for r in results.change_points(results.read_drift(spark, str(tmp_path / "a.csv"))).collect()] == [10, 20, 30]
    assert results.change_points(results.read_drift(spark, str(tmp_path / "b.csv"))).count() == 0
    assert results.read_drift(spark, str(tmp_path / "none.csv")).count() == 0


def test_complexity_and_master(spark, tmp_path):
    (tmp_path / "w.csv").write_text("window_id,first_index,last_index,measure_x\n0,0,9,1.5\n")
    df = results.read_complexity(spark, [("A", str(tmp_path / "w.csv")), ("B", str(tmp_path / "none.csv"))])
    assert (df.first()["n_traces"], df.first()["n_traces_in_window"]) == (9, 10)
    master = spark.createDataFrame([("m", 0.5, 7.0), ("k", float("inf"), None)], "metric string, rho double, n double")
    results.write_master(master, str(tmp_path / "m"))
    got = {r["metric"]: r for r in results.read_master(spark, str(tmp_path / "m"), "metric string, rho double, n long").collect()}
    assert got["m"]["rho"] == 0.5 and got["m"]["n"] == 7 and got["k"]["rho"] is None
    assert results.read_master(spark, str(tmp_path / "no"), "a string") is None
    results.write_complexity(df.withColumn("config", F.lit("c")), str(tmp_path / "cx"))
    results.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.parquet(str(tmp_path / "cx")).count() == 1


def test_catalogue_and_experiments(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"A": {"name": "a", "short_name": "s", "type": "real", "path": "p"}, "B": {"name": "b", "short_name": "t", "type": "synthetic", "path": "q"}}')
    assert [r["dataset"] for r in results.catalogue(spark, str(tmp_path / "c.json"), ["real"]).collect()] == ["A"]
    rows = spark.createDataFrame([("e1", "A"), ("e1", "B"), ("e2", "A")], "experiment string, dataset string")
    assert [r["dataset"] for r in results.in_all_experiments(rows).collect()] == ["A"]
    ids = results.with_sample_ids(spark.createDataFrame([("m", 5, 1), ("m", 5, 2)], "metric string, sample_size int, row int"))
    assert sorted(r["sample_id"] for r in ids.collect()) == ["0", "1"]


def test_measures_of_all_experiments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_size, sample_id ,m1,note\n50,7,1.5,x\n")
    (tmp_path / "b.csv").write_text("sample_size,m1,m2\n50,2.5,3\n50,3.5,4\n")
    (tmp_path / "bad.csv").write_text("m1\n1\n")
    paths = [("e1", "A", str(tmp_path / "a.csv")), ("e2", "A", str(tmp_path / "b.csv")), ("e2", "B", str(tmp_path / "b.csv")), ("e1", "B", str(tmp_path / "none.csv"))]
    got = results.read_measures(spark, paths)
    assert sorted((r["experiment"], r["dataset"], r["sample_id"], r["m1"]) for r in got.collect()) == [("e1", "A", "7", 1.5), ("e2", "A", "0", 2.5), ("e2", "A", "1", 3.5)]
    assert sorted(results.measure_columns(got)) == ["m1", "m2"] and results.measure_columns(got, ["m2"]) == ["m2"]
    with pytest.raises(ValueError):
        results.measure_columns(got, ["m9"])
    with pytest.raises(ValueError):
        results.read_measures(spark, [("e1", "A", str(tmp_path / "bad.csv"))])


def test_named_studies(spark):
    from tracelens.plans import jobs

    assert len(jobs.STUDIES) == 6 and all(s.base is None or s.base in jobs.STUDIES for s in jobs.STUDIES.values())
    rows = [(log, size, str(k), p, ["A", "B", "CDE"[(k + p) % 3]], 3) for log in ("RTFMP", "O2C_S") for size in (3, 5) for k in range(4) for p in range(size)]
    members = spark.createDataFrame(rows, "log string, sample_size int, sample_id string, pos long, acts array<string>, len int")
    done = jobs.named_study(members, "real_base", [3, 5])
    assert {r["log"] for r in done["raw_real_base"].select("log").distinct().collect()} == {"RTFMP"}
