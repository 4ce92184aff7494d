import datetime

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import cache, files
from tidegrid.streaming.pipelines import delayed_month_stream, persistence_stream, run_once, run_updates, weekly_max_stream


def test_measurement_files(spark, tmp_path):
    a = tmp_path / "twin-harbors-da.csv"
    a.write_text('﻿CollectDate,Domoic Result\n1/9/2002,5\n2/3/02,<1\nbad,4\n01/10/2002,"7"\n', encoding="utf-8")
    b = tmp_path / "newport_da.csv"
    b.write_text("﻿Harvest Month,Harvest Date,Harvest Year,Domoic Acid\nJanuary,8,2002,1.5\nJune,1,20021,3\n", encoding="utf-8")
    got = sorted((str(r["date"]), r["site"], r["da_raw"]) for r in files.read_measurements(spark, [str(a), str(b)]).collect())
    assert got == [("2002-01-08", "Newport", 1.5), ("2002-01-09", "Twin Harbors", 5.0), ("2002-01-10", "Twin Harbors", 7.0)]
    assert files.read_measurements(spark, [str(a)], "half").count() == 3


def test_count_files(spark, tmp_path):
    a = tmp_path / "long-beach-pn.csv"
    a.write_text('\ufeffDate,Pseudo-nitzschia count (Cells/L)\n01/10/02,"4,000"\n1/3/2003, 50\n,\n1/4/2003,"5\nshort\n', encoding="utf-8")
    b = tmp_path / "newport-pn.csv"
    b.write_text("Total Pseudo-nitzschia,Note,DATE\n7,x,2/30/2003\n8,,3/1/2003\n", encoding="utf-8")
    (tmp_path / "other-pn.csv").write_text("a,b\n1/1/2003,5\n", encoding="utf-8")
    got = files.read_counts(spark, [str(x) for x in (a, b, tmp_path / "other-pn.csv")]).collect()
    assert sorted((str(r["date"]), r["site"], r["pn"]) for r in got) == [("2002-01-10", "Long Beach", 4000.0), ("2003-01-03", "Long Beach", 50.0), ("2003-03-01", "Newport", 8.0)]
    with pytest.raises(ValueError):
        files.read_counts(spark, [])


def test_a_failed_chunk_costs_no_other(spark):
    def fetch(address):
        if address.startswith("bad"):
            raise OSError("gone")
        return address.encode()

    tasks = spark.createDataFrame([(1, "good/1"), (2, "bad/2"), (3, None), (4, "good/4")], "n int, url string")
    got = {r["n"]: (r["body"] and bytes(r["body"]), r["error"]) for r in files.fetch_chunks(tasks, "url", fetch, attempts=2).collect()}
    assert got == {1: (b"good/1", None), 2: (None, "OSError: gone"), 3: (None, "no address"), 4: (b"good/4", None)}
    assert files.fetch_chunks(tasks.limit(0), "url", fetch).count() == 0


def test_flow_json(spark):
    def body(code, values):
        return '{"value":{"timeSeries":[{"variable":{"variableCode":[{"value":"%s"}]},"values":[{"value":[%s]}]}]}}' % (code, values)

    rows = [(1, body("00060", '{"dateTime":"2020-01-01","value":"3"},{"dateTime":"2020-01-02","value":"-1"},{"dateTime":"2020-01-03","value":"x"}')), (2, body("1", '{"dateTime":"2020-01-01","value":"4"}')), (3, "broken"), (4, None)]
    assert sorted((r["id"], r["value"]) for r in files.parse_flow_json(spark.createDataFrame(rows, "id int, body string"), "body", "00060").collect()) == [(1, 3.0), (2, 4.0)]


def test_cache(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    entries = cache.with_expiry(spark.createDataFrame([("a:x", 1, t), ("a_y", 2, t), ("b:x", 3, t)], "key string, v int, written timestamp"), "written")
    assert [r["v"] for r in cache.live(entries, "2024-01-05", "a:*").collect()] == [1]
    assert cache.live(entries, "2024-01-09").count() == 0
    fresh = cache.put(entries, entries.where("key = 'a:x'").withColumn("v", F.lit(9)))
    assert sorted(r["v"] for r in fresh.collect()) == [2, 3, 9]
    assert cache.drop_matching(entries, "a*").count() == 1
    runs = []
    make = lambda: runs.append(1) or entries
    for _ in range(2):
        assert cache.load_or_run(spark, {"k": 1}, make, root=str(tmp_path)).count() == 3
    assert len(runs) == 1


def test_tiers(spark, tmp_path):
    fast, slow = str(tmp_path / "fast"), str(tmp_path / "slow")
    runs = []
    make = lambda: runs.append(1) or spark.range(3)
    assert cache.tiered(spark, {"k": 1}, make, [slow]).count() == 3
    assert cache.tiered(spark, {"k": 1}, make, [fast, slow]).count() == 3 and len(runs) == 1
    assert cache.load_or_run(spark, {"k": 1}, make, root=fast).count() == 3 and len(runs) == 1
    assert cache.tiered(spark, {"k": 2}, make, [fast, slow]).count() == 3 and len(runs) == 2
    assert cache.load_or_run(spark, {"k": 2}, make, root=slow).count() == 3 and len(runs) == 2


def test_streams(spark, tmp_path):
    rows = [("A", datetime.datetime(2020, 1, 6, 1), 5.0), ("A", datetime.datetime(2020, 1, 12, 23), 25.0), ("A", datetime.datetime(2020, 1, 13), 3.0)]
    schema = "site string, t timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    weekly = run_updates(weekly_max_stream(stream, site="site", moment="t", value="value"), "weekly_test", ["site", "week"], "value")
    assert sorted((str(r["week"]), r["value"]) for r in weekly.collect()) == [("2020-01-06", 25.0), ("2020-01-13", 3.0)]
    seen = run_once(persistence_stream(stream, site="site", moment="t", value="value"), "persistence_test")
    assert [(r["last_observed"], r["days_since_spike"]) for r in seen.orderBy("t").collect()][1:] == [(5.0, None), (25.0, 1 / 24)]
    index = spark.createDataFrame([(datetime.date(2019, 12, 5), 7.0)], "m date, idx double")
    met = run_once(delayed_month_stream(stream, index, moment="t", month="m", months_back=1, payload=["idx"]), "delayed_test")
    assert [r["idx"] for r in met.collect()] == [7.0] * 3
    # a second batch goes on from the state that the first left
    more = [("A", datetime.datetime(2020, 1, 14), None), ("A", datetime.datetime(2020, 1, 15), 1.0), ("B", datetime.datetime(2020, 1, 15), 1.0)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = run_once(persistence_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), site="site", moment="t", value="value"), "again")
    got = {(r["site"], r["t"].day): (r["last_observed"], r["days_since_spike"]) for r in seen.collect()}
    assert got["A", 15] == (3.0, 2 + 1 / 24) and got["A", 14] == (3.0, 1 + 1 / 24) and got["B", 15] == (None, None)
