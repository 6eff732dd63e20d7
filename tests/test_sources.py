import datetime
import random

import pytest
from pyspark.sql import functions as F

from brightfield.sources import files
from brightfield.streaming import ledger
from tests.conftest import SF


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Keyword;Search Volume\n"a ""b""; c\nsecond line";1,000\nx;\n')
    df = files.read_delimited(spark, str(tmp_path / "a.csv"), ";")
    assert df.columns == ["keyword", "search_volume"]
    assert [tuple(r) for r in df.collect()] == [('a "b"; c\nsecond line', "1,000"), ("x", None)]
    files.write_delimited(spark.createDataFrame([(1, ["a", "b"], None)], "id int, list array<string>, note string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines()[0] == "id,list,note" and '"[""a"",""b""]"' in text


def test_report_with_preamble(spark, tmp_path):
    (tmp_path / "k.csv").write_text('Report\n"1 Jan - 2 Feb"\nKeyword,Avg. monthly searches,Competition\nyoga,"1,000",Low\n,5,\nspa,20,High\n')
    rows = files.read_planner(spark, str(tmp_path / "k.csv")).collect()
    assert sorted((r.keyword, r.avg_monthly_searches) for r in rows) == [("spa", "20"), ("yoga", "1,000")]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_planner(spark, str(tmp_path / "none.csv"))


def test_wide_and_too_wide_reports(spark, tmp_path):
    names = ",".join(f"n{i}" for i in range(90))
    (tmp_path / "wide.csv").write_text(f"Report\nKeyword,Avg. monthly searches,{names}\nyoga,5," + ",".join(map(str, range(90))) + "\n")
    (row,) = files.read_planner(spark, str(tmp_path / "wide.csv")).collect()
    assert row.n89 == "89" and len(row) == 92
    (tmp_path / "more.csv").write_text('Keyword,Avg. monthly searches\n"a\nb",1,"c\nd",2\n')
    with pytest.raises(ValueError):
        files.read_planner(spark, str(tmp_path / "more.csv"))


def test_malformed_lines_are_told(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{broken\n\n[1]\n{"a": "no"}\n{"b": 2}\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path / "x.json"), "a int").collect() if r.a is not None) == [1]
    assert {r.line for r in files.malformed_json_lines(spark, str(tmp_path / "x.json"), "a int").collect()} >= {"{broken", '{"a": "no"}'}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", ["x"], False), (2, None, ["y"], False)], "id int, v string, tags array<string>, flag boolean")
    new = spark.createDataFrame([(2, "b", ["a", "y"], True), (3, "c", ["z"], False)], "id int, v string, tags array<string>, flag boolean")
    merged = {r.id: (r.v, r.tags, r.flag) for r in files.merge_fields(old, new, ["id"], ("tags",), ("flag",)).collect()}
    assert merged == {1: ("a", ["x"], False), 2: ("b", ["a", "y"], True), 3: ("c", ["z"], False)}
    put = {r.id: r.v for r in files.upsert(old, new, ["id"], F.col("id") == 1).collect()}
    assert put == {1: "a", 2: "b", 3: "c"}
    assert sorted(r.id for r in files.insert_absent(old, new.union(new), ["id"]).collect()) == [1, 2, 3]


def test_windowed_stream(spark, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(src))
    stream = ledger.windowed_counts(ledger.events(spark, str(src)))
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.table("windowed").agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{SF}/events.parquet").count()


def test_touched_keys_are_recomputed(spark, tmp_path):
    src, target = tmp_path / "events", str(tmp_path / "t")
    every = spark.read.parquet(f"{SF}/events.parquet")
    for some in (every.where("event_id < 50"), every.where("event_id BETWEEN 50 AND 90")):
        some.write.mode("append").parquet(str(src))
        here = spark.read.parquet(str(src))
        q = ledger.keep_current(ledger.events(spark, str(src)), "user_id", lambda keys: here.join(keys, "user_id").groupBy("user_id").count(), target, str(tmp_path / "k"))
        q.awaitTermination()
    made = {r.user_id: r["count"] for r in ledger.merged_table(spark, target).collect()}
    assert made == {r.user_id: r["count"] for r in every.where("event_id <= 90").groupBy("user_id").count().collect()}


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    merge = ledger.merge_into(str(tmp_path / "t"), ["id"], 3)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    assert ledger.merged_table(spark, str(tmp_path / "t")) is None
    batches = [[(k, "a") for k in range(20)], [(3, "b"), (100, "b")], [(3, "c")], []]
    for number, rows in enumerate(batches):
        merge(frame(rows), number)
        merge(frame(rows), number)
    want = {k: "a" for k in range(20)} | {100: "b", 3: "c"}
    assert {r.id: r.v for r in ledger.merged_table(spark, str(tmp_path / "t")).collect()} == want


def test_clicks(spark):
    rows = ledger.clicks(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "curl/8"), (2, datetime.datetime(2024, 1, 1), "Mozilla/5.0")], "location_id int, clicked_at timestamp, user_agent string")).collect()
    assert [r.is_bot for r in rows] == [True, False] and len(rows[0].user_agent_hash) == 64


def brute_halts(rows, recent, share):
    """kind -> (n, failures, halted_at), looking at every window."""
    made = {}
    for kind in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == kind)
        flags = [f for _, f in mine]
        ends = [mine[e][0] for e in range(recent - 1, len(mine)) if sum(flags[e + 1 - recent : e + 1]) > share * recent]
        made[kind] = (len(flags[-recent:]), sum(flags[-recent:]), ends[0] if ends else None)
    return made


@pytest.mark.parametrize("recent,cuts", [(20, (12,)), (20, (3, 29, 30)), (500, (2000,)), (500, (700, 1400))])
def test_failing_tasks_halt_for_good(spark, tmp_path, recent, cuts):
    rng = random.Random(recent + len(cuts))
    rows = [("early", k, k < 300) for k in range(2000)]  # one batch: windows within it count, and a halt lasts
    rows += [("edge", k, k % 4 == 0) for k in range(1000)] + [("over", k, k % 4 == 0 or k == 601) for k in range(1000)] + [("few", k, True) for k in range(recent - 1)]
    rows += [("random", k, rng.random() < 0.24) for k in range(2000)]
    df = spark.createDataFrame(rows, "kind string, at long, failed boolean")
    made = {}
    for low, high in zip((0, *cuts), (*cuts, 10_000)):
        df.where((F.col("at") >= low) & (F.col("at") < high)).write.mode("append").parquet(str(tmp_path / "s"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
        sink = lambda out, _: made.update({r.kind: (r.n, r.failures, r.halted_at) for r in out.collect()})
        query = ledger.failure_halts(stream, recent).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
        query.awaitTermination()
    want = brute_halts(rows, recent, 0.25)
    assert made == want
    assert want["edge"][2] is None and want["over"][2] == (601 if recent == 500 else want["over"][2]) and want["early"][2] is not None and want["few"][2] is None
