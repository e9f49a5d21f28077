import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataudit.functions.spread import collect_in_parts
from strataudit.functions.versions import compare_versions
from strataudit.operators import cache, reports, requests, usage
from strataudit.schemas import REQUEST
from strataudit.streaming import usage as stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([("TestApp", 0, "legal", False), ("LargeApp", 0, " ", True), ("Idle", 0, None, False)],
                                 "record_id string, part int, reviewer_group string, is_overflow boolean")


def _log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=i * 7), *r) for i, r in enumerate(rows)], REQUEST)


LOG = [  # record_id, source, version, reviewer, partial
    ("TestApp", "cli", "1.0", "ann", False), ("TestApp", "cli", "", "bob", False), ("TestApp", "mcp", None, "bob", False),
    ("TestApp", "browser", None, "", False), (" TestApp ", None, None, "zed", False), ("Nope", "cli", "1", "ann", False),
    ("Nope", "cli", "", "ann", False), ("", "cli", "", "ann", False), (None, None, None, None, False), ("  ", "x", "", "", True),
    ("test", "cli", "", "ann", True), ("zzz", "cli", "1", "ann", True), ("LargeApp", "x", "", "ann", False),
    ("TestApp", "x", "", "", None),
]
STATUS = [200, 426, 426, 200, 200, 404, 426, 400, 400, 400, 200, 404, 200, 200]


def test_outcomes(spark, records):
    got = {r.event_id: r.status for r in requests.outcomes(_log(spark, LOG), records).collect()}
    assert [got[i] for i in range(len(LOG))] == STATUS


def test_usage_batch_and_stream_agree(spark, records, tmp_path):
    log = _log(spark, LOG)
    log = log.withColumn("record_id", F.trim("record_id"))
    folder, table = str(tmp_path / "log"), str(tmp_path / "table")
    for i in range(4):
        log.filter(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(folder)
    hits = requests.usage_hits(requests.exact_outcomes(log, records))
    live = requests.usage_hits(requests.exact_outcomes(stream.read_requests(spark, folder, REQUEST, files_per_batch=1), records))
    for name, keys, build in (("counters", ["record_id"], usage.counters), ("who", ["record_id", "reviewer"], usage.reviewer_hits),
                              ("daily", ["record_id", "day"], lambda h: usage.daily(h, "7 days" if h.isStreaming else None))):
        stream.start_updates(build(live), f"{table}/{name}", f"{table}/{name}-checkpoint").awaitTermination()
        want = sorted(map(tuple, build(hits).collect()))
        assert sorted(map(tuple, stream.latest_rows(spark, f"{table}/{name}", keys).collect())) == want and want
    by = {r.record_id: r for r in usage.counters(hits).collect()}
    assert (by["TestApp"].hit_count, by["TestApp"].last_reviewer, by["TestApp"].legal_reviewer_group) == (4, "zed", "legal")
    assert by["TestApp"].last_hit == T0 + dt.timedelta(hours=13 * 7)
    sets = {r.record_id: r.reviewers for r in usage.reviewer_sets(hits).collect()}
    assert sets == {"TestApp": ["ann", "zed"], "LargeApp": ["ann"]}
    assert [r.record_id for r in usage.never_reviewed(records, hits).collect()] == ["Idle"]
    groups = [tuple(r) for r in cache.statistics("reviewer-groups", records, usage.counters(hits)).collect()]
    assert groups == [("legal", 1, 4), ("Unknown", 1, 1)]
    assert usage.most_used(usage.counters(hits)).first().record_id == "TestApp"


def test_padded_ids_count_under_the_trimmed_one(spark):
    seen = spark.createDataFrame([("A", 200, False), (" A ", 200, False), ("\tA\n", 200, False), (" B", 404, False)],
                                 "record_id string, status int, is_partial boolean")
    assert [r.record_id for r in requests.usage_hits(seen).collect()] == ["A"] * 3


def test_statistics(spark, records):
    assert cache.statistics("count", records).first()[0] == 3
    assert [r[0] for r in cache.statistics("list", records).collect()] == ["Idle", "LargeApp", "TestApp"]
    assert tuple(cache.statistics("cache-stats", records).first()) == (3, 1, 2)
    with pytest.raises(ValueError):
        cache.statistics("other", records)


def test_semver(spark):
    cases = [("1.9.0", "1.10.0", -1), ("1.10.0", "1.9.0", 1), ("1.0", "2.0.0", 0), ("a.b.c", "1.0.0", 0), ("-1.0.0", "1.0.0", 0),
             (" 1.0.0 ", "1.0.0", 0), ("1.0.0", "", 0), (None, "1.0.0", 0), ("1.2.3.4", "0.0.1", 0), ("0.0.10", "0.0.9", 1),
             ("99999999999999999999.0.0", "1.0.0", 1)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    assert [r[0] for r in df.select(compare_versions("a", "b")).collect()] == [c[2] for c in cases]


def test_versions(spark):
    versions = spark.createDataFrame([("a", "2.0.0", "1.0.0"), ("b", "", "1.0.0"), ("c", None, None)],
                                     "tool_name string, latest_version string, minimum_required_version string")
    clients = [("a", "0.9.0", "blocked"), ("a", "1.5.0", "update_available"), ("a", "2.0.0", "up_to_date"), ("a", "dev", "up_to_date"),
               ("b", "1.0.0", "error"), ("c", "1.0.0", "error"), ("z", "1.0.0", "error")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(clients)], "id int, tool_name string, local_version string")
    got = {r.id: r.status for r in requests.client_status(df, versions).collect()}
    assert [got[i] for i in range(len(clients))] == [c[2] for c in clients]
    asked = spark.createDataFrame([(0, " a "), (1, ""), (2, None), (3, "z"), (4, "c")], "id int, tool_name string")
    got = {r.id: (r.status, r.latest_version) for r in requests.version_lookup(asked, versions).collect()}
    assert got == {0: (200, "2.0.0"), 1: (400, None), 2: (400, None), 3: (404, None), 4: (200, "")}


def test_report_numbers(spark):
    names = ["A_review_20240101_001.md", "A_review_20240101_002.md", "B_review_20240101_001.md", "B_review_20240101_005.md",
             "C_review_20240101_999.md", "D_review_20231231_007.md", "E_review_20240101_001.txt", "x.md", "E_review_20240101_1.md.bak",
             "F_review_20240101_2_review_20240101_004.md"]
    old = spark.createDataFrame([(n,) for n in names], "name string")
    new = spark.createDataFrame([(r, r, T0) for r in ("A", "B", "C", "D", "E", "F")], "review_id string, record_id string, created timestamp")
    got = {r.record_id: r.report_name for r in reports.report_names(new, old).collect()}
    assert got == {"A": "A_review_20240101_003.md", "B": "B_review_20240101_006.md", "C": "C_review_20240101_1000.md",
                   "D": "D_review_20240101_001.md", "E": "E_review_20240101_001.md", "F": "F_review_20240101_001.md"}
    many = spark.range(3000).select(F.col("id").cast("string").alias("review_id"), F.lit("A").alias("record_id"),
                                    (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") % 50).cast("int"))).alias("created"))
    rows = reports.report_names(many, old).collect()
    assert sorted(r.seq for r in rows) == list(range(3, 3003))


def test_collect_in_parts(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cool").alias("k"), (F.col("id") % 300).cast("string").alias("v"))
    parts = collect_in_parts(rows, ["k"], "v", "vs", 100).collect()
    hot = [r for r in parts if r.k == "hot"]
    assert len(hot) == 3 and sorted(v for r in hot for v in r.vs) == sorted(map(str, range(300)))
    cool = [r for r in parts if r.k == "cool"]
    assert len(cool) == 1 and len(cool[0].vs) == 100 and cool[0].vs == sorted(cool[0].vs)


def test_parts_of_a_hot_key_go_to_several_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("v"))
        plan = collect_in_parts(rows, ["k"], "v", "vs", 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[:plan.index("SortMergeJoin")]
    exchange = next(line for line in above.splitlines() if "Exchange hashpartitioning" in line)
    assert "n_parts" in exchange and "part#" in exchange
