"""The bucketed store of documents, its loads, its lookups, and the index of ids."""

import datetime as dt
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F, types as T

from strataudit.operators import cache, hierarchy
from strataudit.operators.id_index import SIZES, grams_of, records_with
from strataudit.operators.nesting import nest
from strataudit.schemas import DOCUMENT
from strataudit.session import work_path, work_table
from strataudit.sources.buckets import Store
from strataudit.streaming import usage as stream

NOW = dt.datetime(2024, 3, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def load(spark):
    """Cache rows of records with a description."""
    def rows(now, description, *names):
        docs = spark.createDataFrame([(n, 0, 1, (n, description, "", False, False, []), "") for n in names], T.StructType([
            T.StructField("record_id", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_parts", T.IntegerType()),
            T.StructField("doc", DOCUMENT), T.StructField("reviewer_group", T.StringType())]))
        return cache.split_overflow(cache.with_size(docs), now, 150)

    return rows


def held(store):
    return {r.record_id: (r.description, r.is_overflow) for r in store.documents().select("record_id", "doc.description", "is_overflow").collect()}


def names(n):
    return [f"rec-{k:03}" for k in range(n)]


def test_a_load_rewrites_touched_buckets_only(spark, load):
    store = Store(spark, work_path(spark, "test"), buckets=8)
    assert held(store) == {} and store.keys().count() == 0 and store.search("x").count() == 0
    store.load(load(NOW, "old", *names(40)), NOW)
    before = store.versions()
    assert len(before) == 8 and all(len(vs) == 1 for vs in before.values())
    store.load(load(NOW + HOUR, "new" * 30, "rec-003", "more"), NOW + HOUR)
    after = store.versions()
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and all(len(vs) == 1 for vs in after.values())
    want = dict.fromkeys(names(40), ("old", False)) | {"rec-003": ("new" * 30, True), "more": ("new" * 30, True)}
    assert held(store) == want
    assert {r.record_id: r.is_overflow for r in store.keys().collect()} == {k: v[1] for k, v in want.items()}


def test_a_load_writes_its_documents_once(spark, load):
    root = work_path(spark, "test")
    beside = lambda: {f.name for f in Path(urlparse(root).path).parent.glob("strataudit-load-*")}
    before, store = beside(), Store(spark, root, buckets=4)
    store.load(load(NOW, "old", *names(10)), NOW)
    store.load(load(NOW + HOUR, "new", "rec-003"), NOW + HOUR)
    assert beside() == before
    assert held(store) == dict.fromkeys(names(10), ("old", False)) | {"rec-003": ("new", False)}


def test_loads_at_once_lose_nothing(spark, load):
    store = Store(spark, work_path(spark, "test"), buckets=4)
    store.load(load(NOW, "first", *names(20)), NOW)
    one = store.prepare(load(NOW + 2 * HOUR, "late", "rec-001", "rec-002", "a"), NOW + 2 * HOUR)
    two = store.prepare(load(NOW + HOUR, "early", "rec-002", "rec-003", "b"), NOW + HOUR)
    assert held(store) == dict.fromkeys(names(20), ("first", False))  # prepared loads do not count
    store.commit(one)
    store.commit(two)
    want = dict.fromkeys(names(20), ("first", False)) | dict.fromkeys(["rec-001", "rec-002", "a"], ("late", False)) | dict.fromkeys(
        ["rec-003", "b"], ("early", False))
    assert held(store) == want and store.documents().count() == len(want) == store.keys().count()
    assert any(len(vs) > 1 for vs in store.versions().values())
    terms = spark.createDataFrame([("REC-00",), ("b",)], "t string")
    assert store.search_many(terms).filter("term = 'rec-00'").count() == 10
    assert sorted(r.record_id for r in store.lookup(["rec-002", "b", "none"]).collect()) == ["b", "rec-002"]
    store.load(load(NOW + 3 * HOUR, "last", *names(20)), NOW + 3 * HOUR)
    assert all(len(vs) == 1 for vs in store.versions().values())  # a later load takes over both
    assert held(store) == want | dict.fromkeys(names(20), ("last", False))


def test_a_failed_load_changes_nothing(spark, load):
    store = Store(spark, work_path(spark, "test"), buckets=4)
    store.load(load(NOW, "old", "a", "b"), NOW)
    broken = load(NOW, "new", "a").withColumn("bytes", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.load(broken, NOW)
    assert held(store) == {"a": ("old", False), "b": ("old", False)}
    store.load(load(NOW, "none").limit(0), NOW)  # an empty load
    assert len(held(store)) == 2


def test_a_record_in_parts_stays_whole(spark, make):
    apps = make.apps({"record_id": "a"}, {"record_id": "b"})
    objects = make.objects(*[("a", "s", f"o{k}", "x", "1", "3") for k in range(60)])
    docs = work_table(nest(apps, make.stores(("a", "s", "S", "t", "1")), objects, make.fields(), part_leaves=2), "test")
    store = Store(spark, work_path(spark, "test"), buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.load(cache.split_overflow(cache.with_size(docs), NOW), NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.keys().count() == 2 and store.lookup(["a"]).count() > 8
    held_objects = store.lookup(["a"]).selectExpr("explode(doc.data_stores) AS s").selectExpr("explode(s.data_objects) AS o")
    assert held_objects.select("o.object_id").distinct().count() == held_objects.count() == 60
    assert len(store.lookup(["a"]).inputFiles()) > 1  # written by several tasks


def test_one_key_opens_one_bucket_and_search_opens_keys_alone(spark, load):
    store = Store(spark, work_path(spark, "test"), buckets=16)
    store.load(load(NOW, "x", *names(200)), NOW)
    assert len(store.documents().inputFiles()) >= 16 and len(store.lookup(["rec-077"]).inputFiles()) == 1
    assert [r.record_id for r in store.lookup(["rec-077"]).collect()] == ["rec-077"]
    found = store.keys().filter(F.contains("record_id", F.lit("77")))
    plan = found.select("record_id")._jdf.queryExecution().toString()
    assert "doc" not in plan.split("ReadSchema")[-1] and all("/keys/" in urlparse(f).path for f in found.inputFiles())
    assert sorted(r.record_id for r in store.search("C-07").collect()) == [f"rec-07{k}" for k in range(10)]
    wanted = spark.createDataFrame([("rec-001",), ("rec-001",), (None,), ("zz",)], "id string")
    assert [r.record_id for r in store.lookup(wanted).collect()] == ["rec-001"]


# Index of ids

def test_grams_find_what_contains_finds(spark):
    rng = random.Random(1)
    ids = ["", "A", "aa", "Éclair_1%", "x" * 200] + ["".join(rng.choice("abAB_%1") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    ids = sorted({i for i in ids})
    terms = ["", "a", "ab", "%", "_1", "éC", "x" * 100, "x" * 201, "nothing here", None] + [i[k:k + n] for i in ids[::7] for k, n in (
        (rng.randint(0, 10), rng.randint(1, 20)),)]
    index = grams_of(spark.createDataFrame([(i,) for i in [*ids, None]], "record_id string"))
    got = sorted(tuple(r) for r in records_with(spark.createDataFrame([(t,) for t in terms], "t string"), index).collect())
    want = sorted({(t.lower(), i) for t in terms if t for i in ids if t.lower() in i.lower()})
    assert got == want and len(want) > 300


def test_grams_grow_with_the_length_not_its_square(spark):
    long = "".join(chr(97 + k % 26) + str(k) for k in range(300))
    index = grams_of(spark.createDataFrame([(long,)], "record_id string"))
    assert index.count() <= len(SIZES) * len(long)


# Plans and streams

def test_children_of_a_large_record_are_dealt_by_finer_keys(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = hierarchy.extract(make.apps({"record_id": "a"}), make.stores(), make.objects(), make.fields(), ids=spark.createDataFrame([("a",)], "i string"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert any("object_id" in line for line in dealt) and all("application_name" in line for line in dealt)


def test_compaction_keeps_the_newest_rows(spark):
    table = work_path(spark, "test")
    batches = [[("a", 1), ("b", 1)], [("a", 2)], [("c", 1)], [("b", 5), ("d", 1)]]
    newest = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, n int").write.parquet(f"{table}/batches/batch={k}")
        newest |= dict(rows)
        state = lambda: {r.k: r.n for r in stream.latest_rows(spark, table, ["k"]).collect()}
        assert state() == newest
        if k in (1, 3):
            stream.compact(spark, table, ["k"])
            assert state() == newest
    plan = stream.latest_rows(spark, table, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan  # batches that a base has are not opened


def test_a_large_bucket_is_written_by_many_tasks(spark, load):
    root = work_path(spark, "test")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        Store(spark, root, buckets=1).load(load(NOW, "", *names(4000)).repartition(8), NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list(Path(urlparse(root).path).glob("docs/version=*/bucket=0/is_overflow=*/*.parquet"))
    assert len(files) > 2 and Store(spark, root).documents().count() == 4000


def test_stored_documents_are_compressed_well(spark, load):
    root = work_path(spark, "test")
    Store(spark, root, buckets=4).load(load(NOW, "old", *names(10)), NOW)
    for table in ("docs", "keys", "grams"):
        found = list(Path(urlparse(f"{root}/{table}").path).rglob("part-*.parquet"))
        assert found and all(f.name.endswith(".zstd.parquet") for f in found)
