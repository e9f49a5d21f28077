import itertools

from pyspark.sql import functions as F

from strataudit.operators import counts, filters, hierarchy as H
from strataudit.operators.nesting import nest
from strataudit.schemas import ORPHAN_STORE


def _volumes(make, n_apps, n_stores, n_objects, n_fields):
    apps = [{"record_id": f"a{a}"} for a in range(n_apps)]
    stores, objects, fields = [], [], []
    for a, s in itertools.product(range(n_apps), range(n_stores)):
        stores.append((f"a{a}", f"s{s}", f"store {s}", "t", "1"))
        for o in range(n_objects):
            objects.append((f"a{a}", f"s{s}", f"s{s}o{o}", "o", "true", "1"))
            fields += [(f"a{a}", f"s{s}o{o}", f"f{f}", "d", "string") for f in range(n_fields)]
    return make.apps(*apps), make.stores(*stores), make.objects(*objects), make.fields(*fields)


def test_rows_are_the_product_of_the_levels(make):
    for orphans in (True, False):
        flat = H.flat_join(*_volumes(make, 3, 2, 4, 5), orphans=orphans)
        assert flat.count() == 3 * 2 * 4 * 5
        assert {r.flat_rows for r in H.row_counts(flat).collect()} == {40}


def test_record_parts(make):
    stores = make.stores(*[("a", f"s{i}", "S", "t", "1") for i in range(3)], ("b", "s", "S", "t", "1"))
    objects = make.objects(*[("a", f"s{i}", "shared", "O", "1", "1") for i in range(3)], ("b", "s", "o", "O", "1", "1"))
    fields = make.fields(*[("a", "shared", f"f{i}", "d", "t") for i in range(20)], *[("b", "o", f"f{i}", "d", "t") for i in range(5)])
    # a has 3 stores, 3 objects and 3 times 20 fields; b has 1, 1 and 5.
    size = lambda limit: {(r.record_id, r.n_parts, r.spread) for r in H.record_parts(stores, objects, fields, limit).collect()}
    assert size(66) == {("a", 1, 1), ("b", 1, 1)} and size(65) == {("a", 2, 1), ("b", 1, 1)}
    assert size(8) == {("a", 9, 3), ("b", 1, 1)} and size(6) == {("a", 11, 4), ("b", 2, 1)}
    apps = make.apps({"record_id": "a"}, {"record_id": "b"})
    assert H.flat_join(apps, stores, objects, fields).count() == 65


def test_no_job_runs_while_a_query_is_built(make, spark):
    tables = _volumes(make, 2, 2, 2, 2)
    spark.sparkContext.setJobGroup("build", "build")
    try:
        nest(*tables, part_leaves=3)
        H.extract(*tables, logins=["x"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_newest_snapshot_and_first_copy(make):
    apps = make.apps({"record_id": "a", "snapshot_date": "2024-01-02", "snapshot_hour": "01", "app_description": "late"},
                     {"record_id": "a", "snapshot_date": "2024-01-02", "snapshot_hour": "00", "app_description": "early"},
                     {"record_id": "a", "snapshot_date": "2024-01-01", "snapshot_hour": "23", "app_description": "old"})
    stores = make.stores(("a", "s", "zz", "t", "1"), ("a", "s", "aa", "t", "1"))
    rows = H.flat_join(apps, stores, make.objects(), make.fields()).collect()
    assert [(r.app_description, r.data_store_name) for r in rows] == [("late", "aa")]


def test_orphans_dangling_and_bare_records(make):
    apps = make.apps(*[{"record_id": r} for r in ("lost", "bare", "full", "empty")])
    stores = make.stores(("full", "s", "S", "t", "1"), ("empty", "e", "E", "t", "0"), ("full", "", "blank id", "t", "0"))
    objects = make.objects(
        ("lost", None, "o1", "O1", "true", "", "Warehouse"), ("lost", "", "o2", "O2", "true", "", "Warehouse"),
        ("full", "s", "o3", "O3", "1", "9"), ("full", "gone", "o4", "O4", "1", "9"), ("", None, "o5", "O5", "1", "9"),
        ("nobody", None, "o6", "O6", "1", "9"))
    fields = make.fields(("lost", "o1", "f", "d", "t"), (None, None, "f", "d", "t"))
    rows = lambda **kw: {(r.record_id, r.data_store_id, r.store_technology, r.object_id, r.field_name)
                         for r in H.flat_join(apps, stores, objects, fields, **kw).collect()}
    assert rows() == {
        ("lost", ORPHAN_STORE, "Warehouse", "o1", "f"), ("lost", ORPHAN_STORE, "Warehouse", "o2", None),
        ("full", "s", "t", "o3", None), ("full", "", "t", None, None), ("empty", "e", "t", None, None),
        ("bare", None, None, None, None)}
    assert [r.record_id for r in H.bare_records(apps, stores, objects).collect()] == ["bare"]
    plain = {(r[0], r[3]) for r in rows(orphans=False)}
    assert plain == {("lost", None), ("full", "o3"), ("full", None), ("empty", None), ("bare", None)}


def test_filters(make, spark):
    apps = make.apps({"record_id": "a", "owner_login": "x"}, {"record_id": "b", "supervisor_login": "x"},
                     {"record_id": "c", "reports_to_level_6_login": "x", "reports_to_level_1_login": "y"},
                     {"record_id": "d", "owner_login": "z"}, {"record_id": "", "owner_login": "x"})
    ids = lambda df: sorted(r.record_id for r in df.collect())
    table = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "login string")
    assert ids(filters.by_owner(apps, ["x", "y"])) == ids(filters.by_owner(apps, table)) == ["", "a", "b", "c"]
    assert [r.record_id for r in filters.record_ids(apps, ["x"]).collect()] == ["a", "b", "c"]
    wanted = spark.createDataFrame([("a",), ("d",), ("a",), ("q",)], "id string")
    assert ids(filters.by_records(apps, wanted)) == ids(filters.by_records(apps, ["a", "d", "q"])) == ["a", "d"]
    quoted = make.apps({"record_id": "O'Neil"})
    assert ids(filters.by_records(quoted, ["O'Neil"])) == ["O'Neil"]


def test_counts_and_summary(make):
    apps, stores, objects, fields = _volumes(make, 2, 2, 3, 1)
    assert {r.object_count for r in counts.object_counts(objects).collect()} == {6}
    assert counts.outlier_records(objects, 6).count() == 0 and counts.outlier_records(objects, 5).count() == 2
    assert counts.large_stores(objects, 3).count() == 0 and counts.large_stores(objects, 2).count() == 4
    more = objects.union(make.objects(("a0", "gone", "x", "x", "1", "1"), ("a0", None, "y", "y", "1", "1")))
    row = counts.extraction_summary(H.flat_join(apps, stores, more, fields), more).first()
    assert (row.flat_rows, row.records, row.stores, row.objects, row.orphans, row.fields) == (13, 2, 4, 13, 1, 12)
    assert row.join_success_rate == round(13 / 14, 6)


def test_objects_without_a_name_are_counted(make):
    objects = make.objects(*[(name, "s", f"{name}{i}", "n", "1", "1") for name in ("a", "", None) for i in range(3)])
    assert {r.application_name: r.object_count for r in counts.object_counts(objects).collect()} == {"a": 3, "": 3, None: 3}
    assert {r.application_name for r in counts.outlier_records(objects, 2).collect()} == {"a", "", None}
    assert {(r.application_name, r.data_store_id) for r in counts.large_stores(objects, 2).collect()} == {("a", "s"), ("", "s"), (None, "s")}


def test_children_move_once_before_they_meet(make, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = H.flat_join(*_volumes(make, 2, 2, 2, 2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 20 and plan.count("REPARTITION_BY_COL") == 2


def test_filter_reaches_the_scan(spark, tmp_path, make):
    path = str(tmp_path / "apps")
    make.apps({"record_id": "a", "owner_login": "x"}).write.parquet(path)
    plan = filters.by_owner(spark.read.parquet(path), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and F is not None


def test_summary_moves_keys_alone(make):
    tables = _volumes(make, 2, 2, 2, 2)
    plan = counts.extraction_summary(H.flat_join(*tables), tables[2])._jdf.queryExecution().optimizedPlan().toString()
    dealt = [p for p in plan.split("RepartitionByExpression")[1:]]
    assert dealt and not any(c in p.split("LogicalRDD")[0] for p in dealt for c in ("field_type", "field_description", "retention_days"))
