from strataudit.operators import rules
from strataudit.sources import integrity, preflight, snapshots


def test_preflight(spark, tmp_path):
    good = str(tmp_path / "good")
    spark.range(3).write.parquet(good)
    names = spark.createDataFrame([(n,) for n in ("good", "good", "gone", "other", "1bad", "x", "a b", "drop;table", None)], "n string")
    got = {r.dataset: (r.accessible, r.error) for r in preflight.dataset_preflight(
        names, {"good": good, "gone": str(tmp_path / "gone"), "table": "no_such_table"}).collect()}
    assert got["good"] == (True, None)
    assert got["gone"] == (False, "Cannot access dataset gone: PATH_NOT_FOUND")
    assert got["other"] == (False, "Cannot access dataset other")
    assert all(got[n] == (False, f"Invalid dataset name format: {n or ''}") for n in ("1bad", "x", "a b", "drop;table", None))


def test_integrity(make):
    apps = make.apps({"record_id": "a", "processes_sensitive_data": "maybe"}, {"record_id": "a"}, {"record_id": None})
    stores = make.stores(("a", "s", "S", "t", "1"), ("ghost", "s", "S", "t", "1"))
    objects = make.objects(("a", "s", "o", "O", "1", "30"), ("a", "gone", "p", "P", "1", "soon"), ("a", None, "q", "Q", "1", ""))
    fields = make.fields(("a", "o", "f", "d", "t"), ("a", "none", "f", "d", "t"))
    got = {(r.table_name, r.check_name, r.key, r.row_count) for r in
           integrity.integrity_report(apps.drop("supervisor_login"), stores, objects, fields).collect()}
    assert got == {
        ("applications", "null_key", "/1/0", 1), ("applications", "duplicate_key", "a/1/0", 2),
        ("applications", "type_mismatch", "a/1/0", 1), ("applications", "missing_column", "supervisor_login", 0),
        ("data_stores", "dangling_parent", "ghost/s", 1), ("data_objects", "dangling_parent", "a/gone/p", 1),
        ("data_objects", "type_mismatch", "a/gone/p", 1), ("object_fields", "dangling_parent", "a/none/f", 1)}


def test_rules(make, spark):
    apps = make.apps({"record_id": "a", "app_description": " ", "processes_sensitive_data": "1"},
                     {"record_id": "b", "app_description": "x", "processes_sensitive_data": "1", "stores_sensitive_data": "0"})
    stores = make.stores(("a", "s", "S", "t", "1"), ("b", "e", "E", "t", "0"), ("b", "f", "F", "t", "no"), ("ghost", "g", "G", "t", "1"))
    objects = make.objects(("a", "s", "o", "O", "0", ""), ("b", "f", "p", "P", "1", "-3"), ("b", None, "q", "Q", "1", ""))
    fields = make.fields(("a", "o", "User_EMAIL", "d", "t"), ("b", "p", "home_address", "d", "t"))
    got = {(r.record_id, r.gate, r.rule, r.store_id, r.object_id) for r in rules.gate_checks(apps, stores, objects, fields).collect()}
    assert got == {
        ("a", 1, "missing_description", None, None), ("a", 1, "flags_not_set", None, None),
        ("b", 1, "store_without_objects", "e", None), ("b", 1, "object_without_fields", "__ORPHANED__", "q"),
        ("a", 1, "missing_retention", "s", "o"), ("a", 3, "unflagged_object", "s", "o"), ("b", 3, "unflagged_store", "f", "p"),
        ("b", 4, "unreasonable_retention", "f", "p"), ("b", 4, "sensitive_without_retention", "__ORPHANED__", "q")}
    seen = spark.createDataFrame([("a", "s", False), ("a", "s", False), ("b", "e", False), ("b", "new", True)],
                                 "application_name string, store_id string, detected_sensitive boolean")
    got = {(r.application_name, r.store_id, r.issue) for r in rules.crossref(stores, seen).collect()}
    assert got == {("a", "s", "contradicted"), ("b", "new", "missing_store")}


def test_json_documents(spark):
    good = '{"record_id": "a", "description": "x", "owner": null, "data_stores": [{"store_id": "s", "data_objects": []}]}'
    rows = [("a", good), ("b", '{"record_id": "b", '), ("c", "no json"), ("d", ""), ("e", None)]
    got = {r.record_id: r for r in snapshots.read_json_documents(spark.createDataFrame(rows, "record_id string, body string")).collect()}
    assert got["a"].error is None and got["a"].doc.description == "x" and got["a"].doc.data_stores[0].store_id == "s"
    assert all((got[k].doc, got[k].error) == (None, body) for k, body in rows[1:])
