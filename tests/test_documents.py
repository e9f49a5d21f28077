import datetime as dt
import json
import re

from pyspark.sql import functions as F

from strataudit import schemas as S
from strataudit.functions.json_text import json_dumps
from strataudit.operators import cache, hierarchy, prompts
from strataudit.operators.nesting import nest
from strataudit.sources import snapshots

NOW = dt.datetime(2024, 3, 1)


def _tables(make):
    text = "é ࠀ \U0001f600 \x7f \"q\" \\ / \n\t\x01"
    apps = make.apps({"record_id": "a", "app_description": text, "ownership": "{owner_login=é}", "processes_sensitive_data": "1"},
                     {"record_id": "b", "ownership": "bob"}, {"record_id": None}, {"record_id": ""})
    stores = make.stores(("a", "s1", "S1", "t", "1"), ("a", "s2", None, "t", "0"), ("nobody", "s1", "S", "t", "1"))
    objects = make.objects(*[("a", "s1", f"o{i:02}", f"é{i}", "true", "3") for i in range(9)],
                           ("a", "s1", "o00", "zz", "false", "4"), ("a", None, "z1", "Z", "1", None, "W"),
                           ("a", "", "z0", "Z", "1", "", "V"), ("a", "gone", "q", "Q", "1", ""), ("a", "s2", None, "n", "1", ""),
                           ("b", None, "lone", "L", "1", "", None))
    fields = make.fields(*[("a", f"o{i % 9:02}", f"f{i}", "d", None) for i in range(20)], ("a", "o01", "", "d", "t"),
                         ("a", "o01", None, "d", "t"), ("a", "o00", "f0", "aaa", "t"),
                         *[("a", "o02", f"wide{i}", None, "t") for i in range(40)], ("a", "z0", "zf", "d", "t"))
    return apps, stores, objects, fields


def _merged(rows):
    """Parts of one record put together: what one whole document should look like."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.record_id, r.part)):
        d = r.doc.asDict(recursive=True)
        doc = out.setdefault(r.record_id, {**d, "data_stores": {}})
        for s in d["data_stores"]:
            store = doc["data_stores"].setdefault(s["store_id"], {**s, "data_objects": {}})
            for o in s["data_objects"]:
                obj = store["data_objects"].setdefault(o["object_id"], {**o, "fields": {}})
                for f in o["fields"]:
                    assert f["field_name"] not in obj["fields"]
                    obj["fields"][f["field_name"]] = f
    for doc in out.values():
        for s in doc["data_stores"].values():
            for o in s["data_objects"].values():
                o["fields"] = [o["fields"][k] for k in sorted(o["fields"])]
            s["data_objects"] = [s["data_objects"][k] for k in sorted(s["data_objects"])]
        doc["data_stores"] = [doc["data_stores"][k] for k in sorted(doc["data_stores"], key=lambda k: (k == S.ORPHAN_STORE, k))]
    return out


def test_documents(make):
    docs = {r.record_id: r.doc.asDict(recursive=True) for r in nest(*_tables(make)).collect()}
    assert set(docs) == {"a", "b"}
    a = docs["a"]
    assert a["owner"] == "é" and a["processes_sensitive_data"] is True and a["stores_sensitive_data"] is False
    assert [s["store_id"] for s in a["data_stores"]] == ["s1", "s2", S.ORPHAN_STORE]
    lost = a["data_stores"][2]
    assert (lost["technology"], lost["has_sensitive_data"]) == ("V", False)
    assert [o["object_id"] for o in lost["data_objects"]] == ["z0", "z1"]
    assert a["data_stores"][1]["data_objects"] == [] and a["data_stores"][1]["store_name"] is None
    first = a["data_stores"][0]["data_objects"][0]
    assert (first["object_name"], first["retention_days"]) == ("zz", "4")
    assert first["fields"][0] == {"field_name": "f0", "field_description": "aaa", "field_type": "t"}
    assert docs["b"]["owner"] == "bob" and docs["b"]["data_stores"][0]["store_id"] == S.ORPHAN_STORE


def test_parts_hold_the_whole_record_and_stay_small(make):
    whole = _merged(nest(*_tables(make)).collect())
    for limit in (4, 15, 30):
        rows = nest(*_tables(make), part_leaves=limit).collect()
        assert _merged(rows) == whole
        parts = [r for r in rows if r.record_id == "a"]
        assert sorted(r.part for r in parts) == list(range(parts[0].n_parts)) and len(parts) > 1
        for r in parts:
            leaves = sum(len(o.fields) for s in r.doc.data_stores for o in s.data_objects)
            assert leaves < 4 * limit + 8


def test_sizes_equal_json_dumps(make):
    docs = nest(*_tables(make))
    want = {r.record_id: len(json.dumps(r.doc.asDict(recursive=True))) for r in docs.collect()}
    assert {r.record_id: r.bytes for r in cache.with_size(docs).collect()} == want
    for limit in (4, 15):
        sized = cache.with_size(nest(*_tables(make), part_leaves=limit)).collect()
        assert {r.record_id: r.bytes for r in sized} == want


def test_json_text_equals_json_dumps(make):
    docs = nest(*_tables(make))
    got = docs.select("doc", json_dumps("doc", S.DOCUMENT).alias("c"), json_dumps("doc", S.DOCUMENT, 2).alias("p")).collect()
    for r in got:
        doc = r.doc.asDict(recursive=True)
        assert r.c == json.dumps(doc) and r.p == json.dumps(doc, indent=2)


def test_overflow_is_strictly_above_the_limit(make):
    empty = len(json.dumps({"record_id": "x", "description": "", "owner": "", "processes_sensitive_data": False,
                            "stores_sensitive_data": False, "data_stores": []}))
    apps = make.apps(*[{"record_id": str(i), "app_description": "d" * (S.OVERFLOW_BYTES - empty + i)} for i in (0, 1)])
    rows = cache.split_overflow(cache.with_size(nest(apps, make.stores(), make.objects(), make.fields())), NOW)
    got = {r.record_id: (r.bytes, r.is_overflow, r.overflow_key) for r in rows.collect()}
    assert got == {"0": (400_000, False, None), "1": (400_001, True, "cache/1.json")}


def test_snapshot_upsert_and_failed_load(make, spark, tmp_path):
    root = str(tmp_path / "cache")

    def load(*names, description="old"):
        apps = make.apps(*[{"record_id": n, "app_description": description} for n in names])
        return cache.split_overflow(cache.with_size(nest(apps, make.stores(), make.objects(), make.fields())), NOW, 150)

    snapshots.write_version(load("a", "b"), root, NOW)
    old = snapshots.read_current(spark, root)
    snapshots.write_version(cache.upsert(old, load("b", "c", description="new" * 30)), root, NOW)
    state = lambda: {r.record_id: (r.description, r.is_overflow) for r in snapshots.read_current(spark, root)
                     .select("record_id", "doc.description", "is_overflow").collect()}
    want = {"a": ("old", False), "b": ("new" * 30, True), "c": ("new" * 30, True)}
    assert state() == want
    broken = load("d").withColumn("bytes", F.raise_error(F.lit("lost")).cast("long"))
    try:
        snapshots.write_version(broken, root, NOW)
        raise AssertionError("the load should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert state() == want and snapshots.current_version(spark, root) == 2
    snapshots.write_version(load("d"), root, NOW)
    assert set(state()) == {"d"}


def test_search_takes_wildcards_literally(spark):
    rows = spark.createDataFrame([("My_App%1",), ("MyXApp",), ("other",)], "record_id string")
    found = lambda term: sorted(r.record_id for r in cache.search(rows, term).collect())
    assert found("y_a") == ["My_App%1"] and found("%") == ["My_App%1"] and found("APP") == ["MyXApp", "My_App%1"]
    terms = ["y_a", "APP", "zzz", "%1", "Other", "", None, "otherer"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert sorted(r.piece for r in cache.terms_found(df, rows).collect()) == ["%1", "app", "other", "y_a"]


def test_prompts(make, spark):
    docs = nest(make.apps({"record_id": "a"}, {"record_id": "b"}), make.stores(), make.objects(), make.fields())
    prior = spark.createDataFrame([("a", "aged", 1), ("a", "later", 2), ("a", "earlier", 2), ("b", "", 1)], "record_id string, content string, version int")
    data = {r.record_id: json.dumps(r.doc.asDict(True), indent=2) for r in docs.collect()}
    got = {r.record_id: r for r in prompts.prompts(docs, "T", prior, True).collect()}
    block = "T\n\n--- ATTESTATION DATA ---\n%s\n--- END ATTESTATION DATA ---\n"
    only = "\nIMPORTANT: Output ONLY the actionable checklist. Do NOT include the full gate-by-gate review.\n"
    earlier = ("\n--- PRIOR REVIEW ---\nearlier\n--- END PRIOR REVIEW ---\n"
               "Compare this attestation against the prior review and highlight what changed.\n")
    assert got["a"].prompt == block % data["a"] + earlier + only
    assert got["b"].prompt == block % data["b"] + only
    assert got["a"].prompt_bytes == len(got["a"].prompt.encode())
    tool = prompts.prompts(docs, "T", prior, False, "tool").filter("record_id = 'a'").first().prompt
    assert tool == block % data["a"] + "\n" + earlier.replace("Compare this attestation against", "Compare against")


def test_prompt_of_a_record_in_many_parts_is_one(make, spark):
    tables = _tables(make)
    prior = spark.createDataFrame([("a", "earlier"), ("b", "")], "record_id string, content string")
    whole = {r.record_id: r.prompt for r in prompts.prompts(nest(*tables), "T", prior, True, "tool").collect()}
    for leaves in (3, 50_000):
        docs = nest(*tables, part_leaves=leaves)
        assert leaves > 3 or docs.filter("n_parts > 1").count()
        found = prompts.prompt_pieces(docs, "T", prior, True, "tool").orderBy("record_id", "piece").collect()
        assert {k: "".join(r.text for r in found if r.record_id == k) for k in whole} == whole
        assert len({(r.record_id, r.piece) for r in found}) == len(found) and {r.record_id for r in found} == set(whole)
    assert prompts.prompt_pieces(docs.filter("false"), "T").count() == 0


def test_fields_are_not_moved_to_their_store(make, spark):
    """Fields are dealt to their object and then to their part, whatever lies between."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = nest(make.apps({"record_id": "a"}), make.stores(("a", "s", "n", "t", "1")), make.objects(("a", "s", "o", "n", "1", "", "")),
                    make.fields(("a", "o", "f", "d", "t")))
        plan = docs._jdf.queryExecution().optimizedPlan()
        at_store = [str(plan.apply(k)) for k in range(200) if plan.apply(k) is not None
                    and plan.apply(k).nodeName() == "Join" and "store_id" in plan.apply(k).condition().toString()]
        assert at_store and not any("collect_list" in text for text in at_store)  # the fields of an object
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_dealt_finely_give_the_same_documents(make):
    tables = _tables(make)
    in_text = lambda df: sorted(df.select("record_id", "part", "n_parts", "reviewer_group", F.to_json("doc", {"ignoreNullFields": "false"})).collect())
    for limit in (4, 50_000):
        alone = in_text(nest(*tables, part_leaves=limit))
        assert len(alone) == 2 if limit > 4 else len(alone) > 5
        for large in (0, 3):  # b has two child rows, a has many
            assert in_text(nest(*tables, part_leaves=limit, large_rows=large)) == alone


def test_children_of_most_records_move_once(make, spark):
    tables = _tables(make)
    found = lambda rows: {r.large_id for r in hierarchy.large_records(*tables[1:], rows).collect()}
    assert found(3) == {"a"} and found(50_000) == set()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = {}
        for large in (3, 50_000):
            docs = nest(*tables, large_rows=large)
            docs.collect()
            final = docs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            keys[large] = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", final)
        by_object = lambda large: [k for k in keys[large] if "object_id" in k or "store_id" in k or "part#" in k]
        assert by_object(3) and keys[50_000] and not by_object(50_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
