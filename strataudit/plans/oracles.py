"""The same results as SQL over the test tables, for checking. Nothing here is used by the operators."""

from __future__ import annotations

from strataudit.operators import reviews as R
from strataudit.operators.rules import SENSITIVE_WORDS
from strataudit.plans.inputs import sql_views
from strataudit.plans.queries import (
    DELIVERIES, LARGE_STORE_LIMIT, LATENESS, LOGINS, OUTLIER_LIMIT, OVERFLOW_LIMIT, RECORD, SEARCH_TERM, TEMPLATE,
)
from strataudit.operators.prompts import CHECKLIST_ONLY, COMPARE, DATA_CLOSE, DATA_OPEN, PRIOR_CLOSE, PRIOR_OPEN
from strataudit.schemas import LOGIN_COLUMNS

ORPHAN = "'__ORPHANED__'"
APP_COLUMNS = (["record_id", "snapshot_date", "snapshot_hour", "app_description", "ownership", "owner_login",
                "supervisor_login"] + [f"reports_to_level_{i}_login" for i in range(1, 7)]
               + ["processes_sensitive_data", "stores_sensitive_data", "app_legal_reviewer_group"])


def _order(columns: list[str]) -> str:
    return ", ".join(f"{c} NULLS FIRST" for c in columns)


def _app(source: str = "fx_apps", name: str = "app") -> str:
    return (f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY "
            f"snapshot_date DESC, snapshot_hour DESC, {_order(APP_COLUMNS[3:])}) = 1)")


CHILDREN = f"""
st AS (SELECT * FROM fx_stores QUALIFY row_number() OVER (PARTITION BY application_name, store_id
       ORDER BY {_order(['store_name', 'technology', 'has_sensitive_data'])}) = 1),
keyed AS (SELECT * REPLACE (CASE WHEN coalesce(data_store_id, '') = '' THEN {ORPHAN} ELSE data_store_id END
          AS data_store_id) FROM fx_objects WHERE application_name <> ''),
ob AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY application_name, data_store_id, object_id
       ORDER BY {_order(['object_name', 'has_sensitive_data', 'retention_days', 'technology'])}) = 1),
fi AS (SELECT * FROM fx_fields QUALIFY row_number() OVER (PARTITION BY application_name, object_id, field_name
       ORDER BY {_order(['field_description', 'field_type'])}) = 1)"""

FLAT = f"""
par AS (SELECT application_name, store_id, store_name, technology, has_sensitive_data FROM st UNION ALL
        SELECT DISTINCT application_name, {ORPHAN}, {ORPHAN}, NULL, NULL FROM keyed WHERE data_store_id = {ORPHAN}),
flat AS (SELECT app.*, p.store_name AS data_store_name, p.store_id AS data_store_id,
                CASE WHEN p.store_id = {ORPHAN} THEN o.technology ELSE p.technology END AS store_technology,
                p.has_sensitive_data AS store_has_sensitive_data, o.object_name AS data_object_name, o.object_id,
                o.has_sensitive_data AS object_has_sensitive_data, o.retention_days,
                f.field_name, f.field_description, f.field_type
         FROM app LEFT JOIN par p ON app.record_id = p.application_name
         LEFT JOIN ob o ON p.application_name = o.application_name AND p.store_id = o.data_store_id
         LEFT JOIN fi f ON o.application_name = f.application_name AND o.object_id = f.object_id)"""

FOUR = ("apps", "stores", "objects", "fields")


def _bool(c: str) -> str:
    return f"coalesce(lower(trim({c})) IN ('true', '1', 'yes'), false)"


def _owner(c: str) -> str:
    return f"CASE WHEN {c} LIKE '{{%' THEN regexp_extract({c}, 'owner_login=([^,}}]*)', 1) ELSE {c} END"


def _base(*extra: str, views: tuple[str, ...] = FOUR) -> str:
    return ",\n".join([sql_views(*views), *extra]) + "\n"


STORES = f"""
sto AS (SELECT application_name, store_id, store_name, technology, {_bool('has_sensitive_data')} AS flag FROM st
        WHERE store_id <> '' UNION ALL
        SELECT application_name, {ORPHAN}, {ORPHAN},
               arg_min(technology, {{'a': object_id, 'b': object_name, 'c': has_sensitive_data, 'd': retention_days}}),
               false
        FROM ob WHERE data_store_id = {ORPHAN} GROUP BY application_name)"""


def _documents() -> str:
    """Documents as nested values; ``doc`` is their JSON text."""
    return f"""{STORES},
fo AS (SELECT application_name, object_id, list({{'field_name': field_name, 'field_description': field_description,
              'field_type': field_type}} ORDER BY field_name) AS fields
       FROM fi WHERE field_name <> '' GROUP BY application_name, object_id),
oo AS (SELECT o.application_name, o.data_store_id, list({{'object_name': o.object_name, 'object_id': o.object_id,
              'has_sensitive_data': {_bool('o.has_sensitive_data')}, 'retention_days': o.retention_days,
              'fields': coalesce(fo.fields, [])}} ORDER BY o.object_id) AS data_objects
       FROM ob o LEFT JOIN fo ON o.application_name = fo.application_name AND o.object_id = fo.object_id
       GROUP BY o.application_name, o.data_store_id),
so AS (SELECT s.application_name, list({{'store_name': s.store_name, 'store_id': s.store_id,
              'technology': s.technology, 'has_sensitive_data': s.flag, 'data_objects': coalesce(oo.data_objects, [])}}
              ORDER BY s.store_id = {ORPHAN}, s.store_id) AS data_stores
       FROM sto s LEFT JOIN oo ON s.application_name = oo.application_name AND s.store_id = oo.data_store_id
       GROUP BY s.application_name),
docs AS (SELECT record_id, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS n_parts,
                app_legal_reviewer_group AS reviewer_group,
                CAST(to_json({{'record_id': record_id, 'description': app_description, 'owner': {_owner('ownership')},
                 'processes_sensitive_data': {_bool('processes_sensitive_data')},
                 'stores_sensitive_data': {_bool('stores_sensitive_data')},
                 'data_stores': coalesce(data_stores, [])}}) AS VARCHAR) AS doc
         FROM app LEFT JOIN so ON record_id = application_name)"""


def _dumps(indent: int | None, app: str = "app", name: str = "texts") -> str:
    """Documents as the text that json.dumps writes: columns record_id and doc_text."""
    pad = lambda n: "" if indent is None else "\n" + " " * (indent * n)
    comma = ", " if indent is None else ","
    text = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE replace(CAST(to_json({c}) AS VARCHAR), '–', '\\u2013') END"
    flag = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"

    def obj(level: int, **members: str) -> str:
        out = []
        for i, (key, value) in enumerate(members.items()):
            out += [f"'{'{' if i == 0 else comma}{pad(level + 1)}\"{key}\": '", value]
        return f"concat({', '.join(out)}, '{pad(level)}}}')"

    def arr(level: int, item: str, order: str) -> str:
        return f"concat('[{pad(level + 1)}', string_agg({item}, '{comma}{pad(level + 1)}' ORDER BY {order}), '{pad(level)}]')"

    field = obj(6, field_name=text("field_name"), field_description=text("field_description"),
                field_type=text("field_type"))
    object_ = obj(4, object_name=text("o.object_name"), object_id=text("o.object_id"),
                  has_sensitive_data=flag(_bool("o.has_sensitive_data")), retention_days=text("o.retention_days"),
                  fields="coalesce(t.body, '[]')")
    store = obj(2, store_name=text("s.store_name"), store_id=text("s.store_id"), technology=text("s.technology"),
                has_sensitive_data=flag("s.flag"), data_objects="coalesce(t.body, '[]')")
    record = obj(0, record_id=text("record_id"), description=text("app_description"), owner=text(_owner("ownership")),
                 processes_sensitive_data=flag(_bool("processes_sensitive_data")),
                 stores_sensitive_data=flag(_bool("stores_sensitive_data")), data_stores="coalesce(t.body, '[]')")
    both = "o.application_name = t.application_name AND o.object_id = t.object_id"
    return f"""{STORES if name == 'texts' else 'sto_' + name + ' AS (SELECT * FROM sto)'},
tf_{name} AS (SELECT application_name, object_id, {arr(5, field, 'field_name')} AS body FROM fi WHERE field_name <> ''
       GROUP BY application_name, object_id),
to_{name} AS (SELECT o.application_name, o.data_store_id, {arr(3, object_, 'o.object_id')} AS body
       FROM ob o LEFT JOIN tf_{name} t ON {both} GROUP BY o.application_name, o.data_store_id),
ts_{name} AS (SELECT s.application_name, {arr(1, store, f's.store_id = {ORPHAN}, s.store_id')} AS body
       FROM sto s LEFT JOIN to_{name} t ON s.application_name = t.application_name AND s.store_id = t.data_store_id
       GROUP BY s.application_name),
{name} AS (SELECT record_id, app_description, {record} AS doc_text FROM {app} LEFT JOIN ts_{name} t
       ON record_id = t.application_name)"""


SIZES = "sized AS (SELECT record_id, CAST(strlen(doc_text) AS BIGINT) AS bytes FROM texts)"
OVER = f"bytes > {OVERFLOW_LIMIT}"


def _owned(alias: str = "") -> str:
    logins = ", ".join(f"'{x}'" for x in LOGINS)
    return "(" + " OR ".join(f"{alias}{c} IN ({logins})" for c in LOGIN_COLUMNS) + ")"


# Requests and usage

OUTCOMES = """
keys AS (SELECT DISTINCT record_id AS k FROM fx_apps),
outcome AS (SELECT l.*, CAST(CASE WHEN trim(coalesce(record_id, '')) = '' THEN 400
    WHEN NOT is_partial AND x_source IN ('cli', 'mcp') AND coalesce(x_tool_version, '') = '' THEN 426
    WHEN NOT CASE WHEN is_partial
             THEN EXISTS (SELECT 1 FROM keys WHERE contains(lower(k), lower(trim(l.record_id))))
             ELSE trim(record_id) IN (SELECT k FROM keys) END THEN 404
    ELSE 200 END AS INTEGER) AS status FROM fx_lookups l)"""
HITS = _app() + f""",{OUTCOMES},
hits AS (SELECT o.*, app.app_legal_reviewer_group AS legal_reviewer_group FROM outcome o JOIN app USING (record_id)
         WHERE status = 200 AND NOT is_partial),
counters AS (SELECT record_id, count(*) AS hit_count, max(ts) AS last_hit,
       arg_max(legal_reviewer_group, {{'t': ts, 'e': event_id}}) AS legal_reviewer_group,
       arg_max(reviewer, {{'t': ts, 'e': event_id}}) FILTER (reviewer <> '') AS last_reviewer
       FROM hits GROUP BY record_id)"""
USED = ("apps", "lookups")


ELIGIBLE = """,
eligible AS (SELECT event_id FROM outcome WHERE NOT is_partial AND status IN (200, 404))"""


def _usage(select: str, more: str = "") -> str:
    return _base(HITS + (ELIGIBLE + more if more else ""), views=USED) + select


# Reviews

def _re(pattern: str, flags: str = "m") -> str:
    """A pattern for the SQL engine, where white space includes all Unicode kinds as well."""
    return "(?" + flags + ")" + pattern.replace("'", "''")


GATE = _re(R.GATE_HEADING)
HEADING = _re(R.TABLE_HEADING, "im")
INLINE = _re(R.TABLE_INLINE)
ACTION = _re(R.ACTION_ITEM, "im")
CHECK = _re(R.CHECKLIST_ITEM)
SEVERITY = _re(R.SEVERITY, "i")
QUOTES = "'`\"'''"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


SECTIONS = f"""
cutup AS (SELECT review_id, record_id, version, regexp_extract_all(content, '{GATE}', 1) AS gates,
                 string_split_regex(content, '{GATE}') AS pieces FROM fx_reviews),
numbered AS (SELECT review_id, record_id, version, CAST(unnest(gates) AS INTEGER) AS gate, unnest(pieces[2:]) AS section,
                    generate_subscripts(gates, 1) AS i FROM cutup),
secs AS (SELECT review_id, record_id, version, gate, section FROM numbered WHERE gate BETWEEN 1 AND 5
         QUALIFY row_number() OVER (PARTITION BY review_id, gate ORDER BY i DESC) = 1)"""

NOISE = ", ".join(f"'{w}'" for w in R.NOISE_WORDS)
TABLE_NAMES = f"""
heads AS (SELECT review_id, gate, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM
          (SELECT review_id, gate, regexp_extract_all(section, '{HEADING}', 1) AS l FROM secs)),
runs AS (SELECT review_id, gate, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM
         (SELECT review_id, gate, regexp_extract_all(section, '{INLINE}', 1) AS l FROM secs)),
names AS (SELECT review_id, gate, 0 AS o, i, trim({_strip('n')}, {QUOTES}) AS table_name FROM heads
          UNION ALL SELECT review_id, gate, 1, i, trim({_strip('n')}, {QUOTES}) FROM runs),
kept AS (SELECT * FROM names WHERE (o = 0 AND table_name <> '')
         OR (o = 1 AND length(table_name) > 2 AND lower(table_name) NOT IN ({NOISE}))),
firsts AS (SELECT review_id, gate, table_name, min(o * 1000000000 + i) AS pos FROM kept GROUP BY ALL),
tabs AS (SELECT review_id, gate, CAST(row_number() OVER (PARTITION BY review_id, gate ORDER BY pos) - 1 AS INTEGER)
                AS position, table_name FROM firsts)"""


def _matches(name: str, pattern: str, group: int, box: int | None) -> str:
    """Matches of a pattern in each section, with the last heading in the text before each."""
    boxes = f"regexp_extract_all(section, '{pattern}', {box})" if box else "NULL"
    return f"""
{name}_l AS (SELECT review_id, record_id, version, gate, regexp_extract_all(section, '{pattern}', {group}) AS lines,
        {boxes} AS boxes, regexp_extract_all(section, '{pattern}', 0) AS whole,
        string_split_regex(section, '{pattern}') AS gaps FROM secs),
{name}_u AS (SELECT review_id, record_id, version, gate, whole, gaps, unnest(lines) AS line,
        {'unnest(boxes)' if box else 'NULL'} AS box, generate_subscripts(lines, 1) AS i FROM {name}_l),
{name} AS (SELECT review_id, record_id, version, gate, {_strip('line')} AS line, box, i,
        coalesce(trim({_strip(f'''regexp_extract_all(array_to_string([gaps[k] || CASE WHEN k < i THEN whole[k] ELSE '' END
            for k in range(1, i + 1)], ''), '{HEADING}', 1)[-1]''')}, {QUOTES}), '') AS tab
        FROM {name}_u)"""


def _clean(x: str) -> str:
    return f"trim({_strip(f'''regexp_replace({x}, '{SEVERITY}', '', 'g')''')}, '- :')"


ITEMS = f"""{_matches('act', ACTION, 1, None)},{_matches('chk', CHECK, 2, 1)},
action AS (SELECT review_id, record_id, version, CAST(i - 1 AS INTEGER) AS position, gate,
        upper(regexp_extract(line, '{SEVERITY}', 1)) AS severity, {_clean('line')} AS description, tab AS "table" FROM act),
open_boxes AS (SELECT * FROM chk WHERE box = ' ' AND line <> ''),
checklist AS (SELECT review_id, record_id, version,
        CAST(row_number() OVER (PARTITION BY review_id, gate ORDER BY i) - 1 AS INTEGER) AS position, gate,
        upper(regexp_extract(line, '{SEVERITY}', 1)) AS severity,
        CASE WHEN regexp_matches(line, '{SEVERITY}') THEN {_clean('line')} ELSE line END AS description, tab AS "table"
        FROM open_boxes),
found AS (SELECT 0 AS kind, * FROM action UNION ALL SELECT 1, * FROM checklist)"""

TITLES = " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS gate_number, '{t}' AS title" for n, t in R.GATE_TITLES.items())


def _summary(where_item: str, where_table: str, where_gate: str) -> str:
    return _base(SECTIONS, TABLE_NAMES, ITEMS, f"titles AS ({TITLES})", views=("reviews",)) + f"""
SELECT r.review_id, r.record_id, r.version, t.gate_number, t.title,
       CAST(coalesce(i.n, 0) AS INTEGER) AS finding_count, coalesce(b.txt, '') AS tables, coalesce(i.txt, '') AS action_items
FROM fx_reviews r CROSS JOIN titles t
LEFT JOIN (SELECT review_id, gate, count(*) AS n,
           string_agg(concat_ws('|', severity, description, "table"), '; ' ORDER BY kind, position) AS txt
           FROM found WHERE {where_item} GROUP BY review_id, gate) i ON i.review_id = r.review_id AND i.gate = t.gate_number
LEFT JOIN (SELECT review_id, gate, string_agg(table_name, '; ' ORDER BY position) AS txt FROM tabs WHERE {where_table}
           GROUP BY review_id, gate) b ON b.review_id = r.review_id AND b.gate = t.gate_number
WHERE {where_gate}"""


def _per_review() -> str:
    return _base(SECTIONS, TABLE_NAMES, ITEMS, views=("reviews",)) + """
SELECT r.review_id, r.record_id, r.version, CASE WHEN trim(coalesce(r.content, '')) = '' THEN 'InvalidParams' END AS error,
       CAST(coalesce(i.n, 0) AS INTEGER) AS total_findings, coalesce(b.txt, '') AS affected_tables, coalesce(i.txt, '') AS action_items
FROM fx_reviews r
LEFT JOIN (SELECT review_id, count(*) AS n,
           string_agg(concat_ws('|', severity, description, "table"), '; ' ORDER BY gate, kind, position) AS txt
           FROM found WHERE gate BETWEEN 1 AND 5 GROUP BY review_id) i ON i.review_id = r.review_id
LEFT JOIN (SELECT review_id, string_agg(table_name, '; ' ORDER BY table_name) AS txt FROM
           (SELECT DISTINCT review_id, table_name FROM tabs WHERE gate BETWEEN 1 AND 5) GROUP BY review_id) b ON b.review_id = r.review_id"""


# Rules

def _rule(gate: int, rule: str, severity: str, body: str, store: str = "NULL", obj: str = "NULL", field: str = "NULL",
          record: str = "record_id") -> str:
    return (f"SELECT {record} AS record_id, CAST({gate} AS INTEGER) AS gate, '{rule}' AS rule, '{severity}' AS severity, "
            f"CAST({store} AS VARCHAR) AS store_id, CAST({obj} AS VARCHAR) AS object_id, "
            f"CAST({field} AS VARCHAR) AS field_name FROM {body}")


RULE_BASE = f"""
rs AS (SELECT application_name, store_id, {_bool('has_sensitive_data')} AS sflag FROM st
       WHERE application_name IN (SELECT record_id FROM app) AND store_id <> ''
       UNION ALL SELECT record_id, {ORPHAN}, false FROM app),
pl AS (SELECT o.application_name AS record_id, o.data_store_id AS store_id, o.object_id, s.sflag,
       {_bool('o.has_sensitive_data')} AS oflag, o.retention_days AS days,
       CASE WHEN regexp_matches(o.retention_days, '^[0-9]+$') THEN CAST(o.retention_days AS BIGINT) END AS n
       FROM ob o JOIN rs s ON o.application_name = s.application_name AND o.data_store_id = s.store_id),
hint AS (SELECT pl.*, f.field_name FROM pl JOIN fi f ON pl.record_id = f.application_name AND pl.object_id = f.object_id
         WHERE regexp_matches(lower(f.field_name), '{"|".join(SENSITIVE_WORDS)}'))"""
SO = dict(store="store_id", obj="object_id")
RULES = "\nUNION ALL ".join([
    _rule(1, "missing_description", "HIGH", "app WHERE trim(coalesce(app_description, '')) = ''"),
    _rule(1, "flags_not_set", "MEDIUM", "app WHERE trim(coalesce(processes_sensitive_data, '')) = '' "
          "OR trim(coalesce(stores_sensitive_data, '')) = ''"),
    _rule(1, "store_without_objects", "MEDIUM", f"rs WHERE store_id <> {ORPHAN} AND NOT EXISTS (SELECT 1 FROM ob o "
          "WHERE o.application_name = rs.application_name AND o.data_store_id = rs.store_id)",
          store="store_id", record="application_name"),
    _rule(1, "object_without_fields", "LOW", "pl WHERE NOT EXISTS (SELECT 1 FROM fi f WHERE f.application_name = "
          "pl.record_id AND f.object_id = pl.object_id AND f.field_name <> '')", **SO),
    _rule(1, "missing_retention", "HIGH", "pl WHERE sflag AND trim(coalesce(days, '')) = ''", **SO),
    _rule(3, "unflagged_object", "HIGH", "hint WHERE NOT oflag", field="field_name", **SO),
    _rule(3, "unflagged_store", "HIGH", f"hint WHERE NOT sflag AND store_id <> {ORPHAN}", field="field_name", **SO),
    _rule(4, "unreasonable_retention", "MEDIUM", "pl WHERE trim(coalesce(days, '')) <> '' AND coalesce(n <= 0, true)", **SO),
    _rule(4, "sensitive_without_retention", "HIGH", "pl WHERE oflag AND trim(coalesce(days, '')) = ''", **SO),
])


# Integrity

def _check(table: str, check: str, keys: list[str], where: str, having: str = "") -> str:
    key = ", ".join(f"coalesce({k}, '')" for k in keys)
    return (f"SELECT '{table}' AS table_name, '{check}' AS check_name, concat_ws('/', {key}) AS key, "
            f"count(*) AS row_count FROM {where} GROUP BY {', '.join(keys)} {having}")


AK, SK = ["record_id", "snapshot_date", "snapshot_hour"], ["application_name", "store_id"]
OK, FK = ["application_name", "data_store_id", "object_id"], ["application_name", "object_id", "field_name"]
WORDS = "('', 'true', 'false', '1', '0', 'yes', 'no', 'null', 'none')"


def _null(keys: list[str]) -> str:
    return " OR ".join(f"coalesce({k}, '') = ''" for k in keys)


def _odd(c: str) -> str:
    return f"lower(trim(coalesce({c}, ''))) NOT IN {WORDS}"


INTEGRITY = "\nUNION ALL ".join([
    *[_check(t, "null_key", k, f"{v} WHERE {_null(r)}") for t, v, k, r in (
        ("applications", "fx_apps", AK, ["record_id"]), ("data_stores", "fx_stores", SK, SK),
        ("data_objects", "fx_objects", OK, ["application_name", "object_id"]), ("object_fields", "fx_fields", FK, FK))],
    *[_check(t, "duplicate_key", k, v, "HAVING count(*) > 1") for t, v, k in (
        ("applications", "fx_apps", AK), ("data_stores", "fx_stores", SK),
        ("data_objects", "fx_objects", OK), ("object_fields", "fx_fields", FK))],
    _check("applications", "type_mismatch", AK, f"fx_apps WHERE {_odd('processes_sensitive_data')} OR {_odd('stores_sensitive_data')}"),
    _check("data_stores", "type_mismatch", SK, f"fx_stores WHERE {_odd('has_sensitive_data')}"),
    _check("data_objects", "type_mismatch", OK, f"fx_objects WHERE {_odd('has_sensitive_data')}"),
    _check("data_objects", "type_mismatch", OK,
           "fx_objects WHERE coalesce(retention_days, '') <> '' AND try_cast(retention_days AS INTEGER) IS NULL"),
    _check("data_stores", "dangling_parent", SK,
           "fx_stores s WHERE NOT EXISTS (SELECT 1 FROM fx_apps a WHERE a.record_id = s.application_name)"),
    _check("data_objects", "dangling_parent", OK, "fx_objects o WHERE coalesce(data_store_id, '') <> '' AND NOT EXISTS "
           "(SELECT 1 FROM fx_stores s WHERE s.application_name = o.application_name AND s.store_id = o.data_store_id)"),
    _check("object_fields", "dangling_parent", FK, "fx_fields f WHERE NOT EXISTS (SELECT 1 FROM fx_objects o "
           "WHERE o.application_name = f.application_name AND o.object_id = f.object_id)"),
])


def _semver(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '^[0-9]+\\.[0-9]+\\.[0-9]+$') "
            f"THEN [CAST(x AS INTEGER) for x in string_split({c}, '.')] END")


def _compare(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {_semver(a)} < {_semver(b)} THEN -1 WHEN {_semver(a)} > {_semver(b)} THEN 1 ELSE 0 END AS INTEGER)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    chain = _base(_app(), CHILDREN.strip("\n"), FLAT)
    docs = _base(_app(), CHILDREN, _documents())
    texts = _base(_app(), CHILDREN, _dumps(None), SIZES)
    apps_only = _base(views=("apps",))
    sections = _base(SECTIONS, views=("reviews",))
    items = _base(SECTIONS, ITEMS, views=("reviews",))
    doc_columns = "record_id, part, n_parts, doc"
    all_children = "ORDER BY app.snapshot_date DESC, app.snapshot_hour DESC, " + _order(
        [f"app.{c}" for c in APP_COLUMNS[3:]] + ["ds.store_name", "ds.technology", "ds.has_sensitive_data", "ob.object_name",
         "ob.has_sensitive_data", "ob.retention_days", "ob.technology", "f.field_description", "f.field_type"])
    asked = "(SELECT record_id FROM fx_lookups)"
    first, second = "first_load", "second_load"
    made_prompts = _base(_app(), CHILDREN, _dumps(2), f"""made AS (SELECT t.record_id, concat({_literal(
            TEMPLATE + chr(10) * 2 + DATA_OPEN)}, doc_text, {_literal(DATA_CLOSE)}, CASE WHEN coalesce(p.content, '') = '' THEN ''
            ELSE concat({_literal(chr(10) + PRIOR_OPEN)}, p.content, {_literal(PRIOR_CLOSE + COMPARE['command'])}) END,
            {_literal(chr(10) + CHECKLIST_ONLY)}) AS prompt FROM texts t LEFT JOIN fx_prior p USING (record_id))""",
                            views=(*FOUR, "prior"))
    return {
        "hierarchy_join_with_orphans": chain + "SELECT * FROM flat",
        "hierarchy_left_join": _base(f"""deduped AS (
    SELECT app.*, ds.store_name AS data_store_name, ds.store_id AS data_store_id, ds.technology AS store_technology,
           ds.has_sensitive_data AS store_has_sensitive_data, ob.object_name AS data_object_name, ob.object_id,
           ob.has_sensitive_data AS object_has_sensitive_data, ob.retention_days, f.field_name, f.field_description,
           f.field_type, row_number() OVER (PARTITION BY app.record_id, ds.store_id, ob.object_id, f.field_name
           {all_children}) AS rn
    FROM fx_apps app LEFT JOIN fx_stores ds ON app.record_id = ds.application_name
    LEFT JOIN fx_objects ob ON ds.store_id = ob.data_store_id AND ds.application_name = ob.application_name
    LEFT JOIN fx_fields f ON ob.object_id = f.object_id AND ob.application_name = f.application_name)""")
        + "SELECT * EXCLUDE (rn) FROM deduped WHERE rn = 1",
        "latest_snapshot": _base(_app(), views=("apps",)) + "SELECT * FROM app",
        "records_without_stores": chain + f"""SELECT * FROM app WHERE record_id NOT IN
            (SELECT application_name FROM par)""",
        "hierarchy_row_counts": chain + """SELECT record_id, count(*) AS flat_rows, count(object_id) AS object_rows,
            count(field_name) AS field_rows FROM flat GROUP BY record_id""",
        "owner_extract_join": _base(_app(f"(SELECT * FROM fx_apps WHERE {_owned()})"), CHILDREN, FLAT) + "SELECT * FROM flat",
        "filter_records": _base(views=("apps", "lookups")) + f"SELECT * FROM fx_apps WHERE record_id IN {asked}",
        "filter_owner_hierarchy": apps_only + f"SELECT * FROM fx_apps WHERE {_owned()}",
        "filter_owner_table": apps_only + """SELECT * FROM fx_apps a WHERE EXISTS (SELECT 1 FROM fx_apps l WHERE
            l.stores_sensitive_data = 'yes' AND l.reports_to_level_1_login IN (""" + ", ".join(
            f"a.{c}" for c in LOGIN_COLUMNS) + "))",
        "filter_records_and_owner": _base(views=("apps", "lookups"))
        + f"SELECT * FROM fx_apps WHERE record_id IN {asked} AND {_owned()}",
        "distinct_record_ids": apps_only + f"SELECT DISTINCT record_id FROM fx_apps WHERE {_owned()} ORDER BY record_id",
        "filter_children": _base(views=("apps", "objects")) + f"""SELECT * FROM fx_objects WHERE application_name IN
            (SELECT record_id FROM fx_apps WHERE {_owned()})""",
        "objects_of_store": _base(views=("objects", "fields", "external")) + """
            SELECT o.*, f.field_name, f.field_description, f.field_type FROM fx_objects o LEFT JOIN fx_fields f
            ON o.application_name = f.application_name AND o.object_id = f.object_id
            WHERE (o.application_name, o.data_store_id) IN (SELECT application_name, store_id FROM fx_external)""",
        "object_counts": _base(views=("objects",))
        + "SELECT application_name, count(*) AS object_count FROM fx_objects GROUP BY application_name",
        "outlier_records": _base(views=("objects",)) + f"""SELECT application_name, count(*) AS object_count FROM fx_objects
            GROUP BY application_name HAVING count(*) > {OUTLIER_LIMIT}""",
        "large_stores": _base(views=("objects",)) + f"""SELECT application_name, data_store_id, count(*) AS object_count
            FROM fx_objects WHERE data_store_id <> '' GROUP BY application_name, data_store_id
            HAVING count(*) > {LARGE_STORE_LIMIT}""",
        "extraction_summary": chain + f"""SELECT count(*) AS flat_rows, count(DISTINCT record_id) AS records,
            count(DISTINCT (record_id, data_store_id)) FILTER (data_store_id <> {ORPHAN}) AS stores,
            count(DISTINCT (record_id, data_store_id, object_id)) FILTER (object_id IS NOT NULL) AS objects,
            count(DISTINCT (record_id, object_id)) FILTER (data_store_id = {ORPHAN}) AS orphans,
            count(field_name) AS fields,
            round(count(DISTINCT (record_id, data_store_id, object_id)) FILTER (object_id IS NOT NULL) /
                  (SELECT count(*) FROM ob), 6) AS join_success_rate FROM flat""",
        "nest_records": docs + "SELECT record_id, part, n_parts, reviewer_group, doc FROM docs",
        "nest_large_records": chain + """SELECT DISTINCT record_id, data_store_id AS store_id, object_id,
            CASE WHEN field_name <> '' THEN field_name END AS field_name FROM flat
            WHERE object_id IS NOT NULL AND (field_name <> '' OR NOT EXISTS (SELECT 1 FROM fi WHERE fi.field_name <> ''
                AND fi.application_name = flat.record_id AND fi.object_id = flat.object_id))""",
        "normalise_booleans": apps_only + f"""SELECT record_id, snapshot_date, processes_sensitive_data,
            {_bool('processes_sensitive_data')} AS processes, {_bool('stores_sensitive_data')} AS stores FROM fx_apps""",
        "struct_text_pairs": _base(_app(), """p AS (SELECT record_id, ownership,
                regexp_extract(ownership, 'tags=\\[([^,]*)', 1) AS tag FROM app WHERE ownership LIKE '{%')""", views=("apps",))
        + "\nUNION ALL ".join([
            *[f"SELECT record_id, '{path}' AS path, regexp_extract(ownership, '[{{ ]{name}=([^,}}]*)', 1) AS value FROM p"
              for path, name in (("owner_login", "owner_login"), ("supervisor_login", "supervisor_login"))],
            *[f"SELECT record_id, 'metadata.{n}', regexp_extract(ownership, '{n}=([^,}}]*)', 1) FROM p" for n in ("team", "level")],
            "SELECT record_id, 'tags[0]', tag FROM p", "SELECT record_id, 'tags[1]', 'a' FROM p",
            "SELECT record_id, 'tags[2]', NULL FROM p"]),
        "owner_extract": apps_only + f"SELECT record_id, snapshot_date, {_owner('ownership')} AS owner FROM fx_apps",
        "record_sizes": texts + "SELECT record_id, bytes FROM sized",
        "record_sizes_in_parts": texts + "SELECT record_id, bytes FROM sized",
        "overflow_split": texts + f"""SELECT record_id, bytes, {OVER} AS is_overflow,
            CASE WHEN {OVER} THEN concat('cache/', record_id, '.json') END AS overflow_key FROM sized""",
        "dry_run_report": texts + f"SELECT record_id, bytes, {OVER} AS is_overflow FROM sized ORDER BY record_id",
        "cache_upsert": _base(_app("(SELECT * FROM fx_apps WHERE snapshot_date = '2024-01-01')", first),
                              _app("(SELECT * FROM fx_apps WHERE snapshot_date = '2024-01-02')", second),
                              CHILDREN, _dumps(None, first), _dumps(None, second, "texts2"),
                              """merged AS (SELECT *, TIMESTAMP '2024-03-02 00:00:00' AS last_updated FROM texts2 UNION ALL
            SELECT *, TIMESTAMP '2024-03-01 00:00:00' FROM texts WHERE record_id NOT IN (SELECT record_id FROM texts2))""")
        + f"""SELECT record_id, app_description AS description, CAST(strlen(doc_text) AS BIGINT) AS bytes,
            strlen(doc_text) > {OVERFLOW_LIMIT} AS is_overflow, last_updated FROM merged""",
        "cache_loads_at_once": _base(_app("(SELECT * FROM fx_apps WHERE snapshot_date = '2024-01-01')", first),
                              _app("(SELECT * FROM fx_apps WHERE snapshot_date = '2024-01-02')", second),
                              CHILDREN, _dumps(None, first), _dumps(None, second, "texts2"),
                              f"""merged AS (SELECT *, TIMESTAMP '2024-03-02 00:00:00' AS last_updated FROM texts2 UNION ALL
            SELECT t.*, CASE WHEN f.stores_sensitive_data = 'yes' THEN TIMESTAMP '2024-03-01 12:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END
            FROM texts t JOIN {first} f ON t.record_id = f.record_id WHERE t.record_id NOT IN (SELECT record_id FROM texts2))""")
        + f"""SELECT record_id, app_description AS description, CAST(strlen(doc_text) AS BIGINT) AS bytes,
            strlen(doc_text) > {OVERFLOW_LIMIT} AS is_overflow, last_updated FROM merged""",
        "lookup_exact": _base(_app(), CHILDREN, _documents(), views=(*FOUR, "lookups"))
        + f"SELECT {doc_columns} FROM docs WHERE record_id IN (SELECT record_id FROM fx_lookups WHERE NOT is_partial)",
        "lookup_single": docs + f"SELECT {doc_columns} FROM docs WHERE record_id = '{RECORD}'",
        "lookup_partial": docs + f"SELECT {doc_columns} FROM docs WHERE contains(lower(record_id), lower('{SEARCH_TERM}'))",
        "lookup_terms": _base(views=("apps", "lookups")) + """SELECT term, record_id FROM
            (SELECT DISTINCT lower(trim(record_id)) AS term FROM fx_lookups WHERE is_partial AND trim(record_id) <> '') t
            JOIN (SELECT DISTINCT record_id FROM fx_apps) a ON contains(lower(a.record_id), term)""",
        "overflow_read": _base(_app(), CHILDREN, _documents(), _dumps(None, name="texts2"))
        + f"""SELECT d.*, strlen(t.doc_text) > {OVERFLOW_LIMIT} AS is_overflow FROM
            (SELECT {doc_columns} FROM docs) d JOIN texts2 t USING (record_id)""",
        "overflow_json_read": _base(_app(), CHILDREN, _documents(), _dumps(None, name="texts2"))
        + f"""SELECT d.*, strlen(t.doc_text) > {OVERFLOW_LIMIT} AS is_overflow, CAST(NULL AS VARCHAR) AS error FROM
            (SELECT {doc_columns} FROM docs) d JOIN texts2 t USING (record_id)""",
        "stats_count": apps_only + "SELECT count(DISTINCT record_id) AS count FROM fx_apps",
        "stats_list": apps_only + "SELECT DISTINCT record_id FROM fx_apps ORDER BY record_id",
        "stats_cache": texts + f"""SELECT count(*) AS total_cached, count(*) FILTER ({OVER}) AS overflow_items,
            count(*) FILTER (NOT ({OVER})) AS inline_items FROM sized""",
        "stats_usage": _usage("SELECT * REPLACE (coalesce(legal_reviewer_group, '') AS legal_reviewer_group) FROM counters"),
        "stats_reviewer_groups": _usage("""SELECT CASE WHEN trim(coalesce(legal_reviewer_group, '')) = '' THEN 'Unknown'
            ELSE legal_reviewer_group END AS reviewer_group, count(*) AS unique_apps,
            CAST(sum(hit_count) AS BIGINT) AS total_lookups FROM counters GROUP BY 1 ORDER BY total_lookups DESC, 1"""),
        "request_outcomes": _base(OUTCOMES, views=USED) + "SELECT event_id, record_id, is_partial, status FROM outcome",
        "usage_counters": _usage("SELECT * FROM counters"),
        "usage_counters_stream": _usage("SELECT * FROM counters"),
        "usage_daily_stream": _usage("SELECT record_id, day, count(*) AS hit_count FROM kept GROUP BY 1, 2", f""",
span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM fx_lookups),
sent AS (SELECT event_id, ts, CAST(least({DELIVERIES - 1}, CASE WHEN event_id % 13 = 0 THEN {DELIVERIES - 1}
         ELSE ({DELIVERIES} * (epoch_us(ts) - a)) // (z - a + 1) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END END) AS INTEGER) AS delivery
         FROM fx_lookups, span),
-- The stream sees the eligible requests alone, so these alone move its clock.
clock AS (SELECT delivery, max(ts) AS latest FROM sent JOIN eligible USING (event_id) GROUP BY delivery),
kept AS (SELECT h.record_id, CAST(date_trunc('day', h.ts) AS TIMESTAMP) AS day FROM hits h JOIN sent USING (event_id)
         WHERE date_trunc('day', h.ts) + INTERVAL 1 DAY > coalesce((SELECT max(latest) FROM clock WHERE clock.delivery < sent.delivery)
               - INTERVAL {LATENESS}, TIMESTAMP '1970-01-01'))"""),
        "usage_reviewers": _usage("""SELECT record_id, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS n_parts,
            string_agg(reviewer, ',' ORDER BY reviewer) AS reviewers FROM (SELECT DISTINCT record_id, reviewer FROM hits
            WHERE reviewer <> '') GROUP BY record_id"""),
        "usage_reviewer_hits": _usage("""SELECT record_id, reviewer, count(*) AS hit_count, max(ts) AS last_hit FROM hits
            WHERE reviewer <> '' GROUP BY record_id, reviewer"""),
        "usage_daily": _usage("""SELECT record_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS hit_count
            FROM hits GROUP BY 1, 2"""),
        "usage_ranking": _usage("SELECT record_id, hit_count FROM counters ORDER BY hit_count DESC, record_id"),
        "never_reviewed": _usage("SELECT record_id FROM app WHERE record_id NOT IN (SELECT record_id FROM hits)"),
        "version_lookup": _base(views=("version_requests", "versions")) + """
            SELECT r.event_id, trim(r.tool_name) AS tool_name, CAST(CASE WHEN trim(r.tool_name) = '' THEN 400 WHEN v.tool_name IS NULL THEN 404
            ELSE 200 END AS INTEGER) AS status, latest_version, minimum_required_version
            FROM fx_version_requests r LEFT JOIN fx_versions v ON trim(r.tool_name) = v.tool_name""",
        "version_compare": _base(views=("clients",)) + f"""SELECT client_id, local_version,
            {_compare('local_version', "'1.9.0'")} AS "order" FROM fx_clients""",
        "client_version_status": _base(views=("clients", "versions")) + f"""
            SELECT c.*, v.latest_version, v.minimum_required_version, CASE
              WHEN coalesce(latest_version, '') = '' OR coalesce(minimum_required_version, '') = '' THEN 'error'
              WHEN {_compare('local_version', 'minimum_required_version')} < 0 THEN 'blocked'
              WHEN {_compare('local_version', 'latest_version')} < 0 THEN 'update_available' ELSE 'up_to_date' END AS status
            FROM fx_clients c LEFT JOIN fx_versions v USING (tool_name)""",
        "report_names": _base("""used AS (SELECT regexp_extract(report_name, '^(.*)_review_', 1) AS record_id,
              regexp_extract(report_name, '_review_([0-9]{8})_', 1) AS day,
              max(CAST(regexp_extract(report_name, '_([0-9]+)\\.md$', 1) AS BIGINT)) AS last
              FROM fx_old_reports WHERE report_name LIKE '%.md' GROUP BY 1, 2)""",
                              """new AS (SELECT *, strftime(created, '%Y%m%d') AS day FROM fx_new_reports)""",
                              """seqs AS (SELECT new.review_id, new.record_id, new.day, coalesce(last, 0) + row_number() OVER (
              PARTITION BY new.record_id, new.day ORDER BY created, review_id)
              AS seq FROM new LEFT JOIN used ON new.record_id = used.record_id AND new.day = used.day)""",
                              views=("new_reports", "old_reports"))
        + "SELECT *, printf('%s_review_%s_%03d.md', record_id, day, seq) AS report_name FROM seqs",
        "review_prompts": made_prompts
        + """SELECT record_id, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS n_parts, prompt,
            CAST(strlen(prompt) AS INTEGER) AS prompt_bytes FROM made""",
        "review_prompts_in_pieces": made_prompts + "SELECT record_id, prompt FROM made",
        "gate_sections": sections + "SELECT * FROM secs",
        "gate_tables": _base(SECTIONS, TABLE_NAMES, views=("reviews",))
        + "SELECT r.review_id, r.record_id, r.version, gate, position, table_name FROM tabs JOIN fx_reviews r USING (review_id)",
        "action_items": items + "SELECT * FROM action",
        "checklist_items": items + "SELECT * FROM checklist",
        "findings_summary": _summary("true", "true", "true"),
        "findings_filtered": _summary("lower(\"table\") = 'users'", "lower(table_name) = 'users'", "t.gate_number = 3"),
        "findings_per_review": _per_review(),
        "review_delta": items + """SELECT record_id, gate, "table", description,
            count(*) FILTER (version = 2) AS current_count, count(*) FILTER (version = 1) AS prior_count,
            CASE WHEN count(*) FILTER (version = 1) = 0 THEN 'new' WHEN count(*) FILTER (version = 2) = 0 THEN 'resolved'
            ELSE 'unchanged' END AS status FROM found GROUP BY record_id, gate, "table", description""",
        "gate_rule_checks": _base(_app(), CHILDREN, RULE_BASE) + RULES,
        "external_crossref": _base("""seen AS (SELECT application_name, store_id, bool_or(detected_sensitive) AS detected_sensitive
              FROM fx_external GROUP BY ALL)""", CHILDREN, f"""j AS (SELECT e.application_name, e.store_id, CASE
              WHEN s.store_id IS NULL THEN 'missing_store'
              WHEN e.detected_sensitive <> {_bool('s.has_sensitive_data')} THEN 'contradicted' END AS issue, e.detected_sensitive,
              CASE WHEN s.store_id IS NOT NULL THEN {_bool('s.has_sensitive_data')} END AS attested_sensitive
              FROM seen e LEFT JOIN st s USING (application_name, store_id))""", views=("stores", "objects", "fields", "external"))
        + "SELECT * FROM j WHERE issue IS NOT NULL",
        "integrity_report": _base() + INTEGRITY,
        "dataset_preflight": _base("""n AS (SELECT DISTINCT dataset FROM fx_dataset_names)""", views=("dataset_names",)) + """
            SELECT dataset, dataset IN ('orders', 'lineitem') AS accessible, CASE
              WHEN NOT regexp_matches(dataset, '^[a-zA-Z][a-zA-Z0-9_.]+$') THEN concat('Invalid dataset name format: ', dataset)
              WHEN dataset = 'archive' THEN 'Cannot access dataset archive: PATH_NOT_FOUND'
              WHEN dataset NOT IN ('orders', 'lineitem') THEN concat('Cannot access dataset ', dataset) END AS error FROM n""",
    }
