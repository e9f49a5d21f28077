"""The four tables, the request log and the review texts, as views over the generated test tables.

``@name`` stands for a test table. The same text runs in Spark, where lines join their orders last, and, without the ``@``, in the
SQL checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
_PREFIX = "strataudit_in_"

# Views of texts, where parsing takes far longer than reading.
_TEXTS = ("reviews",)

# Columns that the views read. A declared schema spares a look into the file footers.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_tax double, "
                "l_returnflag string, l_linestatus string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string, lang string, source string",
}

_LINES = "@lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey"
_LINES_OF_NAMED = "@lineitem JOIN (@orders JOIN @customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey"

_NO_LOGINS = ", ".join(f"CAST(NULL AS VARCHAR(99)) AS reports_to_level_{i}_login" for i in range(2, 7))


def _apps(k: int) -> str:
    return f"""
SELECT c_name AS record_id, '2024-01-0{k}' AS snapshot_date, '06' AS snapshot_hour,
       CASE WHEN c_custkey % 10 = 0 THEN ''
            ELSE concat('desc ', c_mktsegment, ' – v{k}') END AS app_description,
       CASE WHEN c_custkey % 5 = 0 THEN n_name
            ELSE concat('{{owner_login=', n_name, ', supervisor_login=', r_name,
                        ', metadata={{team=', c_mktsegment, ', level=', CAST(c_custkey % 7 AS VARCHAR(9)),
                        '}}, tags=[', lower(r_name), ', a, null]}}') END AS ownership,
       n_name AS owner_login, r_name AS supervisor_login, c_mktsegment AS reports_to_level_1_login, {_NO_LOGINS},
       CASE c_custkey % 8 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN ' Yes ' WHEN 3 THEN 'TRUE'
            WHEN 4 THEN 'false' WHEN 5 THEN '0' WHEN 6 THEN '' END AS processes_sensitive_data,
       CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS stores_sensitive_data,
       CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE r_name END AS app_legal_reviewer_group
FROM @customer JOIN @nation ON c_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey"""


def _order_reviews(k: int) -> str:
    second = "'2) Add retention [low] - soon', chr(10)" if k == 1 else "'- [x] Add retention', chr(10)"
    boxed = "" if k == 1 else "'1. [ ] Review owner [HIGH]', chr(10), "
    return f"""
SELECT concat(CAST(o_orderkey AS VARCHAR(20)), '-{k}') AS review_id,
       CAST(o_orderkey AS VARCHAR(20)) AS record_id, {k} AS version,
       concat('# Review', chr(10), '## Gate 1: Completion Check', chr(10),
              '### Data Store: store-', CAST(o_orderkey AS VARCHAR(20)), chr(10),
              '1. Set description [HIGH]', chr(10), {second},
              chr(10), '### GATE 3 - Sensitive Data', chr(10),
              '- [ ] Flag column in table: users [MEDIUM]', chr(10), {boxed}'## Gate 7: Ignored', chr(10),
              '1. Not counted [HIGH]', chr(10)) AS content
FROM @orders"""


VIEWS: dict[str, str] = {
    # One snapshot per customer, a second one for the richer customers.
    "apps": _apps(1) + "\nUNION ALL" + _apps(2) + "\nWHERE c_acctbal > 6000",
    # The stores of the poorest customers do not tell their record.
    "stores": """
SELECT CASE WHEN c_acctbal >= -800 THEN c_name ELSE '' END AS application_name, CAST(o_orderkey AS VARCHAR(20)) AS store_id,
       concat('store-', CAST(o_orderkey AS VARCHAR(20))) AS store_name,
       o_orderpriority AS technology,
       CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS has_sensitive_data
FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    # Line 7 has no store, some lines name a store that does not exist; those of the very poorest tell no record.
    "objects": """
SELECT CASE WHEN c_acctbal >= -900 THEN c_name ELSE '' END AS application_name,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN l_linenumber = 6 AND l_orderkey % 100 = 0 THEN 'missing'
            ELSE CAST(l_orderkey AS VARCHAR(20)) END AS data_store_id,
       concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9))) AS object_id,
       concat('obj-', CAST(l_partkey AS VARCHAR(20))) AS object_name,
       CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS has_sensitive_data,
       CASE WHEN l_returnflag = 'N' THEN '' WHEN l_tax = 0 THEN 'unknown'
            ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END AS retention_days,
       l_linestatus AS technology
FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey""",
    # The fields of line 5 tell no record, so its object has none.
    "fields": """
SELECT CASE WHEN l_linenumber = 5 THEN '' ELSE c_name END AS application_name,
       concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9))) AS object_id,
       CASE p_size % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'phone_number' WHEN 2 THEN 'address'
            WHEN 3 THEN 'quantity' WHEN 4 THEN p_name END AS field_name,
       p_name AS field_description, p_brand AS field_type
FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey
JOIN @part ON l_partkey = p_partkey""",
    "lookups": """
SELECT event_id, ts,
       CASE WHEN user_id % 20 = 0 THEN '' WHEN user_id % 21 = 0 THEN 'Customer#none'
            WHEN event_id % 10 = 0 THEN concat('MER#', lpad(CAST(user_id AS VARCHAR(20)), 8, '0'))
            ELSE concat('Customer#', lpad(CAST(user_id AS VARCHAR(20)), 9, '0')) END AS record_id,
       CASE event_type WHEN 'view' THEN 'cli' WHEN 'click' THEN 'mcp' WHEN 'error' THEN 'browser'
            ELSE '' END AS x_source,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE '0.2.0' END AS x_tool_version,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('rev', CAST(event_id % 7 AS VARCHAR(9))) END AS reviewer,
       (event_id % 10 = 0) AS is_partial
FROM @events""",
    # Two reviews per order, one per document that carries its whole text, and one per region that says nothing.
    "reviews": _order_reviews(1) + "\nUNION ALL" + _order_reviews(2) + """
UNION ALL
SELECT concat('doc-', CAST(doc_id AS VARCHAR(20))) AS review_id, source AS record_id,
       CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version,
       concat('## Gate 2: External Findings', chr(10), text, chr(10), '### Table: ', source, chr(10),
              '- [ ] Compare with scan [LOW]', chr(10)) AS content
FROM @documents
UNION ALL
SELECT concat('blank-', CAST(r_regionkey AS VARCHAR(20))) AS review_id, r_name AS record_id, 1 AS version,
       CASE WHEN r_regionkey % 2 = 0 THEN '  ' END AS content
FROM @region""",
    "prior": """
SELECT concat('Customer#', lpad(CAST(doc_id AS VARCHAR(20)), 9, '0')) AS record_id, text AS content
FROM @documents""",
    "external": """
SELECT c_name AS application_name,
       CASE WHEN o_orderkey % 13 = 0 THEN concat('x', CAST(o_orderkey AS VARCHAR(20)))
            ELSE CAST(o_orderkey AS VARCHAR(20)) END AS store_id,
       (o_orderkey % 5 = 0) AS detected_sensitive
FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    "versions": """
SELECT 'tool-a' AS tool_name, '1.10.0' AS latest_version, '1.2.0' AS minimum_required_version
UNION ALL SELECT 'tool-b', '2.0.0', '2.0.0' UNION ALL SELECT 'tool-c', '', '1.0.0'""",
    "clients": """
SELECT c_custkey AS client_id,
       CASE c_custkey % 4 WHEN 0 THEN 'tool-a' WHEN 1 THEN 'tool-b' WHEN 2 THEN 'tool-c' ELSE 'tool-z' END AS tool_name,
       CASE WHEN c_custkey % 11 = 0 THEN 'dev'
            ELSE concat('1.', CAST(c_custkey % 13 AS VARCHAR(9)), '.0') END AS local_version
FROM @customer""",
    "version_requests": """
SELECT event_id, CASE event_type WHEN 'view' THEN 'tool-a' WHEN 'click' THEN 'tool-b' WHEN 'error' THEN ' tool-c '
            WHEN 'purchase' THEN 'tool-z' ELSE ' ' END AS tool_name
FROM @events""",
    "new_reports": """
SELECT CAST(event_id AS VARCHAR(20)) AS review_id, concat('Customer#', CAST(user_id AS VARCHAR(20))) AS record_id,
       ts AS created
FROM @events""",
    "old_reports": """
SELECT concat('Customer#', CAST(user_id AS VARCHAR(20)), '_review_',
              replace(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '-', ''), '_',
              CASE WHEN event_id % 1200 < 1000 THEN lpad(CAST(event_id % 1200 AS VARCHAR(9)), 3, '0')
                   ELSE CAST(event_id % 1200 AS VARCHAR(9)) END,
              CASE WHEN event_type = 'signup' THEN '.txt' ELSE '.md' END) AS report_name
FROM @events""",
    "dataset_names": """
SELECT CASE p_size % 6 WHEN 0 THEN 'orders' WHEN 1 THEN 'lineitem' WHEN 2 THEN p_brand WHEN 3 THEN p_type
            WHEN 4 THEN p_name ELSE 'archive' END AS dataset
FROM @part""",
}


def over_all_cores(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, spread over the cores.

    A file of a few megabytes is one task, and all parsing of its texts would stay in it. A scan of real
    size has more partitions than cores and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


class Inputs:
    """The views as DataFrames, for one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: set[str] = set()

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for table in TABLES:
            if f"@{table}" in text:
                self._register(table)
        # Spark joins in the order of the text. Orders learn their customer before the lines join them, so that lines move once.
        text = text.replace(_LINES, _LINES_OF_NAMED)
        rows = self.spark.sql(text.replace("@", _PREFIX))
        return over_all_cores(rows) if name in _TEXTS else rows

    def stream_view(self, name: str, source: DataFrame) -> DataFrame:
        """A view over one table, with a stream in place of the table."""
        table = next(x for x in TABLES if f"@{x}" in VIEWS[name])
        source.createOrReplaceTempView(f"{_PREFIX}stream_{table}")
        return self.spark.sql(VIEWS[name].replace("@", f"{_PREFIX}stream_"))

    def _register(self, table: str) -> None:
        if table not in self._known:
            rows = self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.folder}/{table}.parquet")
            rows.createOrReplaceTempView(_PREFIX + table)
            self._known.add(table)

    @cached_property
    def four(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.view("apps"), self.view("stores"), self.view("objects"), self.view("fields")


def sql_views(*names: str) -> str:
    """``WITH`` text that defines the views for a SQL engine."""
    parts = [f"fx_{n} AS ({VIEWS[n].replace('@', '')}\n)" for n in names]
    return "WITH " + ",\n".join(parts)
