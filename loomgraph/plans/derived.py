"""A symbol graph and source files derived from the sample tables, by SQL that Spark and DuckDB read alike.

The sample tables hold no source trees.  Regions, nations, suppliers, customers, parts and orders play modules, files, traits, structs,
functions and tasks; files are composed of their columns.  The operators that run on them are the engine's own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import EDGES, Graph

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

_PLACE = "'/' || r_name || '/' || n_name"
_HOME = "FROM {table} JOIN nation ON {key} = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_COLUMNS = "CAST({id} AS BIGINT) AS node_id, '{kind}' AS kind, {name} AS name, {file} AS file, CAST({start} AS INT) AS start_line, CAST({end} AS INT) AS end_line, 0 AS start_col, 0 AS end_col, {signature} AS signature, {visibility} AS visibility, 'tables' AS analyzer"


def _node(source: str, **values: str) -> str:
    return f"SELECT {_COLUMNS.format(**({'signature': 'CAST(NULL AS STRING)', 'visibility': chr(39) + 'Public' + chr(39)} | values))} {source}"


NODES_SQL = "\nUNION ALL ".join(
    (
        _node("FROM region", id="r_regionkey * 8", kind="Module", name="r_name", file="'/' || r_name", start="1", end="1"),
        _node("FROM nation JOIN region ON n_regionkey = r_regionkey", id="n_nationkey * 8 + 1", kind="File", name="n_name", file=_PLACE, start="0", end="99"),
        _node(_HOME.format(table="supplier", key="s_nationkey"), id="s_suppkey * 8 + 2", kind="Trait", name="s_name", file=_PLACE, start="s_suppkey % 500 + 1", end="s_suppkey % 500 + 5"),
        _node(
            _HOME.format(table="customer", key="c_nationkey"), id="c_custkey * 8 + 3", kind="Struct", name="c_mktsegment", file=_PLACE, start="c_custkey % 1000 + 1", end="c_custkey % 1000 + c_custkey % 50 - 3",
            visibility="CASE c_custkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'Crate' END",
        ),
        _node(
            "FROM part", id="p_partkey * 8 + 4", kind="Function", name="p_name", file="'/' || CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'lib' ELSE 'vendor' END || '/' || p_brand || '/' || lower(p_type) || '.core.rs'",
            start="p_partkey % 900 + 1", end="p_partkey % 900 + p_size", signature="'pub fn ' || p_name || '(&self, kind: base::types::' || p_type || ')\n   -> core::' || p_brand || CASE WHEN p_size % 7 = 0 THEN repeat('é', p_size) ELSE '' END",
            visibility="CASE WHEN p_size % 2 = 0 THEN 'Public' ELSE 'Private' END",
        ),
        _node("FROM orders", id="o_orderkey * 8 + 5", kind="Task", name="o_orderpriority", file="'/tasks/' || o_orderstatus || '.yml'", start="o_orderkey % 2000 + 1", end="o_orderkey % 2000 + 1", visibility="'Private'"),
    )
)

PAIRS_SQL = """
SELECT CAST(n_regionkey * 8 AS BIGINT) AS src, CAST(n_nationkey * 8 + 1 AS BIGINT) AS dst, 'Contains' AS kind FROM nation
UNION ALL SELECT CAST(c_nationkey * 8 + 1 AS BIGINT), CAST(c_custkey * 8 + 3 AS BIGINT), 'Contains' FROM customer
UNION ALL SELECT CAST(s_nationkey * 8 + 1 AS BIGINT), CAST(s_suppkey * 8 + 2 AS BIGINT), 'Contains' FROM supplier
UNION ALL SELECT DISTINCT CAST(o_custkey * 8 + 3 AS BIGINT), CAST(l_partkey * 8 + 4 AS BIGINT), 'Calls' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT CAST(l_partkey * 8 + 4 AS BIGINT), CAST(l_suppkey * 8 + 2 AS BIGINT), 'Implements' FROM lineitem
UNION ALL SELECT CAST(o_custkey * 8 + 3 AS BIGINT), CAST(o_orderkey * 8 + 5 AS BIGINT), 'References' FROM orders
"""
#: An id that doesn't depend on any order: 60 bits of a digest.
_DIGEST = "md5(src || '-' || dst || '-' || kind)"
EDGE_ID = {"spark": f"CAST(conv(substring({_DIGEST}, 1, 15), 16, 10) AS BIGINT)", "duckdb": f"CAST(('0x' || substr({_DIGEST}, 1, 15)) AS BIGINT)"}


def edges_sql(engine: str) -> str:
    return f"SELECT {EDGE_ID[engine]} AS edge_id, src, dst, kind FROM ({PAIRS_SQL}) p"


#: Files by name: (path, content) from the columns of a table.
FILES_SQL = {
    "terraform": """SELECT '/infra/' || p_partkey || '.tf' AS path,
        'resource "' || p_type || '" "' || p_name || '" {\n  size = var.s' || p_size || '.x\n  of = module.' || replace(lower(p_brand), '#', '_') || '\n}\n'
        || CASE p_partkey % 4 WHEN 0 THEN 'data "ami" "base' || p_size || '" {\n}' WHEN 1 THEN 'variable "s' || p_size || '" {\n  x = data.ami.id\n}'
           WHEN 2 THEN 'output "o' || p_partkey || '" {}' ELSE 'module "m" {\n a = local.z }\nlocals {\n}' END AS content FROM part""",
    "sql": """SELECT '/schema/' || s_suppkey || '.sql' AS path,
        'CREATE TABLE IF NOT EXISTS t' || s_suppkey || ' (\n  id INTEGER PRIMARY KEY,\n  nation BIGINT REFERENCES n' || s_nationkey || '(id),\n  note VARCHAR(20)\n);\n'
        || CASE s_suppkey % 3 WHEN 0 THEN 'create table Größe_' || s_nationkey || ' (\n  x TEXT,\n  FOREIGN KEY (x) REFERENCES t' || s_suppkey || ' (id)\n);\n  late TEXT\n'
           WHEN 1 THEN 'CREATE TABLE tail (\n  k INT REFERENCES t0(id) );\n' ELSE '-- nothing\n' END AS content FROM supplier""",
    "proto": """SELECT '/api/' || s_suppkey || '.proto' AS path,
        'message M' || s_suppkey || ' {\n  string id = 1;\n}\nservice S' || s_nationkey || ' {\n  rpc Get' || s_suppkey || ' (M' || s_suppkey || ') returns (M' || (s_suppkey + 1) || ');\n  rpc Ñandú(A) returns(B);\n}\nrpc Loose(A) returns (B);'
        AS content FROM supplier""",
    "jinja": """SELECT '/roles/web/templates/' || c_custkey || '.j2' AS path,
        'name={{ ' || lower(c_mktsegment) || '_name }} port={{port_' || c_nationkey || '}} {{ not this }} {{  größe  }}' AS content FROM customer""",
    "markdown": """SELECT '/docs/' || p_partkey || '.md' AS path,
        '# ' || p_name || '\n\nIntro line\nnext line\n\n' || repeat('#', CAST(p_size % 5 + 2 AS INT)) || ' ' || p_type || ' ##\n[home](../guide/page' || p_size || '.md) and [web](http://x.y) and [top](#a)\n\n### Part\n```\n# not a heading\n```\n## ' || p_brand || '\n'
        AS content FROM part""",
    "code": """SELECT '/lib/' || CASE s_suppkey % 5 WHEN 0 THEN 'src/a' WHEN 1 THEN 'vendor/b' WHEN 2 THEN '.hidden/c' WHEN 3 THEN 'x/dist/d' ELSE 'e' END || s_suppkey
        || CASE s_suppkey % 9 WHEN 0 THEN '.rs' WHEN 1 THEN '.min.js' WHEN 2 THEN '.tsx' WHEN 3 THEN '.py' WHEN 4 THEN '.h' WHEN 5 THEN '.txt' WHEN 6 THEN '.kts' WHEN 7 THEN '-openapi.yaml' ELSE '.sql' END AS path,
        CASE WHEN s_suppkey % 11 = 0 THEN repeat('x', 100001) ELSE repeat('line of code' || chr(10), CAST(s_suppkey % 40 + 1 AS INT)) END AS content FROM supplier""",
}
FILES_FROM = {"terraform": "part", "sql": "supplier", "proto": "supplier", "jinja": "customer", "markdown": "part", "code": "supplier"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """``sql`` over the named tables; the views carry a name of their own so that queries don't meet."""
    frames = {t: table(spark, sf_dir, t) for t in tables if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(frames) + r")\b", r"\1 {\2}", plain), **frames)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(query(spark, sf_dir, NODES_SQL), query(spark, sf_dir, edges_sql("spark")).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in EDGES.split(", ")]))


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, FILES_SQL[name], (FILES_FROM[name],))
