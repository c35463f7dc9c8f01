"""The registered queries: the engine's operators over the derived graph and files, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import code, text, yamls
from ..functions import columns as C
from ..model import DEFINITION_KINDS, LANGUAGES, NOISE_NAMES, SCAN_PRUNED, TRANSPARENT_DIRS, TUNNEL_PAIRS, WATCH_IGNORED, Graph
from ..operators import changes, lookup, resolve, rollup, wings
from ..operators import graph as G
from ..scratch import new_path, written
from ..sources import detect, store
from ..streaming import feed
from . import build, derived, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Nodes and edges as DuckDB sees them.
GRAPH = f"WITH RECURSIVE nodes AS ({derived.NODES_SQL}), edges AS ({derived.edges_sql('duckdb')})"
SYMBOL, STRUCT, TRAIT, NATION = "red widget", "BUILDING", "Supplier#000000001", "/AFRICA/NATION_0"


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _files(name: str) -> str:
    return f"WITH files AS ({derived.FILES_SQL[name]})"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def on_graph(sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Register an operator on the derived graph."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(derived.graph(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"{GRAPH} {sql}"
        return f

    return add


LINES = "greatest(end_line - start_line, 0) + 1"


@on_graph(f"""
SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Struct') AS structs,
  count(*) FILTER (kind = 'Trait') AS traits, count(*) FILTER (kind = 'Enum') AS enums, count(*) FILTER (kind = 'Module') AS modules,
  count(*) FILTER (kind NOT IN ('File', 'Function', 'Struct', 'Trait', 'Enum', 'Module')) AS other, sum({LINES})::BIGINT AS total_lines FROM nodes""")  # fmt: skip
def stats(g: Graph) -> DataFrame:
    return G.stats(g.nodes)


@on_graph("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_counts(g: Graph) -> DataFrame:
    return G.edge_counts(g.edges)


@on_graph(f"""
, ends AS (SELECT src AS node_id FROM edges WHERE kind <> 'Contains' UNION ALL SELECT dst FROM edges WHERE kind <> 'Contains'),
d AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY node_id HAVING count(*) > 1),
r AS (SELECT name, kind, degree, row_number() OVER (PARTITION BY name ORDER BY degree DESC, node_id) AS k
  FROM nodes JOIN d USING (node_id) WHERE kind NOT IN ('File', 'EnumVariant', 'Column', 'Impl') AND name NOT IN {_in(NOISE_NAMES)})
SELECT name, CASE kind WHEN 'Function' THEN 'fn' WHEN 'Struct' THEN 'st' WHEN 'Trait' THEN 'tr' WHEN 'Module' THEN 'mod' ELSE 'task' END AS tag, degree
FROM r WHERE k = 1 ORDER BY degree DESC, name LIMIT 7""")  # fmt: skip
def hubs(g: Graph) -> DataFrame:
    return G.hubs(g)


_REL = "substr(file, 2)"
_DIRS = f"list_filter(string_split({_REL}, '/')[:-2], lambda x: x NOT IN {_in(TRANSPARENT_DIRS)})"


def _names(condition: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER ({condition}))), ','), '')"


@on_graph(f"""
, m AS (SELECT *, coalesce({_DIRS}[1], split_part(string_split({_REL}, '/')[-1], '.', 1)) AS module,
    {_REL} LIKE '%test%' OR {_REL} LIKE '%spec%' OR {_REL} LIKE '%bench%' AS test
  FROM nodes WHERE NOT ({_REL} LIKE '%fixture%' OR {_REL} LIKE '%/target/%' OR string_split({_REL}, '/')[1] IN ('target', 'node_modules', '.git', '__pycache__', 'vendor', 'dist', 'build')))
SELECT module, count(*) FILTER (kind = 'Function' AND NOT test) AS fn_count, count(*) FILTER (kind = 'Function' AND NOT test AND visibility = 'Public') AS pub_fn_count,
  count(*) FILTER (kind = 'Function' AND test) AS test_count, {_names("NOT test AND visibility = 'Public' AND kind = 'Struct'")} AS structs,
  {_names("NOT test AND visibility = 'Public' AND kind = 'Trait'")} AS traits, '' AS enums, '' AS domain FROM m GROUP BY module""")  # fmt: skip
def module_rollup(g: Graph) -> DataFrame:
    rows = rollup.modules(g.nodes)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("structs", "traits", "enums", "domain")})


@on_graph("""SELECT src AS node_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS calls FROM edges JOIN nodes ON dst = node_id WHERE edges.kind = 'Calls' GROUP BY src""")
def callee_sets(g: Graph) -> DataFrame:
    return lookup.callees(g).withColumn("calls", F.array_join("calls", ","))


@on_graph("SELECT file, count(*) AS n, min(start_line) AS first_line, max(end_line) AS last_line FROM nodes GROUP BY file")
def nodes_by_file(g: Graph) -> DataFrame:
    return rollup.by_file(g.nodes)


@on_graph("""
, p AS (SELECT DISTINCT string_split(file, '/')[2:] AS parts FROM nodes),
e AS (SELECT min(parts) AS a, max(parts) AS b FROM p)
SELECT '/' || array_to_string(a[1:(SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(1, len(a))) AS i) WHERE a[1:i] = b[1:i])], '/') AS prefix FROM e""")
def common_prefix(g: Graph) -> DataFrame:
    return rollup.common_prefix(g.nodes)


@on_graph(f"SELECT node_id, kind, file FROM nodes WHERE name = '{SYMBOL}'")
def name_lookup(g: Graph) -> DataFrame:
    return lookup.by_name(g.nodes, SYMBOL).select("node_id", "kind", "file")


@on_graph(f"SELECT node_id, kind, name FROM nodes WHERE file = '{NATION}'")
def file_lookup(g: Graph) -> DataFrame:
    return lookup.by_file(g.nodes, NATION).select("node_id", "kind", "name")


@on_graph(f"SELECT min(node_id) AS node_id FROM nodes WHERE name = '{STRUCT}' AND kind = 'Struct' HAVING count(*) > 0")
def primary_definition(g: Graph) -> DataFrame:
    return lookup.primary(g.nodes, STRUCT).select("node_id")


def _references(symbol: str) -> str:
    return f"""
, named AS (SELECT * FROM nodes WHERE name = '{symbol}' AND kind IN {_in(DEFINITION_KINDS)}),
first AS (SELECT src, e.kind, row_number() OVER (PARTITION BY src ORDER BY dst, edge_id DESC, e.kind) AS k FROM edges e JOIN named ON dst = node_id WHERE e.kind <> 'Contains'),
refs AS (SELECT min(node_id) AS node_id, 'Definition' AS ref_kind FROM named GROUP BY file
  UNION ALL SELECT src, CASE kind WHEN 'Calls' THEN 'Call' WHEN 'Implements' THEN 'Impl' WHEN 'TypeRef' THEN 'TypeRef' ELSE 'Ref' END FROM first WHERE k = 1)
SELECT node_id, ref_kind, name, kind, file, start_line FROM refs JOIN nodes USING (node_id) WHERE kind <> 'File'"""


@on_graph(_references(SYMBOL))
def references(g: Graph) -> DataFrame:
    return lookup.references(g, SYMBOL)


@on_graph(_references(SYMBOL) + " AND ref_kind = 'Call'")
def callers(g: Graph) -> DataFrame:
    return lookup.callers(g, SYMBOL)


@on_graph(_references(TRAIT) + " AND ref_kind = 'Impl'")
def implementations(g: Graph) -> DataFrame:
    return lookup.implementations(g, TRAIT)


def _reach(symbol: str, kind: str, here: str, there: str, depth: int) -> str:
    return f"""
, hops AS (SELECT DISTINCT {here} AS a, {there} AS b FROM edges),
reach AS (SELECT min(node_id) AS node_id, 0 AS depth FROM nodes WHERE name = '{symbol}' AND kind = '{kind}'
  UNION SELECT b, depth + 1 FROM reach JOIN hops ON a = node_id WHERE depth < {depth}),
found AS (SELECT node_id, min(depth) AS depth FROM reach GROUP BY node_id)
SELECT node_id, name, kind, file, start_line, depth::INT AS depth FROM found JOIN nodes USING (node_id) WHERE depth > 0 AND kind <> 'File'"""


@on_graph(_reach(STRUCT, "Struct", "src", "dst", 5))
def dependencies(g: Graph) -> DataFrame:
    return lookup.dependencies(g, STRUCT)


@on_graph(_reach(SYMBOL, "Function", "dst", "src", 10))
def impact(g: Graph) -> DataFrame:
    return lookup.impact(g, SYMBOL)


@on_graph("""
, s AS (SELECT *, CASE WHEN name = 'red' THEN 0 WHEN lower(name) LIKE 'red%' THEN 1 WHEN lower(name) LIKE '%red%' THEN 2 END AS score FROM nodes WHERE kind <> 'File'),
b AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY score, node_id) AS k FROM s WHERE score IS NOT NULL)
SELECT score, name, kind, node_id, file, start_line, count(*) OVER () AS total FROM b WHERE k = 1 ORDER BY score, name, kind LIMIT 20""")
def search_names(g: Graph) -> DataFrame:
    return lookup.search(g.nodes, "Red".lower())


@on_graph("""SELECT node_id, name, signature, file, start_line, count(*) OVER () AS total FROM nodes WHERE lower(signature) LIKE '%widget(&self%economy%' OR lower(signature) LIKE '%kind: base::types::economy%'
ORDER BY start_line, file, node_id LIMIT 30""")
def search_signatures(g: Graph) -> DataFrame:
    return lookup.search_signatures(g.nodes, "Kind: Base::types::economy")


@on_graph("""
, s AS (SELECT CASE kind WHEN 'Struct' THEN 'struct' WHEN 'Trait' THEN 'trait' ELSE 'enum' END AS label, coalesce(signature, name) AS shown, node_id, file, start_line
  FROM nodes WHERE kind IN ('Struct', 'Enum', 'Trait') AND visibility = 'Public')
SELECT *, count(*) OVER () AS total FROM s ORDER BY label, shown, node_id LIMIT 50""")
def symbols_by_kind(g: Graph) -> DataFrame:
    return lookup.symbols(g.nodes, "type", public_only=True)


_FILE = "Brand#1/economy.core.rs"


@on_graph(f"""
, f AS (SELECT DISTINCT file FROM nodes WHERE file = '{_FILE}' OR file LIKE '%/{_FILE}' ORDER BY file LIMIT 1)
SELECT node_id, 'fn' AS label, visibility, coalesce(signature, name) AS shown, start_line, CAST(NULL AS VARCHAR) AS calls FROM nodes JOIN f USING (file) WHERE kind <> 'File'""")
def file_summary(g: Graph) -> DataFrame:
    return lookup.file_summary(g, _FILE).withColumn("calls", F.array_join("calls", ","))


@register("""
WITH t AS (SELECT doc_id, '/d/' || doc_id AS file, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT file, lines, unnest(range(greatest(doc_id % 4, 1), least(doc_id % 4 + 6, len(lines)) + 1)) AS line, greatest(doc_id % 4, 1) AS first FROM t)
SELECT file, line::INT AS line, lines[line] AS text, count(*) OVER (PARTITION BY file) AS total FROM s QUALIFY line < first + 5""")
def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    spans = docs.select(F.col("path").alias("file"), (F.col("doc_id") % 4).cast("int").alias("start_line"), (F.col("doc_id") % 4 + 6).cast("int").alias("end_line"))
    return lookup.slice_lines(docs.select("path", F.col("text").alias("content")), spans, 5)


@on_graph("SELECT node_id, substr(file, 9) AS rel FROM nodes WHERE file = '/AFRICA' OR file LIKE '/AFRICA/%'")
def path_filter(g: Graph) -> DataFrame:
    own = g.nodes.filter(C.under(F.col("file"), "/AFRICA/"))
    return own.select("node_id", F.when(F.col("file") == "/AFRICA", "").otherwise(C.rel_path(F.col("file"), "/AFRICA")).alias("rel"))


def _compressed(sig: str) -> str:
    s = f"array_to_string(list_transform(string_split({sig}, chr(10)), lambda x: trim(x)), ' ')"
    for x in ("pub fn ", "pub async fn ", "async fn ", "fn ", "pub "):
        s = f"replace({s}, '{x}', '')"
    s = f"regexp_replace({s}, '[\\p{{L}}\\p{{N}}_]+::', '', 'g')"
    for old, new in (("(&self, ", "("), ("(&self)", "()"), ("(&mut self, ", "(&mut, "), ("(&mut self)", "(&mut)"), ("(mut self, ", "(mut, "), ("(mut self)", "(mut)")):
        s = f"replace({s}, '{old}', '{new}')"
    return s


#: The most characters of s that fit in 117 bytes.
_CUT = "CASE WHEN octet_length(encode(s)) > 120 THEN (SELECT max(substr(s, 1, n)) FROM (SELECT unnest(range(1, 118)) AS n) WHERE octet_length(encode(substr(s, 1, n))) <= 117) || '...' ELSE s END"


@on_graph(f"""
, t AS (SELECT *, string_split(file, '/')[2:] AS parts FROM nodes WHERE kind NOT IN ('File', 'Impl') AND NOT (file LIKE '%/test%' OR file LIKE '%/spec%' OR file LIKE '%/fixture%' OR file LIKE '%/bench%')),
f AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY parts, node_id) AS k FROM t),
top AS (SELECT *, row_number() OVER (ORDER BY parts, node_id) AS position FROM f WHERE k = 1 QUALIFY position <= 40),
c AS (SELECT src, array_to_string(list_sort(list_distinct(list(name))), ',') AS calls FROM edges JOIN nodes ON dst = node_id WHERE edges.kind = 'Calls' GROUP BY src),
u AS (SELECT top.*, calls, coalesce({_compressed("signature")}, name) AS s FROM top LEFT JOIN c ON src = node_id)
SELECT file, node_id, position::INT AS position, CASE visibility WHEN 'Public' THEN '+' ELSE '' END || CASE kind WHEN 'Function' THEN 'fn' WHEN 'Struct' THEN 'st' WHEN 'Trait' THEN 'tr' WHEN 'Module' THEN 'mod' ELSE 'task' END
  || ':' || {_CUT} || coalesce('→[' || calls || ']', '') AS item FROM u""")  # fmt: skip
def compact_items(g: Graph) -> DataFrame:
    return rollup.compact(g, max_items=40)


@on_graph("""
, c AS (SELECT src, array_to_string(list_sort(list_distinct(list(name))), ', ') AS calls FROM edges JOIN nodes ON dst = node_id WHERE edges.kind = 'Calls' GROUP BY src)
SELECT file, node_id, CASE visibility WHEN 'Public' THEN 'pub ' ELSE '' END || CASE kind WHEN 'File' THEN 'file' WHEN 'Function' THEN 'fn' WHEN 'Struct' THEN 'struct' WHEN 'Trait' THEN 'trait' WHEN 'Module' THEN 'mod' ELSE 'task' END
  || ' ' || coalesce(signature, name) AS line, calls FROM nodes LEFT JOIN c ON src = node_id WHERE file = '/AFRICA' OR file LIKE '/AFRICA/%'""")
def skeleton_rows(g: Graph) -> DataFrame:
    return rollup.skeleton(g, "/AFRICA").withColumn("calls", F.array_join("calls", ", "))


@on_graph(f", u AS (SELECT node_id, {_compressed('signature')} AS s FROM nodes WHERE signature IS NOT NULL) SELECT node_id, {_CUT} AS compressed FROM u")
def compress_signature(g: Graph) -> DataFrame:
    return g.nodes.filter("signature is not null").select("node_id", C.compress_signature(F.col("signature")).alias("compressed"))


@on_graph(f""", l AS (SELECT file, sum({LINES})::BIGINT AS lines FROM nodes GROUP BY file)
SELECT file, CASE WHEN lines >= 1000 THEN '~' || lines // 1000 || 'kLOC' ELSE '~' || lines || 'LOC' END AS loc FROM l""")
def loc_display(g: Graph) -> DataFrame:
    lines = F.sum(C.span_lines(F.col("start_line"), F.col("end_line"))).alias("lines")
    return g.nodes.groupBy("file").agg(lines).select("file", C.loc_display(F.col("lines")).alias("loc"))


# ---- resolution ----------------------------------------------------------------------------------

#: Parts call parts by name; some names are nobody's.
_SITES = "SELECT p_partkey * 8 + 4 AS caller_id, CASE p_size % 5 WHEN 0 THEN 'nobody' WHEN 1 THEN p_name ELSE split_part(p_name, ' ', 1) || ' widget' END AS callee_name FROM part"
_TARGETS = "SELECT p_partkey * 8 + 4 AS node_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Trait' WHEN p_partkey % 3 = 1 THEN 'Struct' ELSE 'Function' END AS kind FROM part"


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.query(spark, sf_dir, _SITES, ("part",)), derived.query(spark, sf_dir, _TARGETS, ("part",))


_FOUND = f"WITH sites AS (SELECT DISTINCT * FROM ({_SITES})), targets AS ({_TARGETS}), found AS (SELECT caller_id AS src, callee_name, node_id AS dst FROM sites JOIN targets ON callee_name = name)"


@register(f"{_FOUND}, e AS (SELECT *, bool_or(dst <= src) OVER (PARTITION BY src, callee_name) AS early FROM found) SELECT DISTINCT src, dst FROM e WHERE src <> dst AND (NOT early OR dst <= src)")
def resolve_calls_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_calls(*_sites(spark, sf_dir), "strict")


@register(f"{_FOUND} SELECT DISTINCT src, dst FROM found WHERE src <> dst")
def resolve_calls_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_calls(*_sites(spark, sf_dir))


@register(f"WITH sites AS ({_SITES}), t AS (SELECT name, min(node_id) AS dst FROM ({_TARGETS}) WHERE kind = 'Trait' GROUP BY name) SELECT caller_id AS src, dst, (caller_id % 3)::INT AS seq FROM sites JOIN t ON name = callee_name")
def resolve_impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, targets = _sites(spark, sf_dir)
    impls = sites.select(F.col("caller_id").alias("impl_id"), F.col("callee_name").alias("trait_name"), (F.col("caller_id") % 3).cast("int").alias("seq"))
    return resolve.resolve_impls(impls, targets)


@register(f"""WITH sites AS ({_SITES}), t AS ({_TARGETS}), f AS (SELECT name, min(node_id) AS dst FROM t WHERE kind = 'Struct' GROUP BY name)
SELECT caller_id AS src, node_id AS dst, 'References' AS kind FROM sites JOIN t ON name = callee_name WHERE caller_id % 16 = 4
UNION ALL SELECT caller_id, dst, 'TypeRef' FROM sites JOIN f ON name = callee_name WHERE caller_id % 16 <> 4""")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, targets = _sites(spark, sf_dir)
    every = F.col("caller_id") % 16 == 4
    refs = sites.select(F.col("caller_id").alias("src"), F.col("callee_name").alias("ref_name"), F.when(every, "References").otherwise("TypeRef").alias("edge_kind"), F.when(~every, F.array(F.lit("Struct"))).alias("target_kinds"))
    return resolve.resolve_refs(refs, targets)


# ---- extraction ----------------------------------------------------------------------------------

_LINES = "lines AS (SELECT path, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1)::INT AS line FROM files)"
_W = C.WORD + "+"
_BLOCK = r"""'^(resource|data|variable|output|module|locals)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{'"""


def _symbols(spark: SparkSession, sf_dir: str, name: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return extract(derived.files(spark, sf_dir, name)).select("path", "ordinal", "parent", "kind", "name", "start_line", "signature")


def _refs(spark: SparkSession, sf_dir: str, name: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return extract(derived.files(spark, sf_dir, name)).groupBy("path", "ordinal", "edge_kind", "ref_name").agg(F.count("*").alias("n"))


@register(f"""{_files("terraform")}, {_LINES}, b AS (SELECT path, line, regexp_extract(text, {_BLOCK}, 1) AS block, regexp_extract(text, {_BLOCK}, 2) AS a, nullif(regexp_extract(text, {_BLOCK}, 3), '') AS b FROM lines WHERE regexp_matches(text, {_BLOCK}))
SELECT path, line::BIGINT AS ordinal, 0::BIGINT AS parent, CASE WHEN block IN ('resource', 'data') THEN 'Resource' WHEN block = 'module' THEN 'Module' ELSE 'Variable' END AS kind,
  CASE block WHEN 'resource' THEN coalesce(b, a) WHEN 'data' THEN 'data.' || coalesce(b, a) WHEN 'output' THEN 'output.' || a ELSE a END AS name, line AS start_line,
  CASE WHEN block IN ('resource', 'data') THEN block || ' "' || a || '" "' || coalesce(b, a) || '"' WHEN block <> 'locals' THEN block || ' "' || a || '"' END AS signature FROM b""")
def extract_terraform_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "terraform", text.terraform_blocks)


@register(f"""{_files("terraform")}, d AS (SELECT path, unnest(regexp_extract_all(content, '\\b((?:var|module|data|local)\\.[\\p{{L}}\\p{{N}}_.]+)', 1)) AS x FROM files)
SELECT path, 0::BIGINT AS ordinal, 'References' AS edge_kind, CASE WHEN x LIKE 'data.%' THEN 'data.' ELSE '' END || split_part(x, '.', 2) AS ref_name, count(*) AS n FROM d GROUP BY ALL""")
def extract_terraform_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, "terraform", text.terraform_refs)


_SQL_LINES = f"""{_files("sql")}, {_LINES},
a AS (SELECT *, nullif(regexp_extract(text, '(?i)CREATE\\s+TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?({_W})', 1), '') AS created, contains(text, ');') AS ends FROM lines),
b AS (SELECT *, CASE WHEN created IS NOT NULL THEN line WHEN ends THEN 0 END AS mark FROM a),
c AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM b),
d AS (SELECT *, CASE WHEN created IS NULL AND open > 0 THEN nullif(regexp_extract(text, '(?i)^\\s+({_W})\\s+(INTEGER|TEXT|VARCHAR|BOOLEAN|TIMESTAMP|UUID|BIGINT|SERIAL|INT|REAL|FLOAT|DOUBLE|DECIMAL|CHAR|BLOB|DATE|TIME|JSON|JSONB)', 1), '') END AS col,
  regexp_extract(text, '(?i)^\\s+({_W})\\s+(INTEGER|TEXT|VARCHAR|BOOLEAN|TIMESTAMP|UUID|BIGINT|SERIAL|INT|REAL|FLOAT|DOUBLE|DECIMAL|CHAR|BLOB|DATE|TIME|JSON|JSONB)', 2) AS type,
  CASE WHEN created IS NULL AND open > 0 THEN nullif(regexp_extract(text, '(?i)REFERENCES\\s+({_W})\\s*\\(({_W})\\)', 1), '') END AS fk FROM c)"""


@register(f"""{_SQL_LINES} SELECT path, line::BIGINT AS ordinal, (CASE WHEN created IS NULL THEN open ELSE 0 END)::BIGINT AS parent, CASE WHEN created IS NULL THEN 'Column' ELSE 'Table' END AS kind, coalesce(created, col) AS name,
line AS start_line, CASE WHEN created IS NULL THEN col || ' ' || type ELSE 'CREATE TABLE ' || created END AS signature FROM d WHERE created IS NOT NULL OR col IS NOT NULL""")
def extract_sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "sql", text.sql_tables)


@register(f"""{_SQL_LINES}, e AS (SELECT *, (col IS NOT NULL)::INT + (NOT ends)::INT AS k FROM d WHERE fk IS NOT NULL)
SELECT path, open::BIGINT AS ordinal, 'References' AS edge_kind, fk AS ref_name, sum(k)::BIGINT AS n FROM e WHERE k > 0 GROUP BY ALL""")
def extract_sql_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, "sql", text.sql_fks)


_RPC = f"'^\\s*rpc\\s+({_W})\\s*\\(({_W})\\)\\s*returns\\s*\\(({_W})\\)'"


@register(f"""{_files("proto")}, {_LINES},
a AS (SELECT *, nullif(regexp_extract(text, '^\\s*message\\s+({_W})', 1), '') AS m, nullif(regexp_extract(text, '^\\s*service\\s+({_W})', 1), '') AS s, nullif(regexp_extract(text, {_RPC}, 1), '') AS r FROM lines),
b AS (SELECT *, coalesce(last_value(CASE WHEN m IS NOT NULL OR s IS NOT NULL THEN line WHEN trim(text) = '}}' THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM a)
SELECT path, line::BIGINT AS ordinal, (CASE WHEN r IS NULL THEN 0 ELSE open END)::BIGINT AS parent, CASE WHEN m IS NOT NULL THEN 'Message' WHEN s IS NOT NULL THEN 'Trait' ELSE 'Function' END AS kind, coalesce(m, s, r) AS name, line AS start_line,
  CASE WHEN m IS NOT NULL THEN 'message ' || m WHEN s IS NOT NULL THEN 'service ' || s ELSE 'rpc ' || r || '(' || regexp_extract(text, {_RPC}, 2) || ') returns (' || regexp_extract(text, {_RPC}, 3) || ')' END AS signature
FROM b WHERE coalesce(m, s, r) IS NOT NULL""")
def extract_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "proto", text.proto_symbols)


@register(f"""{_files("proto")}, {_LINES}, r AS (SELECT path, line, unnest([regexp_extract(text, {_RPC}, 2), regexp_extract(text, {_RPC}, 3)]) AS t FROM lines WHERE regexp_matches(text, {_RPC}))
SELECT path, line::BIGINT AS ordinal, 'TypeRef' AS edge_kind, t AS ref_name, count(*) AS n FROM r GROUP BY ALL""")
def extract_proto_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, "proto", text.proto_refs)


@register(f"""{_files("jinja")}, v AS (SELECT path, unnest(regexp_extract_all(content, '\\{{\\{{\\s*({_W})\\s*\\}}\\}}', 1)) AS x FROM files)
SELECT path, 0::BIGINT AS ordinal, 'References' AS edge_kind, x AS ref_name, count(*) AS n FROM v GROUP BY ALL""")
def extract_jinja_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, "jinja", text.jinja_refs)


@register(f"""{_files("markdown")}, {_LINES},
f AS (SELECT *, (sum((text LIKE '```%')::INT) OVER (PARTITION BY path ORDER BY line)) % 2 = 1 OR text LIKE '```%' AS coded FROM lines),
h AS (SELECT path, line, length(regexp_extract(text, '^(#+) ', 1)) AS level, trim(regexp_replace(regexp_replace(text, '^#+ ', ''), ' #+$', '')) AS name FROM f WHERE NOT coded AND regexp_matches(text, '^#+ '))
SELECT path, line::BIGINT AS ordinal, coalesce((SELECT max(p.line) FROM h p WHERE p.path = h.path AND p.line < h.line AND p.level < h.level), 0)::BIGINT AS parent, 'Section' AS kind, name,
  (CASE WHEN line = 1 THEN 1 ELSE 2 END)::INT AS start_line, repeat('#', level) || ' ' || name AS signature FROM h""")
def extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "markdown", text.markdown_sections)


@register(f"""{_files("markdown")}, l AS (SELECT path, unnest(regexp_extract_all(content, '\\]\\(([^)]+)\\)', 1)) AS url FROM files)
SELECT path, 0::BIGINT AS ordinal, 'LinksTo' AS edge_kind, string_split(url, '/')[-1] AS ref_name, count(*) AS n FROM l WHERE url NOT LIKE 'http%' AND url NOT LIKE '#%' GROUP BY ALL""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, "markdown", text.markdown_links)


_YAML = """SELECT CASE s_suppkey % 8 WHEN 0 THEN 'roles/r' || s_suppkey || '/tasks/main.yml' WHEN 1 THEN 'roles/r' || s_suppkey || '/defaults/main.yml' WHEN 2 THEN 'playbooks/p' || s_suppkey || '.yml' WHEN 3 THEN 'api' || s_suppkey || '/openapi.yaml'
  WHEN 4 THEN 'roles/r' || s_suppkey || '/handlers/main.yml' WHEN 5 THEN 'roles/r' || s_suppkey || '/templates/a.j2' WHEN 6 THEN 'group_vars/g' || s_suppkey || '.yml' ELSE 'notes/n' || s_suppkey || '.yml' END AS path,
CASE s_suppkey % 8 WHEN 0 THEN '- name: Install ' || s_name || '\n  notify: restart\n  shell: "{{ port }} {{ host }}"\n- include_role: {name: r8}\n  name: Db\n- debug: x' WHEN 1 THEN 'port: 1\nhost: x'
WHEN 2 THEN '- name: deploy\n  roles: [r' || (s_suppkey - 2) || ', {role: r0}]\n  tasks:\n    - debug: x\n    - name: last\n- hosts: all' WHEN 3 THEN 'paths:\n  /a/' || s_suppkey || ':\n    get: {}\n    post: {}\ncomponents: {schemas: {S' || s_suppkey || ': {}}}'
WHEN 4 THEN '- debug: x\n- name: restart ' || s_suppkey WHEN 5 THEN 'a={{ port }} b={{ not this }} c={{x' || s_suppkey || '}}' WHEN 6 THEN 'zone: eu\nv' || s_suppkey || ': 1' ELSE '- name: nothing' END AS content FROM supplier"""


def _yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.query(spark, sf_dir, _YAML, ("supplier",))
    return written(yamls.ansible_project(files).unionByName(yamls.openapi_files(files)), "facts")


_YAML_SYMBOLS = """WITH s AS (SELECT s_suppkey AS n, s_name, s_suppkey % 8 AS k FROM supplier), r AS (SELECT * FROM s WHERE k IN (0, 1, 4, 5))
SELECT 'roles/r' || n AS path, 'Role' AS kind, 'r' || n AS name, 1 AS start_line, CAST(NULL AS VARCHAR) AS signature, 'Public' AS visibility, CAST(NULL AS VARCHAR) AS parent FROM r
UNION ALL SELECT 'roles/r' || n || '/tasks/main.yml', 'Task', CASE i WHEN 1 THEN 'Install ' || s_name ELSE 'Db' END, i::INT, NULL, 'Private', 'r' || n FROM s, range(1, 3) t(i) WHERE k = 0
UNION ALL SELECT 'roles/r' || n || '/defaults/main.yml', 'Variable', CASE i WHEN 1 THEN 'port' ELSE 'host' END, i::INT, NULL, 'Private', 'r' || n FROM s, range(1, 3) t(i) WHERE k = 1
UNION ALL SELECT 'playbooks/p' || n || '.yml', 'Task', name, 1, 'play: ' || name, 'Public', NULL FROM s, (VALUES ('deploy'), ('unnamed play')) t(name) WHERE k = 2
UNION ALL SELECT 'playbooks/p' || n || '.yml', 'Task', 'last', 2, NULL, 'Private', 'deploy' FROM s WHERE k = 2
UNION ALL SELECT 'api' || n || '/openapi.yaml', 'File', 'openapi.yaml', 1, NULL, 'Public', NULL FROM s WHERE k = 3
UNION ALL SELECT 'api' || n || '/openapi.yaml', 'Endpoint', m || ' /a/' || n, 1, m || ' /a/' || n, 'Public', 'openapi.yaml' FROM s, (VALUES ('GET'), ('POST')) t(m) WHERE k = 3
UNION ALL SELECT 'api' || n || '/openapi.yaml', 'Message', 'S' || n, 1, NULL, 'Public', 'openapi.yaml' FROM s WHERE k = 3
UNION ALL SELECT 'roles/r' || n || '/handlers/main.yml', 'Handler', 'restart ' || n, 2, NULL, 'Private', 'r' || n FROM s WHERE k = 4
UNION ALL SELECT 'roles/r' || n || '/templates/a.j2', 'Template', 'a.j2', 1, NULL, 'Private', 'r' || n FROM s WHERE k = 5
UNION ALL SELECT 'group_vars/g' || n || '.yml', 'Variable', CASE i WHEN 1 THEN 'zone' ELSE 'v' || n END, i::INT, NULL, 'Public', NULL FROM s, range(1, 3) t(i) WHERE k = 6"""


@register(_YAML_SYMBOLS)
def extract_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Ansible projects and API descriptions, with the names of what contains them."""
    found = _yaml(spark, sf_dir).filter("kind is not null")
    up = found.select(F.col("path").alias("parent_path"), F.col("ordinal").alias("parent"), F.col("name").alias("up"))
    return found.join(up, ["parent_path", "parent"], "left").select("path", "kind", "name", "start_line", "signature", "visibility", F.col("up").alias("parent"))


@register("""WITH s AS (SELECT s_suppkey AS n, s_name, s_suppkey % 8 AS k FROM supplier)
SELECT 'roles/r' || n || '/tasks/main.yml' AS path, CASE WHEN edge_kind = 'Includes' THEN 'Db' ELSE 'Install ' || s_name END AS name, edge_kind, ref_name FROM s, (VALUES ('Notifies', 'restart'), ('References', 'port'), ('References', 'host'), ('Includes', 'r8')) t(edge_kind, ref_name) WHERE k = 0
UNION ALL SELECT 'playbooks/p' || n || '.yml', 'deploy', 'DependsOn', CASE i WHEN 0 THEN 'r0' ELSE 'r' || (n - 2) END FROM s, range(2) t(i) WHERE k = 2
UNION ALL SELECT 'roles/r' || n || '/templates/a.j2', 'a.j2', 'References', CASE i WHEN 0 THEN 'port' ELSE 'x' || n END FROM s, range(2) t(i) WHERE k = 5""")
def extract_yaml_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _yaml(spark, sf_dir)
    names = found.filter("kind is not null").select("path", "ordinal", "name")
    return found.filter("edge_kind is not null").drop("name").join(names, ["path", "ordinal"]).select("path", "name", "edge_kind", "ref_name")


@register(samples.SYMBOLS_SQL)
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files in eleven languages."""
    return code.code(samples.files(spark, sf_dir)).filter("kind is not null").select("path", "ordinal", "parent", "kind", "start_line", "end_line", "visibility", "name", "signature")


def _code_sites(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return code.code(samples.files(spark, sf_dir)).filter(F.col("edge_kind") == kind).select("path", "ordinal", "ref_name")


@register(samples.CALLS_SQL)
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_sites(spark, sf_dir, "Calls")


@register(samples.IMPLEMENTS_SQL)
def extract_implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_sites(spark, sf_dir, "Implements")


# ---- sources -------------------------------------------------------------------------------------

_PROJECTS = """SELECT n_nationkey AS project, CASE s_suppkey % 12 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'sub/setup.py' WHEN 2 THEN 'apps/web/tsconfig.json' WHEN 3 THEN 'src/app.js' WHEN 4 THEN 'README.md' WHEN 5 THEN 'main.tf'
WHEN 6 THEN 'roles/x/y.yml' WHEN 7 THEN 'dist/app.js' WHEN 8 THEN 'src/Main.kt' WHEN 9 THEN 'go.mod' WHEN 10 THEN 'docs/a.md' ELSE 'notes.txt' END AS rel FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@register(f"""WITH f AS ({_PROJECTS}), p AS (SELECT project, bool_or(rel = 'Cargo.toml') AS rust, bool_or(rel = 'apps/web/tsconfig.json') AS typescript, bool_or(rel = 'src/app.js') AS js, bool_or(rel = 'main.tf') AS terraform,
  bool_or(rel = 'roles/x/y.yml') AS ansible, bool_or(rel = 'src/Main.kt') AS kotlin, bool_or(rel = 'go.mod') AS go, count(*) FILTER (rel = 'README.md') AS texts, count(*) FILTER (rel NOT LIKE '%/%') AS root FROM f GROUP BY project),
q AS (SELECT *, rust OR typescript OR js OR terraform OR ansible OR kotlin OR go AS hit FROM p)
SELECT project, unnest(list_filter([CASE WHEN rust THEN 'rust' END, CASE WHEN typescript THEN 'typescript' END, CASE WHEN js AND NOT typescript THEN 'javascript' END, CASE WHEN terraform THEN 'terraform' END, CASE WHEN ansible THEN 'ansible' END,
  CASE WHEN kotlin THEN 'kotlin' END, CASE WHEN go THEN 'go' END, CASE WHEN NOT hit AND root > 0 AND 2 * texts >= root THEN 'markdown' END, CASE WHEN NOT hit AND NOT (root > 0 AND 2 * texts >= root) THEN 'unknown' END], lambda x: x IS NOT NULL)) AS facet FROM q""")
def detect_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.facets(derived.query(spark, sf_dir, _PROJECTS, ("supplier", "nation")), "project")


@register(f"""{_files("code")} SELECT path, path LIKE '%.min.js' OR (octet_length(encode(content)) > 100000 AND substr(content, 1, 4096) NOT LIKE '%' || chr(10) || '%') AS minified FROM files""")
def minified_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.files(spark, sf_dir, "code")
    return files.select("path", C.minified(F.col("path"), F.octet_length("content"), F.col("content")).alias("minified"))


_LANG = " ".join(f"WHEN regexp_extract(path, '\\.([^./]+)$', 1) IN {_in(own) if len(own) > 1 else f'({chr(39)}{own[0]}{chr(39)})'} THEN '{lang}'" for lang, own in LANGUAGES.items())


@register(f"{_files('code')} SELECT path, CASE {_LANG} END AS language FROM files")
def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir, "code").select("path", C.language(F.col("path")).alias("language"))


@register(f"""{_files("code")}, p AS (SELECT path, string_split(substr(path, 6), '/') AS parts FROM files)
SELECT path, len(list_filter(parts[:-2], lambda x: x IN {_in(SCAN_PRUNED)})) > 0 OR len(list_filter(parts, lambda x: x LIKE '.%')) > 0 AS pruned FROM p""")
def scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir, "code").select("path", C.scan_pruned(C.rel_path(F.col("path"), "/lib")).alias("pruned"))


@register(f"""{_files("code")} SELECT path, CASE WHEN path LIKE '%.sql' THEN 'sql' WHEN path LIKE '%.proto' THEN 'protobuf' WHEN path LIKE '%openapi%.yaml' THEN 'openapi' END AS parser FROM files""")
def schema_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir, "code").select("path", C.schema_parser(F.col("path")).alias("parser"))


# ---- change and persistence ----------------------------------------------------------------------

_BEFORE = "SELECT '/e/' || user_id || '/' || event_type AS path, CAST(min(event_id) AS STRING) AS content FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type"
_NOW = "SELECT '/e/' || user_id || '/' || event_type AS path, CAST(min(event_id) AS STRING) AS content FROM events WHERE event_id % 4 <> 0 GROUP BY user_id, event_type"


@register(f"""WITH a AS (SELECT path, md5(content) AS h FROM ({_BEFORE})), b AS (SELECT path, md5(content) AS h FROM ({_NOW}))
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'New' WHEN b.h IS NULL THEN 'Deleted' WHEN a.h = b.h THEN 'Unchanged' ELSE 'Modified' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = (changes.hashes(derived.query(spark, sf_dir, q, ("events",))) for q in (_BEFORE, _NOW))
    return changes.diff(before, now)


_GONE = "FROM nodes WHERE file LIKE '/AFRICA/%'"


@on_graph(f", gone AS (SELECT node_id {_GONE}) SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY kind UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE node_id NOT IN (FROM gone)")
def remove_file(g: Graph) -> DataFrame:
    left = G.remove_files(g, g.nodes.filter("file like '/AFRICA/%'").select(F.col("file").alias("path")))
    return G.edge_counts(left.edges).union(left.nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")))


@on_graph("""
, top AS (SELECT 1 + greatest((SELECT max(node_id) FROM nodes), (SELECT max(edge_id) FROM edges)) AS n)
SELECT 'node' AS part, node_id AS id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, name FROM nodes UNION ALL SELECT 'node', node_id + n, NULL, NULL, name FROM nodes, top
UNION ALL SELECT 'edge', edge_id, src, dst, kind FROM edges UNION ALL SELECT 'edge', edge_id + n, src + n, dst + n, kind FROM edges, top""")
def merge_wing(g: Graph) -> DataFrame:
    """The graph merged with itself: nodes and moved edges."""
    both = G.merge(g, g)
    none = F.lit(None).cast("long")
    nodes = both.nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("id"), none.alias("src"), none.alias("dst"), "name")
    return nodes.union(both.edges.select(F.lit("edge"), "edge_id", "src", "dst", "kind"))


def _regions(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'Module'").select((F.col("node_id") / 8).cast("int").alias("wing_id"), F.col("file").alias("root"))


@on_graph(f"""
, wings AS (SELECT row_number() OVER (ORDER BY r_regionkey)::INT - 1 AS wing_id, '/' || r_name AS root FROM region),
m AS (SELECT wing_id, name, kind, min(node_id) AS node, count(*) AS nodes FROM nodes JOIN wings ON file = root OR starts_with(file, root || '/') WHERE name <> '' GROUP BY ALL),
s AS (SELECT wing_id, count(DISTINCT name) AS n FROM m GROUP BY wing_id),
p AS (SELECT * FROM (VALUES {", ".join(str(p) for p in TUNNEL_PAIRS)}) t(small_kind, large_kind)),
j AS (SELECT a.wing_id AS from_wing, b.wing_id AS to_wing, a.name, a.kind AS from_kind, b.kind AS to_kind, a.node AS from_node, b.node AS to_node, a.nodes AS from_nodes, b.nodes AS to_nodes, x.n <= y.n AS small
  FROM m a JOIN m b ON a.name = b.name AND a.wing_id < b.wing_id JOIN s x ON x.wing_id = a.wing_id JOIN s y ON y.wing_id = b.wing_id)
SELECT j.* EXCLUDE (small) FROM j JOIN p ON CASE WHEN small THEN from_kind ELSE to_kind END = small_kind AND CASE WHEN small THEN to_kind ELSE from_kind END = large_kind""")
def tunnels(g: Graph) -> DataFrame:
    """Classes of tunnels between regions over all nodes."""
    return wings.tunnel_classes(g.nodes, _regions(g))


_FIVE = "string_split(structs, ',')"


@register(f"""WITH st AS ({ORACLE_SQL["stats"]}), mo AS ({ORACLE_SQL["module_rollup"]}), hu AS ({ORACLE_SQL["hubs"]}), ec AS ({ORACLE_SQL["edge_counts"]}),
m AS (SELECT *, row_number() OVER (ORDER BY module) AS k FROM mo),
said AS (SELECT k, module, list_filter([CASE WHEN traits <> '' THEN 'trait:' || traits END, CASE WHEN structs <> '' THEN array_to_string({_FIVE}[:5], ',') || CASE WHEN len({_FIVE}) > 5 THEN '+' || (len({_FIVE}) - 5) ELSE '' END END,
  CASE WHEN fn_count > 0 THEN fn_count || 'fn' || CASE WHEN pub_fn_count BETWEEN 1 AND fn_count - 1 THEN '(' || pub_fn_count || 'pub)' ELSE '' END END, CASE WHEN test_count > 0 THEN test_count || 'tests' END], lambda x: x IS NOT NULL) AS s FROM m WHERE k <= 12),
l AS (SELECT 0 AS part, 0 AS k, 'sample|unknown|' || files || 'f ' || functions || 'fn ' || structs || 'st ' || traits || 'tr ' || enums || 'en ' || CASE WHEN total_lines >= 1000 THEN '~' || total_lines // 1000 || 'kLOC' ELSE '~' || total_lines || 'LOC' END AS text FROM st
UNION ALL SELECT 1, k, '  ' || module || ': ' || array_to_string(s, ' | ') FROM said WHERE len(s) > 0
UNION ALL SELECT 2, 0, '  ...+' || (count(*) - 12) || ' more modules' FROM mo HAVING count(*) > 12
UNION ALL SELECT 3, 0, 'hubs: ' || string_agg(tag || ':' || name || '(' || degree || ')', ' ' ORDER BY degree DESC, name) FROM hu HAVING count(*) > 0
UNION ALL SELECT 4, 0, 'edges: ' || n || ' calls' FROM ec WHERE kind = 'Calls')
SELECT (row_number() OVER (ORDER BY part, k) - 1)::INT AS line_no, text FROM l""")
def boot_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import render

    lines = render.boot(derived.graph(spark, sf_dir), "sample", ["unknown"]).splitlines()
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line_no int, text string")


@register("SELECT * FROM (VALUES ('Contains', true), ('References', true), ('TypeRef', true)) t(kind, equal)")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index that was updated has, by kind, as many edges as one that was built anew, and the same ones."""
    files = derived.files(spark, sf_dir, "sql").unionByName(derived.files(spark, sf_dir, "proto"))
    full = lambda f: f.select("path", F.substring("path", 2, 1000).alias("rel"), C.extension(F.col("path")).alias("ext"), F.octet_length("content").cast("long").alias("bytes"), "content")
    kept = F.xxhash64("path") % 5 != 0
    before = full(files.filter(kept).withColumn("content", F.when(F.xxhash64("path") % 7 == 0, F.lit("-- empty")).otherwise(F.col("content"))))
    now = full(files)
    facts = written(build.extract(before, ["unknown"]), "facts")
    updated, _ = build.incremental(spark, changes.hashes(before), facts, now, ["unknown"])
    a, b = build.build(updated).edges, build.build(build.extract(now, ["unknown"])).edges
    side = lambda t, name: t.groupBy("kind").agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64("src", "dst", "kind"))).alias(name))
    return side(a, "updated").join(side(b, "full"), "kind", "full_outer").select("kind", F.col("updated").eqNullSafe(F.col("full")).alias("equal"))


@register("""WITH e AS (SELECT '/' || event_type || '/' || user_id AS path, value > 10 AS present, epoch_us(ts) AS us FROM events),
w AS (SELECT path, us // 500000 AS w, arg_max(present, (us, present::INT)) AS present, max(us) AS us FROM e GROUP BY ALL)
SELECT path, CASE WHEN present THEN 'Changed' ELSE 'Removed' END AS change, us AS ts_us FROM w""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = events.select(F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"), (F.col("value") > 10).alias("exists"), F.col("ts").cast("timestamp").alias("ts"))
    found = feed.run_available(rows, new_path(spark, "feed"), new_path(spark, "feed-state"))
    return found.select("path", "change", F.unix_micros("ts").alias("ts_us"))


@register(f"SELECT '/' || event_type || '/' || user_id || '/build/x' AS path, false AS kept, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT '/' || event_type || '/' || user_id, true, count(*) FROM events WHERE event_type NOT IN {_in(WATCH_IGNORED)} GROUP BY ALL")
def watch_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    paths = derived.table(spark, sf_dir, "events").select(F.explode(F.array(path, F.concat(path, F.lit("/build/x")))).alias("path"))
    return paths.groupBy("path").agg(F.first(~C.watch_ignored(F.col("path"))).alias("kept"), F.count("*").alias("n"))


@register(ORACLE_SQL["stats"])
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "store")
    store.save(derived.graph(spark, sf_dir), root)
    return G.stats(store.load(spark, root).nodes)
