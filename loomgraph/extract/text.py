"""Extraction from line-oriented formats with built-in functions: Terraform, SQL, Protobuf, Markdown, Jinja.

All functions take ``files`` (path, content) and give rows of one schema, see `FACTS`: a symbol has a ``kind``, a
reference from the symbol (path, ordinal) has an ``edge_kind``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import WORD, basename

FACTS = (
    "path string, ordinal long, parent_path string, parent long, kind string, name string, file string, start_line int, end_line int, start_col int, end_col int, "
    "signature string, visibility string, analyzer string, edge_kind string, ref_name string, target_kinds array<string>, seq int"
)
_W = WORD + "+"


def facts(rows: DataFrame, analyzer: str, **columns: Column | str | int | None) -> DataFrame:
    """``rows`` (path, ordinal, ...) in the schema of `FACTS`; what isn't named is null, but for the obvious."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    given.setdefault("file", F.col("path"))
    given.setdefault("start_line", F.lit(None))
    given.setdefault("end_line", given["start_line"])
    given.setdefault("parent_path", F.when(given.get("parent", F.lit(None)).isNotNull(), F.col("path")))
    for c in ("start_col", "end_col"):
        given.setdefault(c, F.when(given.get("kind", F.lit(None)).isNotNull(), 0))
    given["analyzer"] = F.lit(analyzer)
    given.setdefault("path", F.col("path"))
    given.setdefault("ordinal", F.col("ordinal"))
    out = []
    for field in FACTS.split(", "):
        name, kind = field.split(" ", 1)
        out.append(given.get(name, F.lit(None)).cast(kind).alias(name))
    return rows.select(*out)


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of all lines; a final newline ends the last line."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n")
    rows = files.select("path", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "text")


def line_count(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))


def file_nodes(files: DataFrame, analyzer: str, kind: str = "File", visibility: str = "Private", first: int = 1) -> DataFrame:
    last = line_count(F.col("content")) if first else F.greatest(line_count(F.col("content")) - 1, F.lit(0))
    return facts(files, analyzer, ordinal=0, kind=kind, name=basename(F.col("path")), start_line=first, end_line=last, visibility=visibility)


def _found(pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract("text", pattern, group)
    return F.when(got != "", got)


# ---- Terraform -----------------------------------------------------------------------------------

_BLOCK = r'^(resource|data|variable|output|module|locals)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{'


def terraform_blocks(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumns({"block": _found(_BLOCK), "a": _found(_BLOCK, 2), "b": _found(_BLOCK, 3)}).filter("block is not null")
    block, a, n = F.col("block"), F.col("a"), F.coalesce("b", "a")
    kind = F.when(block.isin("resource", "data"), "Resource").when(block == "module", "Module").otherwise("Variable")
    name = F.when(block == "resource", n).when(block == "data", F.concat(F.lit("data."), n)).when(block == "output", F.concat(F.lit("output."), a)).otherwise(a)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    head = F.concat(block, F.lit(" "), quoted(a))
    signature = F.when(block.isin("resource", "data"), F.concat(head, F.lit(" "), quoted(n))).when(block != "locals", head)
    return facts(rows, "terraform", ordinal=F.col("line"), parent=0, kind=kind, name=name, start_line=F.col("line"), signature=signature, visibility="Public")


def terraform_refs(files: DataFrame) -> DataFrame:
    """References of a file in order: var.x, module.x, local.x to x, data.x to data.x."""
    dotted = r"\b((?:var|module|data|local)\.[\p{L}\p{N}_.]+)"
    rows = files.select("path", F.posexplode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(dotted), F.lit(1))).alias("seq", "dotted"))
    short = F.split("dotted", r"\.")[1]
    name = F.when(F.col("dotted").startswith("data."), F.concat(F.lit("data."), short)).otherwise(short)
    return facts(rows, "terraform", ordinal=0, edge_kind="References", ref_name=name, seq=F.col("seq"))


def terraform(files: DataFrame) -> DataFrame:
    return file_nodes(files, "terraform").union(terraform_blocks(files)).union(terraform_refs(files))


# ---- SQL -----------------------------------------------------------------------------------------

_CREATE = rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_W})"
# Column types, by prefix.
_TYPES = "INTEGER|TEXT|VARCHAR|BOOLEAN|TIMESTAMP|UUID|BIGINT|SERIAL|INT|REAL|FLOAT|DOUBLE|DECIMAL|CHAR|BLOB|DATE|TIME|JSON|JSONB"
_COLUMN = rf"(?i)^\s+({_W})\s+({_TYPES})"
_FOREIGN = rf"(?i)REFERENCES\s+({_W})\s*\(({_W})\)"


def _sql_lines(files: DataFrame) -> DataFrame:
    """Lines with the table that is open there (the line of its CREATE; 0: none)."""
    rows = lines(files).withColumns({"created": _found(_CREATE), "ends": F.col("text").contains(");")})
    mark = F.when(F.col("created").isNotNull(), F.col("line")).when(F.col("ends"), 0)
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("mark", mark).withColumn("open", F.coalesce(F.last("mark", True).over(before), F.lit(0)))
    inside = F.col("created").isNull() & (F.col("open") > 0)
    return rows.withColumns({"column": F.when(inside, _found(_COLUMN)), "type": F.when(inside, _found(_COLUMN, 2)), "foreign": F.when(inside, _found(_FOREIGN))})


def sql_tables(files: DataFrame) -> DataFrame:
    """Tables and their columns."""
    rows = _sql_lines(files)
    made = F.col("created").isNotNull()
    name = F.coalesce("created", "column")
    signature = F.when(made, F.concat(F.lit("CREATE TABLE "), name)).otherwise(F.concat_ws(" ", "column", "type"))
    return facts(
        rows.filter("created is not null or column is not null"),
        "schema",
        ordinal=F.col("line"),
        parent=F.when(made, 0).otherwise(F.col("open")),
        kind=F.when(made, "Table").otherwise("Column"),
        name=name,
        start_line=F.col("line"),
        signature=signature,
        visibility=F.when(made, "Public").otherwise("Private"),
    )


def sql_fks(files: DataFrame) -> DataFrame:
    """References of tables.  One on a column's line counts as the column's and as the table's; the table's is lost where the
    line closes the table."""
    rows = _sql_lines(files).filter("foreign is not null").withColumn("n", F.when(F.col("column").isNotNull(), 1).otherwise(0) + F.when(F.col("ends"), 0).otherwise(1))
    each = rows.filter("n > 0").withColumn("k", F.explode(F.expr("sequence(1, n)")))
    return facts(each, "schema", ordinal=F.col("open"), edge_kind="References", ref_name=F.col("foreign"), seq=F.col("line") * 2 + F.col("k"))


def sql(files: DataFrame) -> DataFrame:
    return file_nodes(files, "schema").union(sql_tables(files)).union(sql_fks(files))


# ---- Protobuf ------------------------------------------------------------------------------------

_MESSAGE, _SERVICE = rf"^\s*message\s+({_W})", rf"^\s*service\s+({_W})"
_RPC = rf"^\s*rpc\s+({_W})\s*\(({_W})\)\s*returns\s*\(({_W})\)"


def _proto_lines(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumns({"message": _found(_MESSAGE), "service": _found(_SERVICE), "rpc": _found(_RPC), "takes": _found(_RPC, 2), "gives": _found(_RPC, 3)})
    mark = F.when(F.coalesce("message", "service").isNotNull(), F.col("line")).when(F.trim("text") == "}", 0)
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("mark", mark).withColumn("open", F.coalesce(F.last("mark", True).over(before), F.lit(0)))


def proto_symbols(files: DataFrame) -> DataFrame:
    rows = _proto_lines(files).filter("coalesce(message, service, rpc) is not null")
    message, service = F.col("message").isNotNull(), F.col("service").isNotNull()
    rpc = F.concat(F.lit("rpc "), F.col("rpc"), F.lit("("), F.col("takes"), F.lit(") returns ("), F.col("gives"), F.lit(")"))
    return facts(
        rows,
        "schema",
        ordinal=F.col("line"),
        parent=F.when(message | service, 0).otherwise(F.col("open")),
        kind=F.when(message, "Message").when(service, "Trait").otherwise("Function"),
        name=F.coalesce("message", "service", "rpc"),
        start_line=F.col("line"),
        signature=F.when(message, F.concat(F.lit("message "), "message")).when(service, F.concat(F.lit("service "), "service")).otherwise(rpc),
        visibility="Public",
    )


def proto_refs(files: DataFrame) -> DataFrame:
    rows = _proto_lines(files).filter("rpc is not null").select("path", "line", F.posexplode(F.array("takes", "gives")).alias("seq", "type"))
    return facts(rows, "schema", ordinal=F.col("line"), edge_kind="TypeRef", ref_name=F.col("type"), seq=F.col("seq"))


def proto(files: DataFrame) -> DataFrame:
    return file_nodes(files, "schema").union(proto_symbols(files)).union(proto_refs(files))


# ---- Jinja ---------------------------------------------------------------------------------------

JINJA = rf"\{{\{{\s*({_W})\s*\}}\}}"


def jinja_refs(files: DataFrame) -> DataFrame:
    """The variables of templates, in order."""
    rows = files.select("path", F.posexplode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(JINJA), F.lit(1))).alias("seq", "variable"))
    return facts(rows, "ansible", ordinal=0, edge_kind="References", ref_name=F.col("variable"), seq=F.col("seq"))


# ---- Markdown ------------------------------------------------------------------------------------

_HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+|$)"
_LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def _prose(files: DataFrame) -> DataFrame:
    """Lines outside of code fences, with their heading level and the line breaks within paragraphs before them."""
    rows = lines(files).withColumn("fence", F.col("text").rlike(r"^ {0,3}(```|~~~)"))
    order = W.partitionBy("path").orderBy("line")
    fences = F.sum(F.col("fence").cast("int")).over(order)
    rows = rows.withColumn("coded", F.col("fence") | (fences % 2 == 1))
    level = F.when(~F.col("coded"), F.length(_found(_HEADING)))
    rows = rows.withColumn("level", level)
    plain = ~F.col("coded") & F.col("level").isNull() & (F.trim("text") != "")
    begins = F.col("text").rlike(r"^\s*([-*+>|]|\d+[.)]\s|(-{3,}|\*{3,}|_{3,})\s*$)")
    rows = rows.withColumns({"plain": plain, "goes_on": plain & ~begins})
    soft = (F.col("goes_on") & F.coalesce(F.lag("plain").over(order), F.lit(False))).cast("int")
    rows = rows.withColumn("soft", soft)
    return rows.withColumn("breaks", F.sum("soft").over(order))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections: their line counts line breaks within paragraphs only; the parent is the last heading of a lower level."""
    rows = _prose(files).filter("level is not null")
    title = F.regexp_replace(F.regexp_replace("text", _HEADING, ""), r"(^|[ \t]+)#+[ \t]*$", "")
    for pattern, to in ((r"`[^`]*`", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__|\*|~~)", "")):
        title = F.regexp_replace(title, pattern, to)
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col("level") == k, F.col("line")), True).over(before) for k in range(1, 6)]
    rows = rows.withColumns({"title": F.trim(title), "lasts": F.array(*lasts)})
    parent = F.coalesce(F.array_max(F.slice("lasts", 1, F.col("level") - 1)), F.lit(0))
    return facts(
        rows, "docs", ordinal=F.col("line"), parent=parent, kind="Section", name=F.col("title"), start_line=F.col("breaks") + 1, signature=F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title"), visibility="Private"
    )


def markdown_links(files: DataFrame) -> DataFrame:
    """Links of documents to other files, by file name."""
    rows = _prose(files).filter("not coded").select("path", "line", F.posexplode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(1))).alias("at", "url"))
    rows = rows.filter("not (url like 'http%' or url like '#%')").withColumn("target", basename(F.regexp_replace("url", "/+$", "")))
    return facts(rows, "docs", ordinal=0, edge_kind="LinksTo", ref_name=F.col("target"), seq=F.col("line") * 1000 + F.col("at"))


def markdown(files: DataFrame) -> DataFrame:
    return file_nodes(files, "docs", "Document", "Public").union(markdown_sections(files)).union(markdown_links(files))
