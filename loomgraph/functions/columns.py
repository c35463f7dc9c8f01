"""Column expressions over paths, names and signatures.  All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import KINDS, LANGUAGES, OVERVIEW_IGNORED, SCAN_PRUNED, TRANSPARENT_DIRS, WATCH_IGNORED

#: A word character as in Unicode; the same in Java's and RE2's expressions.
WORD = r"[\p{L}\p{N}_]"


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return pairs[key] if default is None else F.coalesce(pairs[key], default)


def label(kind: Column) -> Column:
    return lookup(kind, {k: v[0] for k, v in KINDS.items()})


def short_tag(kind: Column) -> Column:
    return lookup(kind, {k: v[1] for k, v in KINDS.items()})


def span_lines(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def loc_display(lines: Column) -> Column:
    return F.when(lines >= 1000, F.concat(F.lit("~"), F.floor(lines / 1000).cast("string"), F.lit("kLOC"))).otherwise(F.concat(F.lit("~"), lines.cast("string"), F.lit("LOC")))


# ---- paths ---------------------------------------------------------------------------------------


def parts(path: Column) -> Column:
    """A path's components; sorting by them sorts paths as a file tree."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def under(path: Column, prefix: Column | str) -> Column:
    """Whether a path is ``prefix`` or below it, by whole components."""
    p = F.rtrim(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("/"))
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


def ends_with_path(path: Column, suffix: str) -> Column:
    return (path == suffix) | path.endswith("/" + suffix.lstrip("/"))


def rel_path(path: Column, root: Column | str) -> Column:
    """The path below ``root``; paths elsewhere stay."""
    r = F.concat(F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(r), F.substring(path, F.length(r) + 1, F.length(path))).otherwise(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or if that dot begins the name."""
    found = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    return F.when(found != "", found)


def module_name(rel: Column) -> Column:
    """The first directory that isn't merely structural, else the file's name up to its first dot."""
    own = parts(rel)
    dirs = F.filter(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda x: ~x.isin(*TRANSPARENT_DIRS))
    stem = F.substring_index(F.element_at(own, -1), ".", 1)
    return F.when(F.size(own) == 0, F.lit("root")).otherwise(F.coalesce(F.get(dirs, F.lit(0)), stem))


def overview_skips(rel: Column) -> Column:
    return rel.contains("fixture") | rel.contains("/target/") | F.coalesce(F.get(parts(rel), F.lit(0)).isin(*OVERVIEW_IGNORED), F.lit(False))


def overview_test(rel: Column) -> Column:
    return rel.contains("test") | rel.contains("spec") | rel.contains("bench")


def test_file(path: Column) -> Column:
    out = F.lit(False)
    for x in ("/test", "/spec", "/fixture", "/bench"):
        out = out | path.contains(x)
    for x in ("_test.go", "_test.rs", ".test.ts", ".spec.ts", "_test.py", "test_.py"):
        out = out | path.endswith(x)
    return out


def test_function(name: Column) -> Column:
    return name.startswith("test_") | name.startswith("Test") | name.endswith("_test")


def watch_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in WATCH_IGNORED]))


def scan_pruned(rel: Column) -> Column:
    """Whether a directory on the way to the file is hidden or never scanned for code, or the file is hidden."""
    own = F.split(rel, "/")
    dirs = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in SCAN_PRUNED])) | hidden(rel)


def hidden(rel: Column) -> Column:
    return F.exists(F.split(rel, "/"), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def minified(path: Column, size: Column, content: Column) -> Column:
    """Bundled or minified by name, or large with very long lines at its beginning (measured in bytes)."""
    name = basename(path)
    by_name = F.lit(False)
    for x in (".min.js", ".min.css", ".min.mjs", ".bundle.js", "-bundle.js", ".chunk.js"):
        by_name = by_name | name.endswith(x)
    head = F.substring(content.cast("binary"), 1, 4096)
    breaks = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\n]", ""))
    lines = breaks + F.when(F.decode(head, "ISO-8859-1").endswith("\n"), 0).otherwise(1)
    return by_name | ((size > 100_000) & (F.floor(F.octet_length(head) / F.greatest(lines, F.lit(1))) > 500))


def language(path: Column) -> Column:
    return lookup(extension(path), {ext: lang for lang, own in LANGUAGES.items() for ext in own})


def schema_parser(path: Column) -> Column:
    """Which schema parser takes a file; null for none."""
    ext, name = extension(path), F.lower(basename(path))
    api = ext.isin("yml", "yaml") & (name.contains("openapi") | name.contains("swagger"))
    return F.when(ext == "sql", "sql").when(ext == "proto", "protobuf").when(api, "openapi")


# ---- names and signatures ------------------------------------------------------------------------


def last_segment(name: Column) -> Column:
    """What follows the last ``::`` and then the last dot."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def shorten_paths(s: Column) -> Column:
    return F.regexp_replace(s, WORD + "+::", "")


def byte_cut(s: Column, most: int, keep: int) -> Column:
    """Texts of over ``most`` UTF-8 bytes: the characters that fit in ``keep`` bytes, and three dots."""
    prefix = F.substring(s.cast("binary"), 1, keep + 1)
    # a byte 10xxxxxx after the cut means that the cut is inside a character: go back to its first byte
    chars = F.length(F.regexp_replace(F.decode(prefix, "ISO-8859-1"), "[\\x80-\\xbf]", ""))
    ends = F.octet_length(F.substring(s, F.lit(1), chars))
    fits = F.when(ends <= keep, chars).otherwise(chars - 1)
    return F.when(F.octet_length(s) > most, F.concat(F.substring(s, F.lit(1), fits), F.lit("..."))).otherwise(s)


def compress_signature(sig: Column) -> Column:
    """One line, without keywords, path prefixes and self, of 120 bytes at most."""
    lines = F.split(F.regexp_replace(sig, "\r?\n$", ""), "\r?\n")
    s = F.array_join(F.transform(lines, lambda x: F.trim(x)), " ")
    for x in ("pub fn ", "pub async fn ", "async fn ", "fn ", "pub "):
        s = F.replace(s, F.lit(x), F.lit(""))
    s = shorten_paths(s)
    for old, new in (("(&self, ", "("), ("(&self)", "()"), ("(&mut self, ", "(&mut, "), ("(&mut self)", "(&mut)"), ("(mut self, ", "(mut, "), ("(mut self)", "(mut)")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return byte_cut(s, 120, 117)


def search_score(name: Column, query: str) -> Column:
    """0: the name itself, 1: it begins so in any case, 2: it contains it in any case, null: neither."""
    q = query.lower()
    return F.when(name == query, 0).when(F.lower(name).startswith(q), 1).when(F.lower(name).contains(q), 2)
