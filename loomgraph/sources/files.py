"""Source trees as tables of files (path, rel, ext, bytes, content)."""

from __future__ import annotations

import fnmatch
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import extension, hidden, language, minified, scan_pruned, under
from ..model import FORMATS, LANGUAGES, SCAN_PRUNED

FILES = "path string, rel string, ext string, bytes long, content string"


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """All files below ``root`` that aren't empty, by Spark's own listing, for trees in any store; nothing is pruned here.  Content that isn't
    UTF-8 is null."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    base = root.rstrip("/")
    rows = reader.load(base)
    path = F.regexp_replace("path", r"^file:/+", "/")
    plain = base.removeprefix("file://")
    rel = F.when(under(path, plain), F.substring(path, len(plain) + 2, 1 << 20)).otherwise(path)
    content = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select(path.alias("path"), rel.alias("rel"), extension(path).alias("ext"), F.col("length").alias("bytes"), content.alias("content"))


class Ignore:
    """The patterns of one ignore file, relative to its folder."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[bool, bool, bool, str]] = []
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!")
            folder, rule = rule.endswith("/"), rule.rstrip("/")
            self.rules.append((keep, folder, "/" in rule, rule.lstrip("/")))

    def decides(self, rel: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: no rule."""
        verdict = None
        for keep, folder, anchored, rule in self.rules:
            if folder and not is_dir:
                continue
            if anchored:
                hit = fnmatch.fnmatch(rel, rule) or (rule.startswith("**/") and fnmatch.fnmatch(rel.rsplit("/", 1)[-1], rule[3:]))
            else:
                hit = fnmatch.fnmatch(rel.rsplit("/", 1)[-1], rule)
            if hit:
                verdict = not keep
        return verdict


#: Up to this many characters of paths are broadcast; a longer list is joined by a shuffle.
LISTED_BYTES = 16 << 20


def walk(root: str, prune: bool = False) -> list[str]:
    """Paths below ``root`` relative to it, in order: hidden entries and what .gitignore files exclude are left out, and
    with ``prune`` the folders that are never scanned for code."""
    out: list[str] = []

    def visit(folder: Path, rules: list[tuple[Path, Ignore]]) -> None:
        own = folder / ".gitignore"
        if own.is_file():
            rules = [*rules, (folder, Ignore(own.read_text(errors="replace")))]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name.startswith(".") or (prune and entry.is_dir() and entry.name in SCAN_PRUNED):
                continue
            path, ignored = Path(entry.path), False
            for base, ignore in rules:
                verdict = ignore.decides(path.relative_to(base).as_posix(), entry.is_dir())
                ignored = ignored if verdict is None else verdict
            if ignored:
                continue
            if entry.is_dir(follow_symlinks=False):
                visit(path, rules)
            elif entry.is_file():
                out.append(path.relative_to(root).as_posix())

    visit(Path(root), [])
    return out


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), prune: bool = False, paths: list[str] | None = None) -> DataFrame:
    """The files of a local tree as `walk` lists them (or ``paths``, if it did before); what isn't UTF-8 is left out.
    Contents are read by Spark's readers, only the listing is made here."""
    kept = [p for p in (walk(root, prune) if paths is None else paths) if not extensions or p.rsplit(".", 1)[-1] in extensions]
    if not kept:
        return spark.createDataFrame([], FILES)
    base = os.path.abspath(root)
    empty = {p for p in kept if not os.path.getsize(os.path.join(base, p))}  # Spark lists no empty files
    listed = spark.createDataFrame([(p,) for p in kept if p not in empty], "rel string")
    if sum(map(len, kept)) < LISTED_BYTES:
        listed = F.broadcast(listed)
    read = read_tree(spark, base, tuple(sorted({p.rsplit(".", 1)[-1] for p in kept})) if extensions else ())
    # a semi-join of what was read: contents stay where they are while the names are broadcast
    both = read.select("rel", "bytes", "content").filter("content is not null").join(listed, "rel", "left_semi")
    if empty:
        both = both.union(spark.createDataFrame([(p, 0, "") for p in sorted(empty)], "rel string, bytes long, content string"))
    return both.select(F.concat(F.lit(base + "/"), "rel").alias("path"), "rel", extension(F.col("rel")).alias("ext"), F.col("bytes").cast("long").alias("bytes"), "content")


def code_files(files: DataFrame) -> DataFrame:
    """Of (path, rel, bytes, content): files in a known language, outside of pruned folders, not minified."""
    known = files.filter(language(F.col("path")).isNotNull()).filter(~scan_pruned(F.col("rel")))
    return known.filter(~minified(F.col("path"), F.col("bytes"), F.col("content")))


def format_files(files: DataFrame, name: str) -> DataFrame:
    """Files of one of the other formats; no folder is pruned but hidden ones."""
    return files.filter(F.col("ext").isin(*FORMATS[name])).filter(~hidden(F.col("rel")))


CODE_EXTENSIONS = tuple(ext for own in LANGUAGES.values() for ext in own)
#: What some analyzer reads: languages, formats, and the templates of Ansible.
KNOWN_EXTENSIONS = tuple(dict.fromkeys((*CODE_EXTENSIONS, *(ext for own in FORMATS.values() for ext in own), "j2")))
