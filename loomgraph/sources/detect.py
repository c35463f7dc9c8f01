"""What kind of project a set of files is: facets by marker files and extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import extension

# Folders in which neither extensions nor markers count.
SKIPPED = ("target", "node_modules", ".git", "__pycache__", "vendor", "dist", "build", "bin", "obj")
#: Facets in the order in which they are listed.
FACETS = ("rust", "python", "typescript", "javascript", "go", "c", "cpp", "kotlin", "java", "csharp", "ansible", "terraform", "docker", "markdown", "unknown")


def facets(files: DataFrame, project: str | None = None) -> DataFrame:
    """facet (and ``project``, if that column is named) of ``files`` (rel): one pass that gathers booleans."""
    depth = F.size(F.split("rel", "/")) - 1
    name, ext = F.element_at(F.split("rel", "/"), -1), extension(F.col("rel"))
    dirs = F.slice(F.split("rel", "/"), 1, F.greatest(depth, F.lit(0)))
    open_dirs = ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIPPED))
    first = F.coalesce(F.get(F.split("rel", "/"), F.lit(0)), F.lit(""))
    second = F.coalesce(F.get(F.split("rel", "/"), F.lit(1)), F.lit(""))

    def marker(*names: str) -> Column:
        return F.bool_or((depth == 0) & name.isin(*names))

    def deep_marker(*names: str) -> Column:
        return F.bool_or((depth <= 2) & open_dirs & name.isin(*names))

    def root(*exts: str) -> Column:
        return F.bool_or((depth == 0) & F.coalesce(ext.isin(*exts), F.lit(False)))

    def sub(*exts: str) -> Column:
        return F.bool_or((depth == 1) & open_dirs & F.coalesce(ext.isin(*exts), F.lit(False)))

    def src(*exts: str) -> Column:
        below = (depth == 2) & (first == "src") & ~second.startswith(".") & ~second.isin(*SKIPPED)
        return F.bool_or(below & F.coalesce(ext.isin(*exts), F.lit(False)))

    def folder(*names: str) -> Column:
        return F.bool_or((depth > 0) & first.isin(*names))

    typescript = marker("tsconfig.json") | deep_marker("tsconfig.json") | sub("ts", "tsx")
    rules = {
        "rust": marker("Cargo.toml"),
        "python": marker("pyproject.toml", "setup.py", "requirements.txt"),
        "typescript": typescript,
        "javascript": ~typescript & (marker("package.json") | deep_marker("package.json") | sub("js", "jsx")),
        "go": marker("go.mod"),
        "c": marker("CMakeLists.txt", "Makefile", "meson.build") | root("c", "h"),
        "cpp": root("cpp", "cc", "cxx", "hpp"),
        "kotlin": marker("build.gradle", "build.gradle.kts") | root("kt", "kts") | sub("kt") | src("kt"),
        "java": marker("pom.xml") | root("java") | sub("java") | src("java"),
        "csharp": root("sln", "csproj", "cs") | sub("csproj", "cs") | src("csproj", "cs"),
        "ansible": marker("ansible.cfg") | folder("playbooks", "roles"),
        "terraform": root("tf"),
        "docker": marker("Dockerfile", "docker-compose.yml"),
    }
    texts, all_root = F.count_if((depth == 0) & F.coalesce(ext.isin("md", "mdx", "rst"), F.lit(False))), F.count_if(depth == 0)
    group = [project] if project else []
    row = files.groupBy(*group).agg(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()], texts.alias("_texts"), all_root.alias("_root"))
    any_ = F.lit(False)
    for k in rules:
        any_ = any_ | F.col(f"`{k}`")
    markdown = ~any_ & (F.col("_root") > 0) & (2 * F.col("_texts") >= F.col("_root"))
    found = [F.when(F.col(f"`{k}`"), F.lit(k)) for k in rules] + [F.when(markdown, F.lit("markdown")), F.when(~any_ & ~markdown, F.lit("unknown"))]
    return row.select(*group, F.explode(F.array_compact(F.array(*found))).alias("facet"))
