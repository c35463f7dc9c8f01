"""Extraction from YAML: Ansible projects and OpenAPI descriptions.  A file is parsed where its row is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import FACTS

_JINJA = re.compile(r"\{\{\s*(\w+)\s*\}\}")
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in FACTS.split(", ")])


def symbol(path: str, ordinal: int, kind: str, name: str, line: int, end: int | None = None, *, parent: tuple[str, int] | None = None, signature: str | None = None, visibility: str = "Private", file: str | None = None, analyzer: str) -> dict:
    up = parent or (None, None)
    return dict(path=path, ordinal=ordinal, parent_path=up[0], parent=up[1], kind=kind, name=name, file=file or path, start_line=line, end_line=line if end is None else end, start_col=0, end_col=0, signature=signature, visibility=visibility, analyzer=analyzer)


def reference(path: str, ordinal: int, edge_kind: str, name: str, seq: int, analyzer: str, target_kinds: list[str] | None = None) -> dict:
    return dict(path=path, ordinal=ordinal, edge_kind=edge_kind, ref_name=name, seq=seq, analyzer=analyzer, target_kinds=target_kinds)


def apply(files: DataFrame, extract: Callable[[str, str], list[dict]]) -> DataFrame:
    """Rows of `FACTS` that ``extract`` (path, content) gives for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = extract(path, content or "")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("path", "content").mapInArrow(run, FACTS)


def _load(content: str):
    import yaml

    try:
        return yaml.safe_load(content)
    except (yaml.YAMLError, ValueError, TypeError, KeyError, RecursionError):  # impossible dates, odd keys, deep nesting: the file is skipped
        return None


def _dicts(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _name(value) -> str | None:
    return value if isinstance(value, str) else None


def openapi(path: str, content: str) -> list[dict]:
    """Endpoints (METHOD /path) and schemas."""
    doc = _load(content)
    out = [symbol(path, 0, "File", path.rsplit("/", 1)[-1], 1, len(content.splitlines()), visibility="Public", analyzer="schema")]
    if not isinstance(doc, dict):
        return []
    add = lambda kind, name, sig: out.append(symbol(path, len(out), kind, name, 1, parent=(path, 0), signature=sig, visibility="Public", analyzer="schema"))
    for endpoint, methods in (doc.get("paths") or {}).items() if isinstance(doc.get("paths"), dict) else ():
        for method in methods if isinstance(methods, dict) else ():
            add("Endpoint", n := f"{str(method).upper()} {endpoint}", n)
    components = doc.get("components")
    schemas = components.get("schemas") if isinstance(components, dict) and "schemas" in components else doc.get("definitions")
    for name in schemas if isinstance(schemas, dict) else ():
        add("Message", str(name), None)
    return out


def ansible(path: str, content: str) -> list[dict]:
    """A file of an Ansible project, path relative to its root.  Its role is a symbol of the role's folder."""
    parts = path.split("/")
    if len(parts) >= 3 and parts[0] == "roles":
        role = "/".join(parts[:2])
        out = [symbol(role, 0, "Role", parts[1], 1, visibility="Public", analyzer="ansible")]
        place = "/".join(parts[2:])
        if place in ("tasks/main.yml", "handlers/main.yml"):
            kind = "Task" if parts[2] == "tasks" else "Handler"
            tasks = _load(content)
            for i, task in enumerate(tasks if isinstance(tasks, list) else []):
                if isinstance(task, dict) and _name(task.get("name")):
                    out.append(symbol(path, i + 1, kind, task["name"], i + 1, parent=(role, 0), analyzer="ansible"))
                    if kind == "Task":
                        out += _task_refs(path, i + 1, task)
        elif place == "defaults/main.yml":
            doc = _load(content)
            for i, key in enumerate(doc if isinstance(doc, dict) else ()):
                if _name(key):
                    out.append(symbol(path, i + 1, "Variable", key, i + 1, parent=(role, 0), analyzer="ansible"))
        elif parts[2] == "templates" and len(parts) == 4 and path.endswith(".j2"):
            out.append(symbol(path, 1, "Template", parts[3], 1, parent=(role, 0), analyzer="ansible"))
            out += [reference(path, 1, "References", x, k, "ansible") for k, x in enumerate(_JINJA.findall(content))]
        return out
    out = []
    if len(parts) == 2 and path.endswith((".yml", ".yaml")):
        if parts[0] == "group_vars":
            doc = _load(content)
            for i, key in enumerate(doc if isinstance(doc, dict) else ()):
                if _name(key):
                    out.append(symbol(path, i + 1, "Variable", key, i + 1, visibility="Public", analyzer="ansible"))
        elif parts[0] == "playbooks":
            for play in _dicts(_load(content)):
                own, name = len(out) + 1, _name(play.get("name")) or "unnamed play"
                out.append(symbol(path, own, "Task", name, 1, signature=f"play: {name}", visibility="Public", analyzer="ansible"))
                for k, role in enumerate(play.get("roles") if isinstance(play.get("roles"), list) else ()):
                    target = _name(role) or (_name(role.get("role")) if isinstance(role, dict) else None)
                    if target:
                        out.append(reference(path, own, "DependsOn", target, k, "ansible"))
                for i, task in enumerate(play.get("tasks") if isinstance(play.get("tasks"), list) else ()):
                    if isinstance(task, dict) and _name(task.get("name")):
                        out.append(symbol(path, len(out) + 1, "Task", task["name"], i + 1, parent=(path, own), analyzer="ansible"))
    return out


def _task_refs(path: str, ordinal: int, task: dict) -> list[dict]:
    out: list[dict] = []
    add = lambda kind, name: out.append(reference(path, ordinal, kind, name, len(out), "ansible"))
    if _name(task.get("notify")):
        add("Notifies", task["notify"])

    def strings(x) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from (*strings(k), *strings(v))
        elif isinstance(x, list):
            for v in x:
                yield from strings(v)
        elif isinstance(x, str):
            yield x

    for text in strings(task):
        for variable in _JINJA.findall(text):
            add("References", variable)
    include = task.get("include_role") or task.get("import_role")
    if isinstance(include, dict) and _name(include.get("name")):
        add("Includes", include["name"])
    return out


def ansible_project(files: DataFrame) -> DataFrame:
    """Facts of a project's files (paths relative to its root); a role's row comes once."""
    return apply(files, ansible).dropDuplicates(["path", "ordinal", "edge_kind", "ref_name", "seq"])


def openapi_files(files: DataFrame) -> DataFrame:
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return apply(files.filter(name.rlike(r"\.ya?ml$") & (name.contains("openapi") | name.contains("swagger"))), openapi)
