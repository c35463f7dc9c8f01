"""The tool server: JSON-RPC 2.0 over standard input and output, a message a line (the Model Context Protocol's stdio transport).

A client opens with ``initialize``, lists the tools and calls them; a tool's result is a report of `Engine.report`.  Notifications get
no answer.  A line that is no message, an unknown method or a wrong argument gets a JSON-RPC error, and the server goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any, TextIO

from .engine import Engine

VERSION = "2024-11-05"
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602
_TYPES = {"string": str, "integer": int, "boolean": bool}

#: Each tool's description, and its arguments: name -> (type, whether it must be given, meaning, what `Engine.report` calls it or
#: None for its place among the plain arguments).
TOOLS: dict[str, tuple[str, dict[str, tuple[str, bool, str, str | None]]]] = {
    "boot": ("Overview of the project: facets, counts, modules, hubs.", {}),
    "skeleton": ("All symbols by file.", {"path": ("string", False, "folder to show", None), "depth": ("integer", False, "levels to show (3)", "depth")}),
    "compact": (
        "The shortest listing of all symbols.",
        {"path": ("string", False, "folder to show", None), "max_items": ("integer", False, "items to show (500)", "max_items"), "skip_tests": ("boolean", False, "leave out test functions (true)", "skip_tests")},
    ),
    "references": ("Definitions and uses of a symbol.", {"symbol": ("string", True, "name", None)}),
    "dependencies": (
        "What a symbol depends on, or what depends on it.",
        {"symbol": ("string", True, "name", None), "direction": ("string", False, "outgoing (default) or incoming", "direction"), "max_depth": ("integer", False, "steps (5)", "max_depth")},
    ),
    "impact": ("What a change of a symbol would reach.", {"symbol": ("string", True, "name", None), "max_depth": ("integer", False, "steps (10)", "max_depth")}),
    "search": ("Symbols by a part of their name or signature.", {"query": ("string", True, "text to find", None), "sig": ("boolean", False, "look in signatures (false)", "signatures")}),
    "source": ("The lines that define a symbol.", {"symbol": ("string", True, "name", None), "max_lines": ("integer", False, "lines to show (100)", "max_lines")}),
    "callers": ("What calls a symbol.", {"symbol": ("string", True, "name", None)}),
    "summary": ("The symbols of a file and what they call.", {"path": ("string", True, "path below the project's root", None)}),
    "symbols": ("All symbols of a kind.", {"kind": ("string", False, "fn, struct, trait, enum, macro, module, type or all (default)", "kind"), "public_only": ("boolean", False, "public ones only (false)", "public_only")}),
    "implementations": ("What implements a trait.", {"symbol": ("string", True, "name of the trait", None)}),
    "reindex": ("Build the index anew.", {}),
    "tunnels": ("Symbols that projects share.", {}),
}


class Fault(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def listing() -> list[dict]:
    out = []
    for name, (text, own) in TOOLS.items():
        schema = {"type": "object", "properties": {a: {"type": kind, "description": said} for a, (kind, _, said, _) in own.items()}, "required": [a for a, v in own.items() if v[1]]}
        out.append({"name": name, "description": text, "inputSchema": schema})
    return out


def call(engine: Engine, name: Any, given: Any) -> str:
    """The report of tool ``name`` with the arguments ``given``; null is as good as not given."""
    if name not in TOOLS:
        raise Fault(PARAMS, f"Unknown tool '{name}'")
    if not isinstance(given, dict):
        raise Fault(PARAMS, "Arguments must be an object")
    plain, options = [], {}
    for arg, (kind, needed, _, option) in TOOLS[name][1].items():
        value = given.get(arg)
        if value is None:
            if needed:
                raise Fault(PARAMS, f"Missing argument '{arg}'")
            continue
        if type(value) is not _TYPES[kind] or kind == "integer" and value < 0:
            raise Fault(PARAMS, f"Argument '{arg}' must be a{'n' if kind == 'integer' else ''} {kind}")
        if arg == "direction" and value not in ("outgoing", "incoming"):
            raise Fault(PARAMS, "Argument 'direction' must be outgoing or incoming")
        if option:
            options[option] = value
        else:
            plain.append(value)
    return engine.report(name, *plain, **options)


def answer(engine: Engine, message: Any) -> dict | None:
    """The response to one message, None to a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": REQUEST, "message": "Not a request"}}
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params") or {}
    try:
        if not isinstance(params, dict):
            raise Fault(PARAMS, "Parameters must be an object")
        if method == "initialize":
            result: dict = {"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": listing()}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": call(engine, params.get("name"), params.get("arguments") or {})}], "isError": False}
        else:
            raise Fault(METHOD, f"Unknown method '{method}'")
    except Fault as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    """Answer each line until the input ends."""
    for line in filter(str.strip, lines):
        try:
            response = answer(engine, json.loads(line))
        except json.JSONDecodeError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
        if response is not None:
            out.write(json.dumps(response, ensure_ascii=False) + "\n")
            out.flush()
