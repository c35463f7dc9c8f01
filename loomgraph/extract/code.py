"""Extraction from source code of eleven languages.

Python files go through its own parser.  For the others a scanner blanks out comments and strings (keeping all positions), finds
declaration headers by the patterns of the language, matches braces, and nests what it found by position.  It
needs no grammar, so what a parser would tell apart by context alone may be missed; nothing depends on file order.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import language, minified
from ..model import LANGUAGES
from .yamls import apply, reference, symbol

_COMMENT = r"//[^\n]*|/\*.*?\*/"
_DOUBLE, _TRIPLE = r'"(?:\\.|[^"\\\n])*"', r'""".*?"""'
_CHAR = r"'(?:\\[^\n']{1,8}|[^'\\\n])'"
#: Comments and strings by language; the longest kinds of strings first.
_BLANK = {
    "rust": rf'{_COMMENT}|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|{_CHAR}',
    "go": rf"{_COMMENT}|`[^`]*`|{_DOUBLE}|{_CHAR}",
    "c": rf"{_COMMENT}|{_DOUBLE}|{_CHAR}",
    "cpp": rf'{_COMMENT}|R"\((?:.*?)\)"|{_DOUBLE}|{_CHAR}',
    "kotlin": rf"{_COMMENT}|{_TRIPLE}|{_DOUBLE}|{_CHAR}",
    "java": rf"{_COMMENT}|{_TRIPLE}|{_DOUBLE}|{_CHAR}",
    "csharp": rf'{_COMMENT}|{_TRIPLE}|\$?@"(?:""|[^"])*"|{_DOUBLE}|{_CHAR}',
    "typescript": rf"{_COMMENT}|`(?:\\.|[^`\\])*`|{_DOUBLE}|'(?:\\.|[^'\\\n])*'",
}
_MODIFIERS = {
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|synchronized|native|default|strictfp)\s+)*",
    "csharp": r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|unsafe|new|required|file|ref)\s+)*",
    "kotlin": r"(?:(?:public|private|protected|internal|open|abstract|sealed|final|data|inner|inline|value|suspend|override|operator|infix|tailrec|external|actual|expect|companion|annotation|fun(?=\s+interface))\s+)*",
}
#: A type stands on one line, so that long lists of values are read once.
_TYPE = r"[\w.:<>\[\],?&* \t]+?"
#: Where a member may begin: on a line of its own or after another's end.
_MEMBER = r"(?:(?m:^)|(?<=[{};]))[ \t]*"
#: (kind, pattern with the name as its last group that matched).  ``enum`` and ``interface`` classes come before plain ones.
_HEADERS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("Function", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*\bfn\s+(\w+)"),
        ("Struct", r"(?:pub(?:\([^)]*\))?\s+)?\b(?:struct|union)\s+(\w+)"),
        ("Trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+(\w+)"),
        ("Enum", r"(?:pub(?:\([^)]*\))?\s+)?\benum\s+(\w+)"),
        ("Impl", r"(?m:^[ \t]*)(?:unsafe\s+)?\bimpl\b"),
        ("Macro", r"\bmacro_rules!\s*(\w+)"),
    ],
    "go": [
        ("Function", r"(?m:^)func\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(?=\()"),
        ("Struct", r"(?m:^[ \t]*)(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct(?=\s*\{)"),
        ("Trait", r"(?m:^[ \t]*)(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface(?=\s*\{)"),
    ],
    "c": [
        ("Function", r"(?m:^)(?!\s*(?:else|return|typedef)\b)[A-Za-z_][\w \t*]*?[\s*](\w+)\s*(?=\([^;{}]*\)\s*\{)"),
        ("Struct", r"\b(?:struct|union)\s+(\w+)(?=\s*\{)"),
        ("Enum", r"\benum\s+(\w+)(?=\s*\{)"),
        ("Macro", r"(?m:^[ \t]*)#[ \t]*define[ \t]+(\w+)"),
    ],
    "cpp": [
        ("Function", r"(?m:^[ \t]*)(?!(?:else|return|typedef|if|for|while|switch|catch|do|new|delete)\b)(?:template\s*<[^>]*>\s*)?(?:[A-Za-z_][\w:<>,&*~ \t]*?[\s*&])?((?:\w+::)*~?\w+)\s*(?=\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?\{)"),
        ("Struct", r"\b(?<!enum )(?:struct|class|union)\s+(\w+)(?=[^;{}()=]*\{)"),
        ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(\w+)(?=[^;{}()]*\{)"),
        ("Macro", r"(?m:^[ \t]*)#[ \t]*define[ \t]+(\w+)"),
    ],
    "kotlin": [
        ("Trait", _MODIFIERS["kotlin"] + r"\binterface\s+(\w+)"),
        ("Enum", _MODIFIERS["kotlin"] + r"\benum\s+class\s+(\w+)"),
        ("Struct", _MODIFIERS["kotlin"] + r"\b(?<!enum )(?:class|object)\s+(\w+)"),
        ("Function", _MODIFIERS["kotlin"] + r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(\w+)(?=\s*\()"),
    ],
    "java": [
        ("Trait", _MODIFIERS["java"] + r"@?\binterface\s+(\w+)"),
        ("Enum", _MODIFIERS["java"] + r"\benum\s+(\w+)"),
        ("Struct", _MODIFIERS["java"] + r"\b(?:class|record)\s+(\w+)"),
        ("Function", _MEMBER + r"(?!\s*(?:return|else|new|throw|package|import|case)\b)" + _MODIFIERS["java"] + rf"(?:<[^>]*>\s*)?(?:{_TYPE}\s)?(\w+)\s*(?=\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w.,\s]+)?[{{;])"),
    ],
    "csharp": [
        ("Trait", _MODIFIERS["csharp"] + r"\binterface\s+(\w+)"),
        ("Enum", _MODIFIERS["csharp"] + r"\benum\s+(\w+)"),
        ("Struct", _MODIFIERS["csharp"] + r"\b(?:class|struct|record(?:\s+(?:class|struct))?)\s+(\w+)"),
        ("Function", _MEMBER + r"(?!\s*(?:return|else|new|throw|using|await|case|yield|namespace|var)\b)" + _MODIFIERS["csharp"] + rf"(?:{_TYPE}\s)?(\w+)\s*(?:<[^>()]*>)?\s*(?=\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:where\s[^{{;]+)?(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:\{{|=>|;))"),
    ],
    "typescript": [
        ("Trait", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?\binterface\s+(\w+)"),
        ("Enum", r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?\benum\s+(\w+)"),
        ("Struct", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?\bclass\s+(\w+)"),
        ("Function", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?\bfunction\s*\*?\s*(\w+)"),
        ("Function", r"(?m:^[ \t]+)(?!(?:if|for|while|switch|catch|return|function|new|await|throw|else|do)\b)(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*\*?\s*(#?\w+)\s*(?:<[^>()]*>)?(?=\([^;{}]*\)\s*(?::[^;{}=]+)?\{)"),
    ],
}
for _like in ("tsx", "javascript"):
    _HEADERS[_like], _BLANK[_like] = _HEADERS["typescript"], _BLANK["typescript"]
_CALL = re.compile(r"(?<![\w$#@])((?:[A-Za-z_$][\w$]*\s*(?:::(?:<[^>()]*>::)?|\?\.|->|!{0,2}\.)\s*)*)([A-Za-z_$][\w$]*)\s*(?:::<[^>()]*>|<[\w\s,.<>?\[\]]*>)?\s*(?=\()")
#: Words that a parenthesis may follow without a call, in all languages and in each.
_WORDS = {
    "": "if for while switch match return catch function sizeof typeof super this new do else throw await yield try",
    "rust": "fn in as move where impl let ref self Self loop unsafe pub dyn mut crate",
    "go": "func go defer select range type var const chan map interface struct case package import",
    "c": "struct union enum alignof defined __attribute__ _Static_assert case goto",
    "cpp": "struct class union enum alignof decltype static_assert noexcept operator template delete throw case co_await co_return co_yield",
    "kotlin": "when fun is in as val var constructor init class object",
    "java": "assert synchronized case class record interface enum",
    "csharp": "lock fixed using nameof default when is in as base checked unchecked foreach case class struct record interface enum var where not and or get set",
    "typescript": "of in instanceof delete void import export async case class enum interface const let var constructor",
}
_NO_CALL = {lang: frozenset((_WORDS[""] + " " + own).split()) for lang, own in _WORDS.items() if lang}
_NO_CALL["tsx"] = _NO_CALL["javascript"] = _NO_CALL["typescript"]
_CONSTRUCTED = re.compile(r"\bnew\s+([\w.]+)")
_IMPL = re.compile(r"impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(?:(!?[\w:]+(?:<[^{}]*?>)?)\s+for\s+)?&?(?:'\w+\s+)?(?:mut\s+)?(?:dyn\s+)?([\w:]+)")
_BASES = {
    "java": re.compile(r"\b(?:extends|implements|permits)\s+([\w.<>,\s]+?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)"),
    "csharp": re.compile(r":\s*([\w.<>,\s]+?)(?=\bwhere\b|$)"),
    "kotlin": re.compile(r":\s*([\w.<>,()\s]+)$"),
    "typescript": re.compile(r"\b(?:extends|implements)\s+([\w.<>,\s]+?)(?=\bextends\b|\bimplements\b|$)"),
}


@dataclass
class Found:
    kind: str
    name: str
    start: int  # of the header
    end: int  # after the body
    body: int  # of the opening brace, or -1
    header: str
    implements: list[str] = field(default_factory=list)


def byte_cut(text: str, most: int) -> str:
    """Texts of over ``most`` bytes up to the last whole character within them, and three dots."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


def blanked(source: str, lang: str) -> str:
    return re.sub(_BLANK[lang], lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def braces(text: str) -> dict[int, int]:
    """Opening brace -> its closing one (or the end)."""
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs | {k: len(text) for k in stack}


_GOES_ON = re.compile(r"\s*[{:=]")


def _after_header(text: str, at: int, lang: str) -> tuple[int, int]:
    """(position of the body's brace or -1, end without a body) of a header that ends at ``at``."""
    depth, k, last = 0, at, text[at - 1]
    while k < len(text):
        c = text[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                return -1, k
        elif depth == 0 and c == "{":
            return k, k
        elif depth == 0 and (c == ";" or c == "}"):
            return -1, k + (c == ";")
        elif depth == 0 and c == "=" and lang in ("kotlin", "csharp") and text[k - 1] not in "<>!=":
            end = re.compile(r";" if lang == "csharp" else r"\n(?!\s*[.?:&|+])").search(text, k)
            return -1, end.start() if end else len(text)
        elif depth == 0 and c == "\n" and lang == "kotlin" and not _GOES_ON.match(text, k) and last not in ",:(":
            return -1, k
        if not c.isspace():
            last = c
        k += 1
    return -1, len(text)


def _names(bases: str) -> list[str]:
    """The type names of a base list, without arguments and paths."""
    flat = bases
    while re.search(r"<[^<>]*>|\([^()]*\)", flat):
        flat = re.sub(r"<[^<>]*>|\([^()]*\)", "", flat)
    return [n for x in flat.split(",") if (n := re.split(r"::|\.", x.strip())[-1].strip()) and re.fullmatch(r"\w+", n)]


def scan(source: str, lang: str) -> list[Found]:
    text = blanked(source, lang)
    pairs, found, taken = braces(text), [], set()
    for kind, pattern in _HEADERS[lang]:
        for m in re.finditer(pattern, text):
            name = m[m.lastindex].strip() if m.lastindex else ""
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            at = m.end(m.lastindex) if m.lastindex else m.end()
            if at in taken or (name in _NO_CALL[lang] and name != "constructor"):
                continue
            if kind == "Macro":
                body, end = (text.find("{", at), 0) if lang == "rust" else (-1, text.find("\n", at))
                while lang != "rust" and end > 0 and source[end - 1] == "\\":
                    end = text.find("\n", end + 1)
                end = pairs.get(body, body) + 1 if body >= 0 else len(text) if end < 0 else end + (lang != "rust")  # a definition takes its newline
                found.append(Found(kind, name, start, end, body, source[start:end]))
                taken.add(at)
                continue
            body, end = _after_header(text, at, lang)
            header = text[start : body if body >= 0 else end]
            if lang == "rust" and kind == "Function" and body < 0:
                continue
            if kind in ("Struct", "Enum") and body < 0 and lang not in ("kotlin", "java", "csharp") and not (lang == "rust" and kind == "Struct" and "(" in header):
                continue
            if lang == "kotlin" and kind == "Struct" and body < 0 and "(" not in header and not re.search(r"\bobject\b", header):
                continue
            one = Found(kind, name, start, pairs.get(body, body) + 1 if body >= 0 else end, body, header)
            if kind == "Impl":
                parsed = _IMPL.search(header)
                if not parsed:
                    continue
                one.name = parsed[2].split("::")[-1]
                one.implements = _names(parsed[1].lstrip("!")) if parsed[1] else []
            elif kind in ("Struct", "Enum", "Trait") and lang in ("java", "csharp", "kotlin"):
                tail = re.sub(r"^.*?\b" + re.escape(name), "", header, count=1, flags=re.S)
                tail = re.sub(r"^\s*(?:<[^>]*>)?\s*(?:\((?:[^()]|\([^()]*\))*\))?", "", tail) if lang != "java" else re.sub(r"^\s*\((?:[^()]|\([^()]*\))*\)", "", tail)
                one.implements = [n for b in _BASES[lang].finditer(tail.strip()) for n in _names(b[1])]
            taken.add(at)
            found.append(one)
    if lang in ("typescript", "tsx", "javascript"):
        found += _arrows(text, pairs)
    found.sort(key=lambda f: (f.start, -f.end))
    if lang in ("java", "csharp"):  # a call that looks like a declaration lies in a function or outside of types
        types = [f for f in found if f.kind in ("Struct", "Trait", "Enum")]
        found = [f for f in found if f.kind != "Function" or not _listed(f) and (f.body >= 0 or "=>" in source[f.start : f.end] or _declared(f)) and any(t.body >= 0 and t.body < f.start < t.end for t in types)]
        found = [f for f in found if not (f.kind == "Function" and f.body < 0 and any(g is not f and g.kind == "Function" and g.body >= 0 and g.body < f.start < g.end for g in found))]
    return [v for f in found for v in (f, *(_variants(f, text, lang) if f.kind == "Enum" and f.body >= 0 else ()))]


def _declared(f: Found) -> bool:
    """Whether a header without a body has a type before its name (or is one of a type's modifiers)."""
    return len(f.header[: f.header.find("(")].split()) >= 2


def _listed(f: Found) -> bool:
    """Whether a comma stands before the name: then it is one of an enum's constants."""
    before = f.header[: f.header.find("(")].split()[:-1]
    return bool(before) and before[-1].endswith(",")


def _arrows(text: str, pairs: dict[int, int]) -> list[Found]:
    out = []
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^>()]*>\s*)?(?:\([^;{}]*?\)|\w+)\s*(?::\s*[^=;{}]+)?=>\s*(\{)?", text):
        body = m.start(2) if m[2] else -1
        end = pairs.get(body, body) + 1 if m[2] else line if (line := text.find("\n", m.end())) >= 0 else len(text)
        out.append(Found("Function", m[1], m.start(), end, body if m[2] else m.end(), text[m.start() : m.end()]))
    return out


def _variants(enum: Found, text: str, lang: str) -> list[Found]:
    if lang in ("typescript", "tsx", "javascript"):
        return []  # members of these enums have no name of their own in the graph
    out, depth, at = [], 0, enum.body + 1
    end = enum.end - 1
    parts, start = [], at
    for k in range(at, end):
        c = text[k]
        depth += (c in "({[") - (c in ")}]")
        if c == "," and depth == 0:
            parts.append((start, k))
            start = k + 1
        elif c == ";" and depth == 0 and lang in ("java", "kotlin"):  # members follow
            end = k
            break
    parts.append((start, end))
    for a, b in parts:
        m = re.match(r"(?:\s|#\[(?:[^\[\]]|\[[^\]]*\])*\]|\[[^\]]*\]|@\w+(?:\([^)]*\))?)*([A-Za-z_]\w*)", text[a:b])
        if m:
            out.append(Found("EnumVariant", m[1], a + m.start(1), b, -1, text[a:b]))
    return out


def _body_start(f: Found, text: str) -> int:
    """Where a function's own code begins: at its brace, else after the = or => of its header."""
    if f.body >= 0:
        return f.body
    depth = 0
    for k in range(f.start, f.end):
        depth += (text[k] in "([<") - (text[k] in ")]>" and text[k - 1] not in "=-")
        if text[k] == "=" and depth <= 0:
            return k
    return f.end


def visibility(f: Found, lang: str, inside_trait: bool) -> str:
    head = f.header[: f.header.find("(")] if "(" in f.header and lang != "rust" else f.header
    words = set(re.findall(r"\w+", head))
    if lang == "rust":
        m = re.match(r"\s*pub\b(\s*\(\s*(?:crate|super|in\b[^)]*|self)\s*\))?", f.header)
        return "Private" if not m else "Crate" if m[1] else "Public"
    if lang == "go":
        return "Public" if f.name[:1].isupper() else "Private"
    if lang in ("c", "cpp"):
        return "Private" if "static" in words or f.kind in ("Macro", "EnumVariant") else "Public"
    if f.kind == "EnumVariant":
        return {"kotlin": "Public", "java": "Crate"}.get(lang, "Private")
    if "public" in words:
        return "Public"
    if "private" in words or "protected" in words:
        return "Private"
    if "internal" in words:
        return "Crate"
    return {"kotlin": "Public", "java": "Crate"}.get(lang, "Private")


def signature(f: Found, source: str, text: str, lang: str) -> str | None:
    """The declaration up to its body, for the kinds that have one; without a body, all of it.  ``text``: the source, blanked."""
    if f.kind == "Macro":
        return byte_cut(source[f.start : f.end].split("\n")[0].strip(), 120)
    if f.kind != "Function" or lang in ("typescript", "tsx", "javascript") or (lang == "go" and not re.match(r"func\s*\(", f.header)):
        return None
    stop = f.body if f.body >= 0 else f.end
    if lang == "csharp" and f.body < 0 and "=>" in source[f.start : f.end]:
        stop = f.start + source[f.start : f.end].index("=>")
    elif lang == "kotlin" and f.body < 0:
        stop = _body_start(f, text)
    sig = source[f.start : stop].strip()
    return sig if lang == "rust" else byte_cut(sig, 200)


def calls(text: str, lang: str) -> set[str]:
    """Names called in blanked ``text``."""
    out = set()
    for m in _CALL.finditer(text):
        before = text[: m.start()].rstrip()[-8:]
        if m[2] in _NO_CALL[lang] or (not m[1] and re.search(r"\b(fn|func|fun|function|def|macro_rules!)$", before)):
            continue
        if re.search(r"\bnew$", before) and lang in ("typescript", "tsx", "javascript", "cpp"):
            continue
        out.add(m[2])
    if lang in ("java", "csharp"):
        out |= {m[1].split(".")[-1] for m in _CONSTRUCTED.finditer(text)}
    return out


_REFERENCED = re.compile(r"\b(struct|class|enum)\s+(\w+)(?!\s*[\w{:])")


def extract(path: str, source: str, lang: str) -> list[dict]:
    """Facts of one file."""
    lines = source.split("\n")
    out = [symbol(path, 0, "File", path.rsplit("/", 1)[-1], 0, len(lines) - 1, visibility="Public", analyzer="code")]
    if lang == "python":
        return out + _python(path, source)
    text, found = blanked(source, lang), scan(source, lang)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    place = lambda k: (row := bisect_right(starts, k) - 1, k - starts[row])
    open_: list[tuple[int, Found]] = []
    for n, f in enumerate(found, 1):
        while open_ and open_[-1][1].end <= f.start:
            open_.pop()
        (row, col), (last, last_col) = place(f.start), place(max(f.start, f.end))
        up = open_[-1] if open_ else (0, None)
        one = symbol(path, n, f.kind, f.name, row + 1, last + 1, parent=(path, up[0]), signature=signature(f, source, text, lang), visibility=visibility(f, lang, bool(up[1] and up[1].kind == "Trait")), analyzer="code")
        out.append(one | {"start_col": col, "end_col": last_col})
        if f.kind == "Function":
            body = text[_body_start(f, text) : f.end]
            out += [reference(path, n, "Calls", name, k, "code") for k, name in enumerate(sorted(calls(body, lang)))]
        out += [reference(path, n, "Implements", name, k, "code") for k, name in enumerate(f.implements)]
        open_.append((n, f))
    if lang in ("c", "cpp"):
        spans = [(n, f) for n, f in enumerate(found, 1) if f.kind != "EnumVariant"]
        for k, m in enumerate(_REFERENCED.finditer(text)):
            owner = max(((f.start, n) for n, f in spans if f.start <= m.start() < f.end and f.start + 0 != m.start()), default=(0, 0))[1]
            kind = "Enum" if m[1] == "enum" else "Struct"
            out.append(reference(path, owner, "TypeRef", m[2], k, "code", [kind]))
    return out


def _python(path: str, source: str) -> list[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = source.split("\n"), []
    todo: list[tuple[ast.AST, int]] = [(x, 0) for x in reversed(tree.body)]
    n = 0
    while todo:
        node, parent = todo.pop()
        own = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            n += 1
            own, is_class = n, isinstance(node, ast.ClassDef)
            sig = None
            if not is_class:
                first = node.body[0]
                stop = first.lineno - 1 if first.lineno > node.lineno else node.lineno
                head = "\n".join(lines[node.lineno - 1 : max(stop, node.lineno)])[node.col_offset :]
                if first.lineno == node.lineno:
                    head = lines[node.lineno - 1].encode()[node.col_offset : first.col_offset].decode()
                sig = byte_cut(re.sub(r"\s*#[^\n]*$", "", head).strip(), 200)
            private = node.name.startswith("_")
            out.append(symbol(path, n, "Struct" if is_class else "Function", node.name, node.lineno, node.end_lineno, parent=(path, parent), signature=sig, visibility="Private" if private else "Public", analyzer="code") | {"start_col": node.col_offset, "end_col": node.end_col_offset})
            if is_class:
                bases = [b.attr if isinstance(b, ast.Attribute) else b.id for b in node.bases if isinstance(b, (ast.Attribute, ast.Name))]
                out += [reference(path, n, "Implements", b, k, "code") for k, b in enumerate(bases)]
            else:
                names = {f.attr if isinstance(f, ast.Attribute) else f.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(f := c.func, (ast.Attribute, ast.Name))}
                out += [reference(path, n, "Calls", name, k, "code") for k, name in enumerate(sorted(names))]
        todo += [(x, own) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


_BY_EXTENSION = {ext: lang for lang, own in LANGUAGES.items() for ext in own}


def _extract(path: str, content: str) -> list[dict]:
    lang = _BY_EXTENSION.get(path.rsplit(".", 1)[-1])
    return extract(path, content, lang) if lang else []


def code(files: DataFrame) -> DataFrame:
    """Facts of all files in a known language that aren't minified."""
    known = files.filter(language(F.col("path")).isNotNull())
    return apply(known.filter(~minified(F.col("path"), F.octet_length("content"), F.col("content"))), _extract)
