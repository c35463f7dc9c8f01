"""Source files of each language and what they hold by the rules of extraction: the SQL lists it, so that extraction is held against it.

``@`` stands for the number of a supplier, so that every file has names of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import derived


class Sample(NamedTuple):
    ext: str
    source: str
    #: (ordinal of the parent, kind, name, first line, last line, signature, visibility) in order; the file itself is number 0.
    symbols: list[tuple[int, str, str, int, int, str | None, str]]
    #: (ordinal, name called), (ordinal, name implemented)
    calls: list[tuple[int, str]]
    implements: list[tuple[int, str]]


SAMPLES = [
    Sample(
        "rs",
        'pub struct S@ { a: u8 }\npub(crate) enum E@ { One, Two(u8) }\npub trait Shape@ {\n    fn area(&self) -> u8;\n}\nimpl Shape@ for S@ {\n    fn area(&self) -> u8 {\n        let s = "fn fake() {"; // call(1)\n        m::helper@(self.a) + self.a.scale()\n    }\n}\nmacro_rules! mac@ { () => {}; }\nfn lone@() {}\n',
        [
            (0, "Struct", "S@", 1, 1, None, "Public"), (0, "Enum", "E@", 2, 2, None, "Crate"), (2, "EnumVariant", "One", 2, 2, None, "Private"), (2, "EnumVariant", "Two", 2, 2, None, "Private"),
            (0, "Trait", "Shape@", 3, 5, None, "Public"), (0, "Impl", "S@", 6, 11, None, "Private"), (6, "Function", "area", 7, 10, "fn area(&self) -> u8", "Private"),
            (0, "Macro", "mac@", 12, 12, "macro_rules! mac@ { () => {}; }", "Private"), (0, "Function", "lone@", 13, 13, "fn lone@()", "Private"),
        ],
        [(7, "helper@"), (7, "scale")],
        [(6, "Shape@")],
    ),
    Sample(
        "py",
        'class S@(Base@):\n    """def fake(): pass"""\n    def run(self):\n        def inner():\n            return os.join@(1)\n        return helper@(2)\ndef _hidden@(): return 1\n',
        [(0, "Struct", "S@", 1, 6, None, "Public"), (1, "Function", "run", 3, 6, "def run(self):", "Public"), (2, "Function", "inner", 4, 5, "def inner():", "Public"), (0, "Function", "_hidden@", 7, 7, "def _hidden@():", "Private")],
        [(2, "helper@"), (2, "join@"), (3, "join@")],
        [(1, "Base@")],
    ),
    Sample(
        "ts",
        "export interface T@ { a: string }\nexport enum E@ { Low, High }\nexport class S@ {\n  run() { return helper@(1); }\n}\nexport function lone@(a: number) { return new S@().run(); }\n",
        [(0, "Trait", "T@", 1, 1, None, "Private"), (0, "Enum", "E@", 2, 2, None, "Private"), (0, "Struct", "S@", 3, 5, None, "Private"), (3, "Function", "run", 4, 4, None, "Private"), (0, "Function", "lone@", 6, 6, None, "Private")],
        [(4, "helper@"), (5, "run")],
        [],
    ),
    Sample("js", "class S@ {\n  run() { return helper@(1); }\n}\nfunction lone@(a) { return a.b.go@(1); }\n", [(0, "Struct", "S@", 1, 3, None, "Private"), (1, "Function", "run", 2, 2, None, "Private"), (0, "Function", "lone@", 4, 4, None, "Private")], [(2, "helper@"), (3, "go@")], []),
    Sample("tsx", "interface P@ { a: string }\nfunction lone@(p: P@) { return draw@(p.a); }\n", [(0, "Trait", "P@", 1, 1, None, "Private"), (0, "Function", "lone@", 2, 2, None, "Private")], [(2, "draw@")], []),
    Sample(
        "go",
        "package m\ntype S@ struct { A int }\ntype T@ interface { Run() int }\nfunc (s S@) Run() int { return helper@(s.A) }\nfunc lone@() { fmt.Go@() }\n",
        [(0, "Struct", "S@", 2, 2, None, "Public"), (0, "Trait", "T@", 3, 3, None, "Public"), (0, "Function", "Run", 4, 4, "func (s S@) Run() int", "Public"), (0, "Function", "lone@", 5, 5, None, "Private")],
        [(3, "helper@"), (4, "Go@")],
        [],
    ),
    Sample(
        "c",
        "#define M@ 1\nenum E@ { UP@, DOWN@ };\nstruct S@ { int a; };\nstatic int lone@(int a) { return helper@(a); }\nint open@(void)\n{\n    return lone@(1);\n}\n",
        [
            (0, "Macro", "M@", 1, 2, "#define M@ 1", "Private"), (0, "Enum", "E@", 2, 2, None, "Public"), (2, "EnumVariant", "UP@", 2, 2, None, "Private"), (2, "EnumVariant", "DOWN@", 2, 2, None, "Private"),
            (0, "Struct", "S@", 3, 3, None, "Public"), (0, "Function", "lone@", 4, 4, "static int lone@(int a)", "Private"), (0, "Function", "open@", 5, 8, "int open@(void)", "Public"),
        ],
        [(6, "helper@"), (7, "lone@")],
        [],
    ),
    Sample(
        "cpp",
        "enum class E@ { On@, Off@ };\nclass S@ {\n public:\n  int area() const { return helper@(1); }\n};\nint lone@(int a) { return a; }\n",
        [
            (0, "Enum", "E@", 1, 1, None, "Public"), (1, "EnumVariant", "On@", 1, 1, None, "Private"), (1, "EnumVariant", "Off@", 1, 1, None, "Private"),
            (0, "Struct", "S@", 2, 5, None, "Public"), (4, "Function", "area", 4, 4, "int area() const", "Public"), (0, "Function", "lone@", 6, 6, "int lone@(int a)", "Public"),
        ],
        [(5, "helper@")],
        [],
    ),
    Sample(
        "kt",
        "interface T@ { fun go(): Int }\nclass S@(val a: Int) : T@ {\n    override fun go(): Int {\n        return helper@(a)\n    }\n    private fun hide@(b: Int = 1): Int = a.up@()\n}\nenum class E@ { A@, B@ }\n",
        [
            (0, "Trait", "T@", 1, 1, None, "Public"), (1, "Function", "go", 1, 1, "fun go(): Int", "Public"), (0, "Struct", "S@", 2, 7, None, "Public"), (3, "Function", "go", 3, 5, "override fun go(): Int", "Public"),
            (3, "Function", "hide@", 6, 6, "private fun hide@(b: Int = 1): Int", "Private"), (0, "Enum", "E@", 8, 8, None, "Public"), (6, "EnumVariant", "A@", 8, 8, None, "Public"), (6, "EnumVariant", "B@", 8, 8, None, "Public"),
        ],
        [(4, "helper@"), (5, "up@")],
        [(3, "T@")],
    ),
    Sample(
        "java",
        "public class S@ implements T@ {\n    public S@(int n) { }\n    private int run() { return helper@(new T@(1)); }\n    enum E@ { A@, B@ }\n}\ninterface T@ { int go(String a); }\n",
        [
            (0, "Struct", "S@", 1, 5, None, "Public"), (1, "Function", "S@", 2, 2, "public S@(int n)", "Public"), (1, "Function", "run", 3, 3, "private int run()", "Private"), (1, "Enum", "E@", 4, 4, None, "Crate"),
            (4, "EnumVariant", "A@", 4, 4, None, "Crate"), (4, "EnumVariant", "B@", 4, 4, None, "Crate"), (0, "Trait", "T@", 6, 6, None, "Crate"), (7, "Function", "go", 6, 6, "int go(String a);", "Crate"),
        ],
        [(3, "T@"), (3, "helper@")],
        [(1, "T@")],
    ),
    Sample(
        "cs",
        "public interface T@ { int Go(int a); }\npublic class S@ : T@\n{\n    public int Go(int a) { return Helper@(a); }\n    internal static void Reset() { }\n    protected void Hide() { }\n}\npublic enum E@ { A@, B@ }\n",
        [
            (0, "Trait", "T@", 1, 1, None, "Public"), (1, "Function", "Go", 1, 1, "int Go(int a);", "Private"), (0, "Struct", "S@", 2, 7, None, "Public"), (3, "Function", "Go", 4, 4, "public int Go(int a)", "Public"),
            (3, "Function", "Reset", 5, 5, "internal static void Reset()", "Crate"), (3, "Function", "Hide", 6, 6, "protected void Hide()", "Private"), (0, "Enum", "E@", 8, 8, None, "Public"),
            (7, "EnumVariant", "A@", 8, 8, None, "Private"), (7, "EnumVariant", "B@", 8, 8, None, "Private"),
        ],
        [(4, "Helper@")],
        [(3, "T@")],
    ),
]


def _literal(x: str | int | None) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") t({columns})"


FILES = f"SELECT '/src/m' || s_suppkey || '.' || ext AS path, replace(source, '@', CAST(s_suppkey AS STRING)) AS content FROM supplier JOIN {_values([(k, s.ext, s.source) for k, s in enumerate(SAMPLES)], 'k, ext, source')} ON s_suppkey % {len(SAMPLES)} = k"


def _expected(rows: list[tuple], plain: str, own: str) -> str:
    """What the files hold: rows of (k, ext, ordinal, plain columns, columns with names of their own)."""
    columns = [c for c in plain.split()] + [f"replace({c}, '@', CAST(s_suppkey AS STRING)) AS {c}" for c in own.split()]
    names = ", ".join(["k", "ext", "ordinal", *plain.split(), *own.split()])
    return f"SELECT '/src/m' || s_suppkey || '.' || ext AS path, ordinal::BIGINT AS ordinal, {', '.join(columns)} FROM supplier JOIN {_values(rows, names)} ON s_suppkey % {len(SAMPLES)} = k"


_ROWS = [(k, s.ext, 0, None, "File", 0, s.source.count("\n"), "Public", f"m@.{s.ext}", None) for k, s in enumerate(SAMPLES)]
_ROWS += [(k, s.ext, n, up, kind, first, last, seen, name, sig) for k, s in enumerate(SAMPLES) for n, (up, kind, name, first, last, sig, seen) in enumerate(s.symbols, 1)]
SYMBOLS_SQL = f"SELECT * REPLACE (parent::BIGINT AS parent) FROM ({_expected(_ROWS, 'parent kind start_line end_line visibility', 'name signature')})"
CALLS_SQL = _expected([(k, s.ext, *c) for k, s in enumerate(SAMPLES) for c in s.calls], "", "ref_name")
IMPLEMENTS_SQL = _expected([(k, s.ext, *c) for k, s in enumerate(SAMPLES) for c in s.implements], "", "ref_name")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.query(spark, sf_dir, FILES, ("supplier",))
