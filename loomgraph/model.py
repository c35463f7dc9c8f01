"""The graph's tables, kinds and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

NODES = "node_id long, kind string, name string, file string, start_line int, end_line int, start_col int, end_col int, signature string, visibility string, analyzer string"
EDGES = "edge_id long, src long, dst long, kind string"
CALL_SITES = "caller_id long, callee_name string"
IMPL_SITES = "impl_id long, trait_name string, seq int"
NAME_REFS = "src long, ref_name string, edge_kind string, target_kinds array<string>"
FILE_HASHES = "path string, hash string"

# Node kinds with their labels and short tags.
KINDS = {
    "File": ("file", ""),
    "Module": ("mod", "mod"),
    "Function": ("fn", "fn"),
    "Struct": ("struct", "st"),
    "Trait": ("trait", "tr"),
    "Impl": ("impl", ""),
    "Enum": ("enum", "en"),
    "EnumVariant": ("variant", ""),
    "Constant": ("const", "co"),
    "TypeAlias": ("type", "ty"),
    "Macro": ("macro", "def"),
    "Role": ("role", "role"),
    "Task": ("task", "task"),
    "Handler": ("handler", "hnd"),
    "Variable": ("var", "var"),
    "Template": ("tpl", "tpl"),
    "Resource": ("res", "res"),
    "Document": ("doc", "doc"),
    "Section": ("sec", "sec"),
    "CodeBlock": ("code", "code"),
    "Table": ("tbl", "tbl"),
    "Column": ("col", ""),
    "Endpoint": ("ep", "ep"),
    "Message": ("msg", "msg"),
}
EDGE_KINDS = ("Contains", "Calls", "Imports", "Implements", "TypeRef", "DependsOn", "Notifies", "References", "LinksTo", "Includes")
#: How an edge into a definition is called among a symbol's references.
REFERENCE_KINDS = {"Calls": "Call", "Imports": "Import", "TypeRef": "TypeRef", "Implements": "Impl"}

# Kinds that define a symbol, and those that can be a symbol's primary definition.
DEFINITION_KINDS = ("Function", "Struct", "Trait", "Enum", "EnumVariant", "Module", "Table", "Message", "Role", "Macro")
PRIMARY_KINDS = ("Function", "Struct", "Trait", "Enum", "EnumVariant", "Table", "Message", "Macro")
DOMAIN_KINDS = ("Role", "Resource", "Table", "Message", "Document")
HUBLESS_KINDS = ("File", "EnumVariant", "Column", "Impl")
#: Filters of the symbol listing.
KIND_FILTERS = {
    "fn": ("Function",),
    "function": ("Function",),
    "struct": ("Struct",),
    "trait": ("Trait",),
    "enum": ("Enum",),
    "macro": ("Macro",),
    "mod": ("Module",),
    "module": ("Module",),
    "type": ("Struct", "Enum", "Trait"),
    "all": ("Function", "Struct", "Trait", "Enum", "Macro"),
}

# Names too common to be hubs or to be listed as calls.
NOISE_NAMES = ("new", "default", "into", "from", "clone", "to_string", "fmt", "drop", "eq", "hash", "cmp", "partial_cmp", "main", "anonymous")
NOISE_CALLS = ("new", "default", "into", "from", "clone", "to_string")

# Directories.
TRANSPARENT_DIRS = ("src", "lib", "pkg", "crates", "packages", "internal", "cmd")
OVERVIEW_IGNORED = ("target", "node_modules", ".git", "__pycache__", "vendor", "dist", "build")
SCAN_PRUNED = ("vendor", "third_party", "node_modules", "testdata", "__pycache__", ".git", "dist", "build", ".next", ".nuxt", "out", "__generated__", ".output", "coverage")
#: Where this engine keeps its tables, and what the change feed ignores besides.
STORE_DIR = ".loomgraph"
WATCH_IGNORED = (".git", "target", "node_modules", "__pycache__", STORE_DIR, "vendor", "third_party", "testdata", "dist", "build", ".next", ".nuxt", "out", "__generated__", ".output", "coverage")

# File extensions by language.
LANGUAGES = {
    "rust": ("rs",),
    "python": ("py",),
    "typescript": ("ts",),
    "tsx": ("tsx", "jsx"),
    "javascript": ("js", "mjs", "cjs"),
    "go": ("go",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "kotlin": ("kt", "kts"),
    "csharp": ("cs",),
    "java": ("java",),
}
FORMATS = {"terraform": ("tf",), "docs": ("md", "mdx", "rst"), "schema": ("sql", "proto", "yml", "yaml", "json")}

#: Kinds of two symbols of the same name, from the first wing's to the second's, that make a tunnel.
TUNNEL_PAIRS = (
    ("Struct", "Struct"),
    ("Message", "Struct"),
    ("Table", "Struct"),
    ("Trait", "Trait"),
    ("Enum", "Enum"),
    ("Message", "Message"),
    ("Struct", "Message"),
    ("Table", "Table"),
    ("Struct", "Table"),
)


@dataclass(frozen=True)
class Graph:
    """Nodes, edges, and the sites from which edges can be resolved again."""

    nodes: DataFrame
    edges: DataFrame
    call_sites: DataFrame | None = None
    impl_sites: DataFrame | None = None
    name_refs: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)
