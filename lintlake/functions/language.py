"""Language detection from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

# Extension -> language, standard profile.
STANDARD = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".r": "r", ".jl": "julia", ".lua": "lua", ".sh": "shell",
    ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".html": "html", ".css": "css",
    ".scss": "scss", ".less": "less", ".vue": "vue", ".svelte": "svelte", ".yaml": "yaml",
    ".yml": "yaml", ".json": "json", ".toml": "toml", ".xml": "xml", ".md": "markdown",
    ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell",
    ".clj": "clojure", ".elm": "elm", ".ml": "ocaml", ".fs": "fsharp", ".vb": "vb",
    ".pl": "perl", ".pm": "perl",
}

# What the extended profile adds to the standard one.
EXTENDED = {
    **STANDARD,
    ".cc": "cpp", ".cxx": "cpp", ".kts": "kotlin", ".ps1": "powershell", ".htm": "html",
    ".sass": "sass", ".cljs": "clojure", ".mli": "ocaml", ".fsi": "fsharp",
    ".groovy": "groovy", ".graphql": "graphql", ".gql": "graphql", ".sol": "solidity",
    ".twig": "twig", ".liquid": "liquid", ".coffee": "coffeescript", ".asm": "assembly",
    ".s": "assembly", ".zig": "zig", ".nim": "nim", ".cr": "crystal", ".d": "d",
    ".rake": "ruby", ".ipynb": "python",
}

# Extension -> language for corpus scans.
SCANNER = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".java": "java", ".go": "go", ".rb": "ruby", ".php": "php", ".c": "c",
    ".cpp": "cpp", ".cs": "csharp", ".kt": "kotlin", ".scala": "scala", ".rs": "rust",
    ".swift": "swift", ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".tf": "terraform",
}

# Extension -> language name in SARIF artifacts.
SARIF = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go",
    ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".rs": "rust",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".yaml": "yaml", ".yml": "yaml",
    ".json": "json", ".tf": "hcl",
}

# Extensions that count as code in a corpus scan.
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".c", ".cpp", ".cs",
    ".h", ".hpp", ".kt", ".scala", ".rs", ".swift", ".sh", ".yaml", ".yml", ".json", ".tf",
]

# Endings of several parts, most specific first.
COMPOUND_SUFFIXES = [
    ((".d.ts",), "typescript-declaration"),
    ((".spec.ts", ".test.ts"), "typescript-test"),
    ((".spec.js", ".test.js"), "javascript-test"),
    ((".spec.py", ".test.py"), "python-test"),
    ((".spec.java", ".test.java"), "java-test"),
]

# Whole file names.
FILE_NAMES = [
    (("webpack.config.js", "vite.config.js", "rollup.config.js"), "javascript-config"),
    (("tsconfig.json", "jsconfig.json"), "json-config"),
    (("package.json",), "json-package"),
    (("dockerfile",), "dockerfile"),
    (("makefile", "cmakefile"), "makefile"),
]


def base_name(path) -> Column:
    return F.element_at(F.split(col_of(path), "/"), -1)


def extension(path) -> Column:
    """Last extension of the base name, lower case, '' for none or dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def detect_language(path) -> Column:
    name = F.lower(base_name(path))
    result = None
    for endings, language in COMPOUND_SUFFIXES:
        hit = F.lit(False)
        for ending in endings:
            hit = hit | name.endswith(ending)
        result = F.when(hit, language) if result is None else result.when(hit, language)
    for names, language in FILE_NAMES:
        result = result.when(name.isin(*names), language)
    return result.otherwise(F.coalesce(_lookup(STANDARD, extension(path)), F.lit("unknown")))


def detect_language_extended(path) -> Column:
    """Only the text from the last dot of the whole path counts."""
    ext = F.lower(F.regexp_extract(col_of(path), r"(\.[^.]*)$", 1))
    return F.coalesce(_lookup(EXTENDED, ext), F.lit("unknown"))


def detect_scanner_language(path) -> Column:
    """Null where the scanner does not support the file."""
    return F.when(base_name(path) == "Dockerfile", "dockerfile").otherwise(
        _lookup(SCANNER, extension(path))
    )


def is_code_file(path) -> Column:
    return (base_name(path) == "Dockerfile") | extension(path).isin(*CODE_EXTENSIONS)


def sarif_language(path) -> Column:
    return F.coalesce(_lookup(SARIF, extension(path)), F.lit("text"))


def normalize_language(language) -> Column:
    c = col_of(language)
    return (
        F.when(c.startswith("javascript"), "javascript")
        .when(c.startswith("typescript"), "typescript")
        .when(c.startswith("python"), "python")
        .otherwise(c)
    )


# Languages by area; together they are the supported ones.
LANGUAGE_AREAS = {
    "web": ["javascript", "typescript", "html", "css", "scss", "less", "sass", "vue", "svelte"],
    "backend": ["python", "java", "go", "rust", "c", "cpp", "csharp", "php", "ruby"],
    "mobile": ["swift", "kotlin", "dart", "objective-c"],
    "functional": ["haskell", "ocaml", "fsharp", "clojure", "elixir", "erlang", "elm"],
    "scripting": ["shell", "bash", "zsh", "powershell", "lua", "perl", "r"],
    "data": ["sql", "graphql", "json", "yaml", "toml", "xml"],
    "systems": ["c", "cpp", "rust", "go", "assembly", "zig", "nim"],
    "jvm": ["java", "kotlin", "scala", "groovy"],
    "dotnet": ["csharp", "fsharp", "vb"],
}
OTHER_LANGUAGES = [
    "markdown", "plsql", "tsql", "mongodb", "solidity", "v", "crystal", "d", "raku",
    "coffeescript", "twig", "liquid", "julia",
]


def supported_languages() -> list[str]:
    return sorted({name for group in LANGUAGE_AREAS.values() for name in group} | set(OTHER_LANGUAGES))


def is_supported(language) -> Column:
    return col_of(language).isin(*supported_languages())
