"""Base quality packs: JavaScript/TypeScript, Python, Java and everything else."""

from __future__ import annotations

from .model import Rule

JS = ("javascript", "typescript")
PY = ("python",)
JAVA = ("java",)

# Rule, pattern, flags, severity, category, message, anchors.
_JAVASCRIPT = [
    ("no-console", r"console\.(log|warn|error|info|debug)", "", "warning", "quality",
     "Avoid using console statements in production code", "console."),
    ("no-debugger", r"\bdebugger\b", "", "error", "quality",
     "Remove debugger statements before committing code", "debugger"),
    ("no-var", r"\bvar\b", "", "warning", "style", "Use let or const instead of var", "var"),
    ("no-todo", r"(//|/\*|#)\s*(TODO|FIXME|XXX|HACK)", "i", "info", "documentation",
     "Remove TODO/FIXME comments before committing", "todo|fixme|xxx|hack"),
    ("no-magic-numbers", r"(?<!\w)(?:[2-9]\d{2,}|\d{4,})(?!\w)", "", "hint", "maintainability",
     "Magic number detected: {match}. Consider using a named constant.", ""),
]
_PYTHON = [
    ("no-print", r"\bprint\s*\(", "", "warning", "quality",
     "Avoid using print statements in production code", "print"),
    ("no-todo", r"#\s*(TODO|FIXME|XXX|HACK)", "i", "info", "documentation",
     "Remove TODO/FIXME comments before committing", "todo|fixme|xxx|hack"),
    ("no-bare-except", r"^\s*except\s*:", "m", "error", "quality",
     "Use specific exception types instead of bare except", "except"),
    ("no-wildcard-import", r"^\s*from\s+\S+\s+import\s+\*", "m", "warning", "style",
     "Avoid wildcard imports (import *)", "import"),
    ("max-line-length", r"(?<=^[^\n]{120})[^\n]+", "m", "hint", "style",
     "Line exceeds 120 characters ({length} characters)", ""),
]
_JAVA = [
    ("no-system-out", r"System\.out\.(println|print)", "", "warning", "quality",
     "Use a logging framework instead of System.out", "system.out"),
    ("no-todo", r"(//|/\*)\s*(TODO|FIXME|XXX|HACK)", "i", "info", "documentation",
     "Remove TODO/FIXME comments before committing", "todo|fixme|xxx|hack"),
    ("no-empty-catch", r"catch\s*\([^)]+\)\s*\{\s*\}", "", "error", "quality",
     "Empty catch block. Handle or log the exception.", "catch"),
]
_GENERIC = [
    ("no-todo", r"(//|/\*|#|--)\s*(TODO|FIXME|XXX|HACK)", "i", "info", "documentation",
     "Remove TODO/FIXME comments before committing", "todo|fixme|xxx|hack"),
    ("max-line-length", r"(?<=^[^\n]{150})[^\n]+", "m", "hint", "style",
     "Line exceeds 150 characters ({length} characters)", ""),
]
# A digit is tested before what stands in front of it, and digits give nothing back: what follows them is no digit.
_PROBES = {"no-magic-numbers": r"(?=\d)(?<!\w)(?:[2-9]\d{2,}+|\d{4,}+)(?!\w)"}
LINE_LIMITS = {"quality-python": 120, "quality-generic": 150}


def _rules(engine, rows, languages):
    return [
        Rule(engine, rule, pattern, flags, severity, category, message,
             anchors=tuple(a for a in anchors.split("|") if a), languages=languages, probe=_PROBES.get(rule))
        for rule, pattern, flags, severity, category, message, anchors in rows
    ]


JAVASCRIPT = _rules("quality-javascript", _JAVASCRIPT, JS) + [
    Rule("quality-javascript", "max-nesting-depth", "", "", "warning", "complexity",
         "Code nesting depth is too high ({count}). Consider refactoring.",
         languages=JS, kind="nesting", threshold=5),
]
PYTHON = _rules("quality-python", _PYTHON, PY)
JAVA_PACK = _rules("quality-java", _JAVA, JAVA)
# "!x" keeps a rule away from a language, which is how the remaining ones are meant.
OTHERS = ("!javascript", "!typescript", "!python", "!java", "!unknown")
GENERIC = _rules("quality-generic", _GENERIC, OTHERS) + [
    Rule("quality-generic", "no-multiple-blank-lines", "", "", "hint", "style",
         "Multiple consecutive blank lines detected", languages=OTHERS, kind="blank_run",
         threshold=3),
]
ALL = JAVASCRIPT + PYTHON + JAVA_PACK + GENERIC

# Where a JavaScript function may start.
JS_FUNCTION_STARTS = [
    r"(?:async\s+)?function\s+\w+",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\w+\s*=>",
    r"(?:async\s+)?\w+\s*\([^)]*\)\s*\{",
    r"\w+\s*:\s*(?:async\s+)?function",
]
PY_FUNCTION_START = r"^(def|async def)\s+\w+"
LONG_FUNCTION_LINES = 50
LONG_FUNCTION_MESSAGE = (
    "Function is too long ({count} lines). Consider breaking it into smaller functions."
)
