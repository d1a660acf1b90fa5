"""Error patterns, review rules and language rules."""

from __future__ import annotations

from .model import Rule

# Category, rule, pattern, flags, severity, message, fix, anchors, kind.
_ERRORS = [
    ("syntax", "missingClosing", r"\{[^}]*$", "m", "error", "Missing closing brace", "Add closing brace `}`", "{", "first"),
    ("syntax", "unmatchedParen", r"\([^)]*$", "m", "error", "Unmatched parenthesis", "Add closing parenthesis `)`", "(", "first"),
    ("syntax", "missingSemicolon", r"^[^#]*\b(const|let|var|function|return|import|export)\s+[^;]+$", "m", "warning",
     "Possible missing semicolon", "Add semicolon `;` at the end of statement", "const|let|var|function|return|import|export", "regex"),
    ("logic", "offByOne", r"for\s*\(\s*let\s+\w+\s*<=\s*\w+\.length", "", "error",
     "Off-by-one error: using <= with array.length", "Use < instead of <= for array iteration", ".length", "regex"),
    ("logic", "assignmentInCondition", r"if\s*\(\s*\w+\s*=\s*[^=]", "", "error",
     "Assignment in condition (did you mean == or ===?)", "Use === for comparison or wrap assignment in extra parentheses", "if", "regex"),
    ("logic", "alwaysTrue", r"while\s*\(\s*true\s*\)", "", "warning",
     "Infinite loop detected", "Ensure loop has a proper exit condition", "while", "regex"),
    ("type", "nullDereference", r"if\s*\(\s*\w+\s*!==?\s*null\s*\)\s*\{\s*\w+\.", "", "error",
     "Possible null dereference", "Add null check before accessing property", "null", "regex"),
    ("type", "undefinedUsage", r"\bundefined\b(?!\s*[=])", "", "hint",
     "Using undefined - consider explicit checks", 'Use typeof x === "undefined" for checks', "undefined", "regex"),
    ("performance", "domAccessInLoop", r"for\s*\([^)]*\)\s*\{[^}]*getElementById", "", "warning",
     "DOM access inside loop", "Cache DOM element reference outside the loop", "getelementbyid", "regex"),
    ("performance", "arrayConcatInLoop", r"for\s*\([^)]*\)\s*\{[^}]*\[\]\.concat", "", "warning",
     "Array concatenation in loop", "Use array.push() or build array outside loop", "[].concat", "regex"),
    ("memory", "eventListenerLeak", r"addEventListener\s*\([^)]*\)(?![\s\S]*removeEventListener)", "", "warning",
     "Event listener added without corresponding removal", "Add removeEventListener in cleanup", "addeventlistener", "regex"),
    ("memory", "intervalLeak", r"setInterval\s*\([^)]*\)(?![\s\S]*clearInterval)", "", "warning",
     "Interval created without clearInterval", "Store interval ID and call clearInterval when done", "setinterval", "regex"),
]
# Group, rule, pattern, flags, severity, category, message, suggestion, anchors.
_REVIEW = [
    ("bestPractices", "noConsole", r"console\.(log|warn|error|info|debug)", "", "warning", "quality",
     "Console statement in production code", "Remove console statements or use a proper logging framework", "console."),
    ("bestPractices", "noDebugger", r"\bdebugger\b", "", "error", "quality",
     "Debugger statement found", "Remove debugger statement before committing", "debugger"),
    ("bestPractices", "preferConst", r"\blet\s+(\w+)\s*=\s*[^;]+;(?:[\s\S]*?)(?!\b\1\s*=)", "", "hint", "style",
     "Variable declared with let but never reassigned", "Use const instead of let for variables that are not reassigned", "let"),
    ("errorHandling", "emptyCatch", r"catch\s*\([^)]*\)\s*\{\s*\}", "", "error", "quality",
     "Empty catch block", "Log the error or handle it appropriately", "catch"),
    ("errorHandling", "swallowError", r"catch\s*\([^)]*\)\s*\{\s*//.*\n\s*\}", "", "warning", "quality",
     "Error is caught but ignored", "Handle the error or rethrow with additional context", "catch"),
    ("errorHandling", "noErrorType", r"catch\s*\(\s*\w+\s*\)", "", "hint", "quality",
     "Generic error catch without type checking", "Check error type for specific handling", "catch"),
    ("clarity", "longFunction", r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]{500,}\}", "", "warning", "complexity",
     "Function is too long (>500 characters)", "Consider breaking into smaller, focused functions", "function"),
    ("clarity", "deepNesting", r"^\s{16,}", "m", "warning", "complexity",
     "Deep nesting (>4 levels)", "Consider early returns or extracting methods", ""),
    ("clarity", "magicNumber", r"(?<!\w)([2-9]\d{2,}|\d{4,})(?!\w)", "", "hint", "maintainability",
     "Magic number detected", "Extract to a named constant for clarity", ""),
    ("documentation", "missingJSDoc", r"export\s+(?:async\s+)?function\s+\w+", "", "hint", "documentation",
     "Exported function missing JSDoc comment", "Add JSDoc comment describing purpose, parameters, and return value", "export"),
    ("documentation", "todoComment", r"(//|/\*|#)\s*(TODO|FIXME|XXX|HACK)", "i", "info", "documentation",
     "TODO/FIXME comment found", "Address the TODO or create a tracked issue", "todo|fixme|xxx|hack"),
    ("testing", "noAssert", r"function\s+test\w*\s*\([^)]*\)\s*\{[\s\S]*?\}", "", "warning", "quality",
     "Test function without assertions", "Add assertions to verify expected behavior", "function"),
]
# Language, rule, pattern, severity, category, message, suggestion, anchors.
_LANGUAGE = [
    ("python", "bareExcept", r"except\s*:", "error", "quality", "Bare except clause",
     "Use specific exception types (except Exception as e:)", "except"),
    ("python", "mutableDefault", r"def\s+\w+\s*\([^)]*=\s*(\[\]|\{\})\s*\)", "error", "quality", "Mutable default argument",
     "Use None as default and initialize inside function", "def"),
    ("python", "globalStatement", r"\bglobal\s+\w+", "warning", "design", "Global statement usage",
     "Consider using a class or module-level variable", "global"),
    ("java", "emptyCatch", r"catch\s*\([^)]+\)\s*\{\s*\}", "error", "quality", "Empty catch block",
     "Handle or log the exception", "catch"),
    ("java", "systemOut", r"System\.(out|err)\.(println|print)", "warning", "quality", "Direct console output",
     "Use a logging framework like SLF4J or Log4j", "system."),
    ("go", "ignoredError", r":=\s*\w+\s*(?:,\s*\w+)*\s*:=\s*\w+\([^)]*\)(?:\s*;|\s*$)", "error", "quality",
     "Error value might be ignored", "Always check returned errors", ":="),
    ("go", "deferInLoop", r"for\s*\([^)]*\)\s*\{[^}]*defer", "warning", "performance", "Defer in loop",
     "Defer statements accumulate; consider alternative", "defer"),
    ("rust", "unwrap", r"\.unwrap\(\)", "warning", "quality", "Unwrap usage",
     "Consider using ? operator or proper error handling", ".unwrap()"),
    ("rust", "expect", r"\.expect\s*\(\"[^\"]*\"\)", "hint", "quality", "Expect with message",
     "Ensure error message is helpful for debugging", ".expect"),
]


def _split(anchors):
    return tuple(a for a in anchors.split("|") if a)


# From the last line break before the keyword on, the text holds no `#` either, so one line start is enough to decide.
_PROBES = {"missingSemicolon": r"^[^#\n]*(?<!\w)(?:const|let|var|function|return|import|export)\s+[^;]+$"}
_SHORTEST = {"longFunction": 514}

ERRORS = [
    Rule("error", rule, pattern, flags, severity, category, message, anchors=_split(anchors),
         suggestion=fix, auto_fixable=True, kind=kind, probe=_PROBES.get(rule))
    for category, rule, pattern, flags, severity, message, fix, anchors, kind in _ERRORS
]
REVIEW = [
    Rule("review", f"{group}-{rule}", pattern, flags, severity, category, message,
         anchors=_split(anchors), suggestion=suggestion, shortest=_SHORTEST.get(rule, 0))
    for group, rule, pattern, flags, severity, category, message, suggestion, anchors in _REVIEW
]
LANGUAGE_SPECIFIC = [
    Rule("language_specific", rule, pattern, "", severity, category, message,
         anchors=_split(anchors), languages=(language,), suggestion=suggestion)
    for language, rule, pattern, severity, category, message, suggestion, anchors in _LANGUAGE
]
LANGUAGE_REVIEW = [
    Rule("review", f"lang-{language}-{rule}", pattern, "", severity, category, message,
         anchors=_split(anchors), languages=(language,), suggestion=suggestion)
    for language, rule, pattern, severity, category, message, suggestion, anchors in _LANGUAGE
]
DETECT_ERRORS = ERRORS + LANGUAGE_SPECIFIC
CODE_REVIEW = ERRORS + LANGUAGE_SPECIFIC + REVIEW + LANGUAGE_REVIEW
