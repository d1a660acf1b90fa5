"""Rule scan: every regex hit of a catalogue with its line and column.

The whole scan is one narrow pass over the files, without a shuffle:

1. per file, the numbers of the rules that hit (literal prefilter, then regex);
2. per (file, rule), the text with a mark before and after every hit; the mark
   holds a hash of the text, so no text holds its own mark and none is changed;
3. the pieces between marks, whose lengths and line breaks give line and column.

Patterns stay literals, so each is compiled once per task. Only rows with a
hit carry text past step 1, and rows leave step 3 without any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.brackets import may_nest, nesting_profile
from lintlake.functions.text import java_regex, line_count, lines_of, sql_string
from lintlake.rules.quality import LINE_LIMITS

KEYS = ["project", "path", "language"]
CHUNK = 256
BLANK_RUN = r"(?:^|\n)[^\S\n]*\n[^\S\n]*\n[^\S\n]*(?:\n|\z)"


def _language_test(rule) -> str | None:
    wanted = [x for x in rule.languages if not x.startswith("!")]
    unwanted = [x[1:] for x in rule.languages if x.startswith("!")]
    if wanted:
        return f"language IN ({', '.join(map(sql_string, wanted))})"
    if unwanted:
        return f"language NOT IN ({', '.join(map(sql_string, unwanted))})"
    return None


def _test(rule) -> str:
    """SQL text: does the rule hit this file at all; cheap tests first."""
    tests = []
    language = _language_test(rule)
    if language:
        tests.append(language)
    if rule.anchors:
        near = " OR ".join(f"contains(_lower, {sql_string(a)})" for a in rule.anchors)
        tests.append(f"({near})")
    if rule.shortest:
        tests.append(f"octet_length(text) >= {rule.shortest}")
    pattern = sql_string(java_regex(rule.probe or rule.pattern, rule.flags))
    if rule.kind == "threshold":
        tests.append(f"regexp_count(text, {pattern}) >= {rule.threshold}")
    elif rule.kind == "blank_run":
        tests.append("rlike(text, " + sql_string(BLANK_RUN) + ")")
    elif rule.kind == "nesting":
        tests.append(f"_nesting.depth >= {rule.threshold}")
    else:
        tests.append(f"rlike(text, {pattern})")
    return " AND ".join(tests)


#: Marks around a hit; ``_mark`` is hexadecimal.
OPEN, CLOSE = "concat('\u0001', _mark, '<')", "concat('\u0001', _mark, '>')"


def _marked(rule) -> str | None:
    """SQL text: the text with marks, for rules whose hits are regex matches."""
    if rule.kind in ("threshold", "blank_run", "nesting"):
        return None
    pattern = java_regex(rule.pattern, rule.flags)
    if rule.kind == "first":
        head = f"(?d{rule.flags})"
        pattern = head + r"\A([\s\S]*?)(" + pattern[len(head):] + ")"
        return f"regexp_replace(text, {sql_string(pattern)}, concat('$1', {OPEN}, '$2', {CLOSE}))"
    return f"regexp_replace(text, {sql_string(pattern)}, concat({OPEN}, '$0', {CLOSE}))"


def _lines_hit(rule) -> str | None:
    """SQL text: 1-based numbers of the lines hit, for rules about lines or whole files."""
    if rule.kind == "threshold":
        return "array(1)"
    if rule.kind == "nesting":
        return "array(_nesting.line)"
    if rule.kind == "blank_run":
        # The flags are bound to a lambda's variable, so that they are computed once and not per line.
        blank = f"transform(split(text, '\\n', -1), l -> rlike(l, {sql_string(r'\A\s*\z')}))"
        return (
            f"transform(array({blank}), f -> filter(transform(f, (b, i) -> "
            "if(i >= 2 AND b AND get(f, i - 1) AND get(f, i - 2), i + 1, null)), x -> x IS NOT NULL))[0]"
        )
    return None


def _number(rule) -> str | None:
    if rule.kind == "threshold":
        return f"regexp_count(text, {sql_string(java_regex(rule.pattern, rule.flags))})"
    if rule.kind == "nesting":
        return "_nesting.depth"
    return None


def _number_if_hit(i: int, rule) -> str:
    return f"CASE WHEN {_test(rule)} THEN {i} END"


def _by_rule_sql(values: list[str | None], kind: str) -> str:
    branches = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"cast(CASE _rule {branches} END AS {kind})" if branches else f"cast(null AS {kind})"


def _by_rule(values: list[str | None], kind: str) -> Column:
    return F.expr(_by_rule_sql(values, kind))


def _prepared(files: DataFrame, rules):
    """Texts with what the tests read, and the columns that later steps need."""
    clean = files.select(*KEYS, "text").withColumn("_lower", F.lower("text"))
    if not any(r.kind == "nesting" for r in rules):
        return clean, []
    # Only files that some nesting rule may apply to, and whose brackets allow its depth, pay for the fold.
    nesting = [r for r in rules if r.kind == "nesting"]
    languages = " OR ".join(_language_test(r) or "true" for r in nesting)
    wanted = F.expr(f"({languages})") & may_nest("text", min(r.threshold for r in nesting))
    return clean.withColumn("_nesting", F.when(wanted, nesting_profile("text", skip_literals=True))), ["_nesting"]


def mark_hits(files: DataFrame, rules) -> DataFrame:
    """One row per (file, rule) with hits: ``_marked`` text or hit ``_lines``."""
    rules = list(rules)
    clean, extra = _prepared(files, rules)
    numbers = ", ".join(_number_if_hit(i, r) for i, r in enumerate(rules))
    numbered = clean.select(*KEYS, "text", *extra, F.explode(F.expr(f"array_compact(array({numbers}))")).alias("_rule"))
    numbered = numbered.withColumn("_mark", F.md5("text"))
    return numbered.select(
        *KEYS,
        "_rule",
        "_mark",
        "text",
        _by_rule([_marked(r) for r in rules], "string").alias("_marked"),
        _by_rule([_lines_hit(r) for r in rules], "array<int>").alias("_lines"),
        _by_rule([_number(r) for r in rules], "int").alias("_number"),
    )


def _advance(a: str, b: str) -> str:
    """Two steps as one: line breaks add up; characters count from the last break on."""
    return f"named_struct('k', {a}.k + {b}.k, 'w', if({b}.k > 0, {b}.w, {a}.w + {b}.w))"


def _prefixes(steps: str, start: str) -> str:
    """Running positions over an array of steps, by one fold."""
    return (
        f"aggregate({steps}, named_struct('at', {start}, 'out', cast(array() as array<struct<k:int,w:int>>)), "
        f"(acc, x) -> named_struct('at', {_advance('acc.at', 'x')}, 'out', concat(acc.out, array({_advance('acc.at', 'x')})))).out"
    )


_ORIGIN = "named_struct('k', 0, 'w', 0)"


def _positions(steps: str) -> str:
    """Running positions over steps: over chunks first and inside them second.

    A file with very many hits so costs no more than a constant factor over
    its length. The steps are bound to variables, so each is computed once.
    """
    ids = f"sequence(0, cast(floor((size(s) - 1) / {CHUNK}) as int))"
    chunk = f"slice(s, i * {CHUNK} + 1, {CHUNK})"
    total = f"aggregate({chunk}, {_ORIGIN}, (a, x) -> {_advance('a', 'x')})"
    ends = _prefixes(f"transform({ids}, i -> {total})", _ORIGIN)
    begin = f"if(i = 0, {_ORIGIN}, element_at(e, greatest(i, 1)))"
    large = f"transform(array({ends}), e -> flatten(transform({ids}, i -> {_prefixes(chunk, begin)})))[0]"
    return f"transform(array({steps}), s -> if(size(s) <= {CHUNK}, {_prefixes('s', _ORIGIN)}, {large}))[0]"


def _found(lines: str) -> str:
    """SQL text: line, column and match of each hit, from the pieces ``_p`` of a marked text or from line numbers."""
    plain = f"replace(p, {CLOSE}, '')"
    step = (
        f"named_struct('k', length({plain}) - length(replace({plain}, '\n', '')), "
        f"'w', length(substring_index({plain}, '\n', -1)))"
    )
    steps = f"transform(slice(_p, 1, size(_p) - 1), p -> {step})"
    return (
        f"CASE WHEN _p IS NULL THEN transform({lines}, l -> named_struct('line', l, 'column', 1, 'match', '')) "
        f"ELSE transform(arrays_zip({_positions(steps)}, slice(_p, 2, size(_p) - 1)), h -> "
        f"named_struct('line', h['0'].k + 1, 'column', h['0'].w + 1, 'match', substring_index(h['1'], {CLOSE}, 1))) END"
    )


def locate_hits(marked: DataFrame, around: int | None = None) -> DataFrame:
    """Marked texts to one row per hit: line, column and the whole match."""
    extra = [] if around is None else ["snippet"]
    parts = marked.withColumn("_parts", F.expr(f"split(_marked, {OPEN}, -1)"))
    # A generator over one row keeps the split from being repeated by what uses it.
    parts = parts.select("*", F.explode(F.array(F.col("_parts"))).alias("_p")).drop("_parts", "_marked")
    found = _found("_lines")
    if around is not None:
        # The lines are bound to a variable: cut once per file and rule, not per hit.
        first = f"greatest(h.line - {around}, 1)"
        near = f"array_join(slice(ls, {first}, least(h.line + {around}, size(ls)) - {first} + 1), '\\n')"
        found = (
            f"transform(array(split(text, '\\n', -1)), ls -> transform({found}, h -> "
            f"named_struct('line', h.line, 'column', h.column, 'match', h.match, 'snippet', {near})))[0]"
        )
    hits = parts.select(*KEYS, "_rule", "_number", F.explode(F.expr(found)).alias("_hit"))
    extra = [f"_hit.{c}" for c in extra]
    return hits.select(*KEYS, "_rule", "_number", *extra, "_hit.line", "_hit.column", "_hit.match")


def _constant(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else sql_string(value)


def _rule_table(rules) -> str:
    """SQL text: the rules' texts as an array in their order."""
    rows = ", ".join(
        "named_struct("
        + ", ".join(
            f"'{name}', {_constant(value)}"
            for name, value in (
                ("engine", r.engine), ("rule", r.rule), ("category", r.category),
                ("sub_category", r.sub_category), ("severity", r.severity), ("message", r.message),
                ("suggestion", r.suggestion), ("auto_fixable", r.auto_fixable), ("kind", r.kind),
                ("limit", LINE_LIMITS.get(r.engine, 0) if r.rule == "max-line-length" else 0),
            )
        )
        + ")"
        for r in rules
    )
    return f"array({rows})"


def describe_hits(hits: DataFrame, rules) -> DataFrame:
    """Rule text for each hit, from a literal table indexed by rule number."""
    table = F.expr(_rule_table(list(rules)))
    with_rule = hits.withColumn("_r", F.element_at(table, F.col("_rule") + 1))
    length = F.col("_r.limit") + F.length("match")
    message = F.col("_r.message")
    for name, value in (("{match}", F.col("match")), ("{count}", F.col("_number")), ("{length}", length)):
        message = F.when(
            F.contains(message, F.lit(name)), F.replace(message, F.lit(name), F.coalesce(value.cast("string"), F.lit("")))
        ).otherwise(message)
    line_start = F.col("_r.kind").isin("nesting", "blank_run", "threshold")
    return with_rule.select(
        *KEYS,
        F.col("_r.engine").alias("engine"),
        F.col("_r.rule").alias("rule"),
        F.col("_r.category").alias("category"),
        F.col("_r.sub_category").alias("sub_category"),
        F.col("_r.severity").alias("severity"),
        message.alias("message"),
        F.col("_r.suggestion").alias("suggestion"),
        F.col("line").cast("int").alias("line"),
        F.when(line_start, F.lit(1)).otherwise(F.col("column")).cast("int").alias("column"),
        "match",
        F.col("_r.auto_fixable").alias("auto_fixable"),
        F.col("_number").alias("number"),
        F.col("_rule").alias("rule_order"),
        *(["snippet"] if "snippet" in hits.columns else []),
    )


def scan_rules(files: DataFrame, rules, around: int | None = None) -> DataFrame:
    """``files(project, path, language, text)`` to one row per hit.

    ``around`` adds ``snippet``: the line of the hit with that many lines before
    and after it, taken on the spot, so no later join brings texts back.
    ``rule_order`` is the place of the rule in the given list; it decides which
    engine keeps a spot in :func:`dedup_findings`.
    """
    rules = list(rules)
    return describe_hits(locate_hits(mark_hits(files, rules), around), rules)


def _label_groups(rules, labels) -> str:
    """SQL text: the rules that hit a file, as one list of rule numbers per label."""
    groups: dict = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    alone = ", ".join(_number_if_hit(g[0], rules[g[0]]) for g in groups.values() if len(g) == 1)
    shared = ", ".join(f"array_compact(array({', '.join(_number_if_hit(i, rules[i]) for i in g)}))" for g in groups.values() if len(g) > 1)
    parts = [f"transform(array_compact(array({alone})), i -> array(i))"] if alone else []
    parts += [f"filter(array({shared}), g -> size(g) > 0)"] if shared else []
    return f"concat({', '.join(parts)})"


def _first_hits(rules) -> str:
    """SQL text: hits of the rules ``_rules`` of one label; of hits at one place the first rule's stays."""
    number = _by_rule_sql([_number(r) for r in rules], "int")
    located = _found(_by_rule_sql([_lines_hit(r) for r in rules], "array<int>"))
    of_rule = (
        f"transform(array(split({_by_rule_sql([_marked(r) for r in rules], 'string')}, {OPEN}, -1)), _p -> transform({located}, "
        f"h -> named_struct('line', h.line, 'column', h.column, 'rule', _rule, 'match', h.match, 'number', {number})))[0]"
    )
    # Sorted, the hits of a place are neighbours.
    merged = "transform(array(sort_array(a)), b -> filter(b, (x, i) -> i = 0 OR get(b, i - 1).line <> x.line OR get(b, i - 1).column <> x.column))[0]"
    return f"transform(array(flatten(transform(_rules, _rule -> {of_rule}))), a -> if(size(_rules) = 1, a, {merged}))[0]"


def scan_first(files: DataFrame, rules, labels) -> DataFrame:
    """Like :func:`scan_rules`, but of hits at one place whose rules share a label only the first rule's stays.

    All hits of a place lie in one file, so rules of one label are located
    together inside the file's row and no finding is shuffled. A path that two
    rows share counts as two files.
    """
    rules = list(rules)
    clean, extra = _prepared(files, rules)
    grouped = clean.withColumn("_mark", F.md5("text")).select(
        *KEYS, "text", "_mark", *extra, F.explode(F.expr(_label_groups(rules, labels))).alias("_rules")
    )
    hits = grouped.select(*KEYS, F.explode(F.expr(_first_hits(rules))).alias("_h"))
    return describe_hits(hits.select(*KEYS, F.col("_h.rule").alias("_rule"), F.col("_h.number").alias("_number"), "_h.line", "_h.column", "_h.match"), rules)


def hits_of_text(rules) -> str:
    """SQL text: all hits of the rules in ``text`` of ``language``, as an array in the order of the rules."""
    rules = list(rules)
    if any(r.kind == "nesting" for r in rules):
        raise ValueError("rules about nesting need a whole file: " + ", ".join(r.rule for r in rules if r.kind == "nesting"))
    message = "replace(replace(replace(r.message, '{match}', h.match), '{count}', coalesce(cast(h.number AS string), '')), '{length}', cast(r.limit + length(h.match) AS string))"
    described = (
        f"transform({_first_hits(rules)}, h -> transform(array(element_at({_rule_table(rules)}, h.rule + 1)), r -> named_struct('engine', r.engine, 'rule', r.rule, "
        f"'category', r.category, 'severity', r.severity, 'message', {message}, 'line', h.line, 'column', if(r.kind IN ('blank_run', 'threshold'), 1, h.column), 'match', h.match))[0])"
    )
    hits = f"flatten(transform({_label_groups(rules, range(len(rules)))}, _rules -> {described}))"
    # Bound one by one, so that the text is lower-cased and hashed once.
    return f"transform(array(lower(text)), _lower -> transform(array(md5(text)), _mark -> {hits})[0])[0]"


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per (file, rule, line, column); earlier rules win.

    Groups are single spots of a file, so no key can grow hot, and partial
    aggregation drops repeats before the shuffle.
    """
    keys = ["project", "path", "rule", "line", "column"]
    rest = [c for c in findings.columns if c not in keys and c != "rule_order"]
    first = F.min(F.struct("rule_order", *rest)).alias("_first")
    return findings.groupBy(*keys).agg(first).select(
        *[c if c in keys else F.col("_first")[c].alias(c) for c in findings.columns]
    )


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``line`` (1-based) and ``content``."""
    return files.select(*KEYS, F.posexplode(lines_of("text")).alias("_at", "content")).select(
        *KEYS, (F.col("_at") + 1).alias("line"), "content"
    )


def scan_lines(files: DataFrame, patterns) -> DataFrame:
    """At most one hit per (line, pattern): ``pattern_no`` is 0-based."""
    patterns = list(patterns)
    hit = F.array_compact(
        F.array(*[F.when(F.col("content").rlike(java_regex(p)), F.lit(i)) for i, p in enumerate(patterns)])
    )
    return file_lines(files).select(*KEYS, "line", "content", F.explode(hit).alias("pattern_no"))


def search_pattern(files: DataFrame, pattern: str, path_glob: str | None = None) -> DataFrame:
    """Lines that hold a user-given regex, optionally in paths that match a glob."""
    if path_glob:
        files = files.where(F.col("path").rlike(glob_regex(path_glob)))
    return scan_lines(files, [pattern]).select(*KEYS, "line", F.trim("content").alias("context"))


def glob_regex(glob: str) -> str:
    """Regex for a path glob: ``**`` spans folders, ``*`` and ``?`` do not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append("\\" + glob[i] if not (glob[i].isalnum() or glob[i] in "_/ ") else glob[i])
            i += 1
    anchored = "".join(out)
    return ("(?:^|/)" if "/" not in glob else "^") + anchored + "$"


def files_frame(df: DataFrame, project="project", path="path", language="language", text="text") -> DataFrame:
    """Any table with a text column as ``files``."""
    return df.select(
        F.col(project).cast("string").alias("project"),
        F.col(path).cast("string").alias("path"),
        F.col(language).cast("string").alias("language"),
        F.col(text).alias("text"),
    )


def file_sizes(files: DataFrame) -> DataFrame:
    return files.select(*KEYS, line_count("text").alias("lines"), F.octet_length("text").alias("bytes"))
