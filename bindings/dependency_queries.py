"""Dependency checks: manifests written from ``customer``, uses from ``lineitem``,
registry and feed from ``part``, project inventories from ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import q, read
from lintlake.functions.text import sql_string
from lintlake.operators import dependencies as dep
from lintlake.rules.advisories import INSTALLER_FILES, LICENSE_RISKS, PACKAGE_MANAGERS, MODULE_FOLDERS, VENV_FOLDERS, advisory_rows
from lintlake.sinks import exports
from lintlake.sources import manifests as mf

PACKAGES = [
    ("npm", "lodash"), ("npm", "axios"), ("npm", "express"), ("npm", "minimist"), ("npm", "node-fetch"), ("npm", "Moment"),
    ("npm", "@scope/qs"), ("npm", "qs"), ("npm", "glob-parent"), ("npm", "nanoid"), ("npm", "left-pad"), ("PyPI", "requests"), ("PyPI", "urllib3"),
    ("PyPI", "pillow"), ("PyPI", "pyyaml"), ("PyPI", "jinja2"), ("PyPI", "cryptography"), ("PyPI", "django"),
    ("PyPI", "flask"), ("PyPI", "numpy"), ("maven", "org.apache:log4j"), ("maven", "org.spring:spring-core"),
    ("maven", "com.fast:jackson-databind"), ("crates.io", "serde"), ("PyPI", "paramiko"), ("npm", "json5"),
]
PREFIXES = ["", "^", "~", ">=", "==", "*"]
LICENSES = ["MIT", "gpl-3.0", "GPL-2.0", "Unlicensed", "Apache-2.0", "unknown", "AGPL-3.0", "EPL-1.0"]
AS_OF = "2024-06-01"
n = len(PACKAGES)


def _pick_spark(values, index):
    return F.expr(f"element_at(array({', '.join(map(sql_string, values))}), cast({index} as int) + 1)")


def _pick_sql(values, index):
    return "[" + ",".join(map(q, values)) + f"][CAST({index} AS BIGINT) + 1]"


def uses(s, d):
    named = F.expr("l_linenumber % 2 = 0")
    prefix = _pick_spark(PREFIXES, "(l_suppkey + l_linenumber) % 6")
    version = F.expr("concat(cast(l_partkey % 6 as string), '.', cast(l_suppkey % 35 as string), '.', cast(l_linenumber as string))")
    project = F.expr("concat('proj', cast(l_orderkey % 500 as string))")
    eco = F.when(named, _pick_spark([e for e, _ in PACKAGES], f"l_partkey % {n}")).otherwise(_pick_spark(["npm", "PyPI"], "l_partkey % 2"))
    return read(s, d, "lineitem").select(
        project.alias("project"),
        F.concat(project, F.lit("/"), eco).alias("manifest"),
        eco.alias("ecosystem"),
        F.when(named, _pick_spark([p for _, p in PACKAGES], f"l_partkey % {n}")).otherwise(F.expr("concat('pkg-', cast(l_partkey as string))")).alias("name"),
        F.when(prefix == "*", "*").otherwise(F.concat(prefix, version)).alias("spec"),
        (F.col("l_returnflag") == "R").alias("dev"),
        F.when(F.col("l_returnflag") == "R", "dev").otherwise("prod").alias("kind"),
        _pick_spark(LICENSES, "l_suppkey % 8").alias("license"),
    )


_eco = f"CASE WHEN l_linenumber % 2 = 0 THEN {_pick_sql([e for e, _ in PACKAGES], f'l_partkey % {n}')} ELSE {_pick_sql(['npm', 'PyPI'], 'l_partkey % 2')} END"
_pre = _pick_sql(PREFIXES, "(l_suppkey + l_linenumber) % 6")
USES_SQL = f"""uses AS MATERIALIZED (SELECT 'proj' || CAST(l_orderkey % 500 AS VARCHAR) AS project, 'proj' || CAST(l_orderkey % 500 AS VARCHAR) || '/' || {_eco} AS manifest, {_eco} AS ecosystem,
 CASE WHEN l_linenumber % 2 = 0 THEN {_pick_sql([p for _, p in PACKAGES], f'l_partkey % {n}')} ELSE 'pkg-' || CAST(l_partkey AS VARCHAR) END AS name,
 CASE WHEN {_pre} = '*' THEN '*' ELSE {_pre} || CAST(l_partkey % 6 AS VARCHAR) || '.' || CAST(l_suppkey % 35 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) END AS spec,
 l_returnflag = 'R' AS dev, CASE WHEN l_returnflag = 'R' THEN 'dev' ELSE 'prod' END AS kind, {_pick_sql(LICENSES, 'l_suppkey % 8')} AS license FROM lineitem)"""
LANG_SQL = "CASE ecosystem " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dep.LANGUAGE_OF.items()) + " ELSE 'unknown' END"
ADV_SQL = "adv(language, package, below_version, severity, cve, title, description, fix) AS (VALUES " + ",".join("(" + ",".join(map(q, r)) + ")" for r in advisory_rows()) + ")"


def _version(x):
    bare = f"regexp_replace({x}, '^[^0-9]*', '')"
    return "row(" + ", ".join(f"coalesce(TRY_CAST(string_split({bare}, '.')[{i}] AS INTEGER), 0)" for i in (1, 2, 3)) + ")"


_clean = "regexp_replace(lower(name), '[@^~>=<]', '', 'g')"
VULN_SQL = f"""SELECT project, 'vulnerability' AS type, name, spec, severity, 'security' AS category, cve, title, name || '@' || spec || ' is vulnerable: ' || title AS message, description, fix, below_version AS fix_version, u.language
 FROM (SELECT *, {LANG_SQL} AS language, CASE WHEN ecosystem = 'maven' THEN string_split({_clean}, ':')[-1] ELSE {_clean} END AS package FROM uses WHERE regexp_matches(spec, '[0-9]')) u JOIN adv USING (language, package)
 WHERE {_version('spec')} < {_version('below_version')}"""
OUTDATED_SQL = f"""SELECT project, 'outdated' AS type, name, spec, 'hint' AS severity, 'maintainability' AS category, CAST(NULL AS VARCHAR) AS cve, CAST(NULL AS VARCHAR) AS title, name || ' version constraint allows updates' AS message,
 'Consider updating to the latest stable version' AS description, 'Run ''npm update ' || name || ''' or ''pip install --upgrade ' || name || '''' AS fix, CAST(NULL AS VARCHAR) AS fix_version, {LANG_SQL} AS language FROM uses WHERE left(spec, 1) IN ('^', '~')"""
_risk = "CASE " + " ".join(f"WHEN upper(license) IN ({','.join(q(x.upper()) for x in names)}) THEN '{risk}'" for risk, names in LICENSE_RISKS.items()) + " END"
_lt = dep._LICENSE_TEXT


def _by_risk(i):
    return "CASE risk " + " ".join(f"WHEN '{r}' THEN {q(t[i])}" for r, t in _lt.items()) + " END"


LICENSE_SQL = f"""SELECT project, 'license' AS type, name, spec, {_by_risk(0)} AS severity, 'security' AS category, CAST(NULL AS VARCHAR) AS cve, risk AS title, name || {_by_risk(1)} || license AS message, {_by_risk(2)} AS description, {_by_risk(3)} AS fix, CAST(NULL AS VARCHAR) AS fix_version, {LANG_SQL} AS language
 FROM (SELECT *, {_risk} AS risk FROM uses) WHERE risk IN ('high', 'medium', 'unknown')"""
HEAD = f"WITH {USES_SQL}, {ADV_SQL}"
ISSUES_SQL = f"issues AS MATERIALIZED ({VULN_SQL} UNION ALL {OUTDATED_SQL} UNION ALL {LICENSE_SQL})"
COMMAND_SQL = """CASE WHEN language = 'javascript' AND fix_version IS NOT NULL THEN 'npm install ' || name || '@' || fix_version WHEN language = 'javascript' THEN 'npm update ' || name
 WHEN language = 'python' AND fix_version IS NOT NULL THEN 'pip install "' || name || '>=' || fix_version || '"' WHEN language = 'python' THEN 'pip install --upgrade ' || name
 WHEN language = 'java' AND fix_version IS NOT NULL THEN 'Update ' || name || ' version to ' || fix_version || ' in pom.xml' WHEN language = 'java' THEN 'Run ''mvn versions:display-dependency-updates''' ELSE coalesce(fix, 'Manual update required') END"""
PRIORITY_SQL = "CASE WHEN severity = 'error' AND type = 'vulnerability' THEN 'critical' WHEN severity = 'error' THEN 'high' WHEN severity = 'warning' THEN 'medium' ELSE 'low' END"
RANK_SQL = "CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER)"

# ---- manifests -------------------------------------------------------------
NPM_TEXT = '{"name":"app@K","version":"1.0.0","dependencies":{"lodash":"^4.17.@K","axios":"0.@K.1"},"devDependencies":{"minimist":"~1.2.@K","lodash":"4.0.0"},"peerDependencies":{"qs":"6.@K.0"}}'
PIP_TEXT = "# pinned\nDjango==3.2.@K\nflask>=2.0\nnumpy\n\n  PyYAML~=5.@K  \nbad name here\n-e .\nurllib3<2"
POM_TEXT = "<project><dependencies>\n<dependency>\n <groupId>org.apache</groupId>\n <artifactId>log4j</artifactId>\n <version>2.@K.0</version>\n</dependency><dependency><groupId>org.spring</groupId><artifactId>spring-core</artifactId><version>5.3.@K</version></dependency>\n</dependencies></project>"
CARGO_TEXT = "[package]\nname = \"app@K\"\n\n[dependencies]\nserde = \"1.0.@K\"\nrand = \"0.@K\"\n\n[dev-dependencies]\ncriterion = \"0.3\"\n# [dependencies]\nlate = \"1.@K\"\n[features]\nx = []"
TEXTS = [NPM_TEXT, PIP_TEXT, POM_TEXT, CARGO_TEXT]


def manifest_files(s, d):
    base = read(s, d, "customer").select("c_custkey", F.expr("explode(CASE WHEN c_custkey % 3 = 0 THEN array(0, 1) ELSE array(0) END) AS extra"))
    which = "(c_custkey + extra) % 4"
    return base.select(
        F.expr("concat('cust', cast(c_custkey as string)) AS project"),
        F.concat(F.expr("concat('cust', cast(c_custkey as string), '/')"), _pick_spark(mf.MANIFEST_NAMES, which)).alias("path"),
        F.replace(_pick_spark(TEXTS, which), F.lit("@K"), F.expr("cast(c_custkey % 40 as string)")).alias("text"),
    )


MANIFEST_SQL = f"""manifests AS MATERIALIZED (SELECT 'cust' || CAST(c_custkey AS VARCHAR) AS project, 'cust' || CAST(c_custkey AS VARCHAR) || '/' || {_pick_sql(mf.MANIFEST_NAMES, '(c_custkey + extra) % 4')} AS path, {_pick_sql(mf.MANIFEST_NAMES, '(c_custkey + extra) % 4')} AS file,
 replace({_pick_sql(TEXTS, '(c_custkey + extra) % 4')}, '@K', CAST(c_custkey % 40 AS VARCHAR)) AS text FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [0, 1] ELSE [0] END) AS extra FROM customer))"""


def _only(s, d, name):
    return manifest_files(s, d).where(F.col("path").endswith(name))


_REQ = "reqs AS (SELECT project, path, trim(unnest(string_split(text, chr(10)))) AS l FROM manifests WHERE file = 'requirements.txt')"
NPM_SQL = " UNION ALL ".join(
    f"SELECT m.project, m.path AS manifest, 'npm' AS ecosystem, j.key AS name, j.value->>'$' AS spec, {str(kind == 'dev').lower()} AS dev, '{kind}' AS kind FROM (SELECT * FROM manifests WHERE file = 'package.json') m, json_each(m.text, '$.{field}') j"
    for field, kind in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer")))
PIP_SQL = "SELECT project, path AS manifest, 'PyPI' AS ecosystem, lower(regexp_extract(l, '^([a-zA-Z0-9_-]+)([<>=!~]+.+)?$', 1)) AS name, coalesce(nullif(regexp_extract(l, '^([a-zA-Z0-9_-]+)([<>=!~]+.+)?$', 2), ''), '*') AS spec, false AS dev, 'prod' AS kind FROM reqs WHERE l <> '' AND NOT starts_with(l, '#') AND regexp_matches(l, '^([a-zA-Z0-9_-]+)([<>=!~]+.+)?$')"
_POM = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
POM_SQL = f"SELECT project, path AS manifest, 'maven' AS ecosystem, unnest(list_transform(list_zip(regexp_extract_all(text, {q(_POM)}, 1), regexp_extract_all(text, {q(_POM)}, 2)), lambda x: x[1] || ':' || x[2])) AS name, unnest(regexp_extract_all(text, {q(_POM)}, 3)) AS spec, false AS dev, 'prod' AS kind FROM manifests WHERE file = 'pom.xml'"
CARGO_SQL = """SELECT project, path AS manifest, 'crates.io' AS ecosystem, trim(string_split(l, '=')[1]) AS name, trim(trim(string_split(l, '=')[2]), '"') AS spec, false AS dev, 'prod' AS kind FROM (
 SELECT project, path, l, last_value(CASE WHEN contains(l, '[dependencies]') THEN true WHEN starts_with(l, '[') THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos) AS inside FROM (
 SELECT project, path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM manifests WHERE file = 'Cargo.toml')) WHERE inside AND contains(l, '=') AND NOT contains(l, '[dependencies]')"""

# ---- registry and feed -----------------------------------------------------


def registry(s, d):
    eco = _pick_spark(["npm", "PyPI"], "p_partkey % 2")
    names = F.expr("""CASE p_partkey % 5 WHEN 1 THEN array(concat('pkg-', p_partkey), concat('pkg-', p_partkey, 'js')) WHEN 2 THEN array(concat('pkg-', p_partkey), concat('pkg_', p_partkey))
      WHEN 3 THEN array(concat('pkg-', p_partkey), concat('pkg', p_partkey), concat('pkg-', p_partkey, 'official')) ELSE array(concat('pkg-', p_partkey)) END""")
    return read(s, d, "part").select(
        eco.alias("ecosystem"), F.explode(names).alias("name"), F.expr("date_add(date'2022-06-01', p_size * 20)").alias("last_update"),
        F.expr("p_size % 4").cast("int").alias("maintainers"), F.expr("cast(p_partkey * 10 as bigint)").alias("weekly_downloads"))


REGISTRY_SQL = """registry AS (SELECT ['npm', 'PyPI'][p_partkey % 2 + 1] AS ecosystem, unnest(CASE p_partkey % 5 WHEN 1 THEN ['pkg-' || p_partkey, 'pkg-' || p_partkey || 'js'] WHEN 2 THEN ['pkg-' || p_partkey, 'pkg_' || p_partkey]
 WHEN 3 THEN ['pkg-' || p_partkey, 'pkg' || p_partkey, 'pkg-' || p_partkey || 'official'] ELSE ['pkg-' || p_partkey] END) AS name, CAST(DATE '2022-06-01' + CAST(p_size * 20 AS INTEGER) AS DATE) AS last_update, CAST(p_size % 4 AS INTEGER) AS maintainers, CAST(p_partkey * 10 AS BIGINT) AS weekly_downloads FROM part)"""


def feed(s, d):
    return read(s, d, "part").select(
        _pick_spark(["npm", "PyPI"], "p_partkey % 2").alias("ecosystem"), F.expr("concat('pkg-', p_partkey)").alias("name"),
        F.expr("concat(p_partkey % 6, '.', p_partkey % 10, '.1')").alias("version"), F.expr("concat('ADV-', p_partkey)").alias("id"),
        F.col("p_name").alias("summary"), F.expr("CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'MEDIUM' END").alias("severity"))


FEED_SQL = """feed AS (SELECT ['npm', 'PyPI'][p_partkey % 2 + 1] AS ecosystem, 'pkg-' || p_partkey AS name, CAST(p_partkey % 6 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || '.1' AS version, 'ADV-' || p_partkey AS id, p_name AS summary, CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM part)"""
_HEALTH = f"""health AS (SELECT ecosystem, name, last_update, coalesce(maintainers, 0) AS maintainers, coalesce(weekly_downloads, 0) AS weekly_downloads, coalesce(ecosystem = 'PyPI' AND date_diff('day', last_update, DATE '{AS_OF}') > 365, false) AS is_abandoned
 FROM (SELECT DISTINCT ecosystem, name FROM uses) LEFT JOIN registry USING (ecosystem, name))"""
_TYPO = """typo AS (SELECT v.* FROM (SELECT DISTINCT ecosystem, name, unnest([replace(name, '-', ''), replace(name, '-', '_'), name || 'js', name || 'lib', name || 'official']) AS variant FROM (SELECT DISTINCT ecosystem, name FROM uses)) v
 WHERE variant <> name AND EXISTS (SELECT 1 FROM registry r WHERE r.ecosystem = v.ecosystem AND r.name = v.variant))"""

# ---- inventories -----------------------------------------------------------
ENTRIES = ["package-lock.json", "yarn.lock", "requirements.txt", "Pipfile.lock", "poetry.lock", "pom.xml", "build.gradle.kts", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock", "node_modules/a.js", "venv/x.py", "target/a.class", "vendor/x.rb", "package.json", "Cargo.toml", "README.md", "src/a.py", "__pycache__/m.pyc"]


def inventory(s, d):
    return read(s, d, "customer").select(
        F.expr("concat('site', cast(c_custkey % 300 as string))").alias("project"),
        F.explode(F.array(*[_pick_spark(ENTRIES, f"(c_custkey * {k} + {j}) % {len(ENTRIES)}") for j, k in enumerate((3, 7, 11))])).alias("path"))


INVENTORY_SQL = f"""inventory AS MATERIALIZED (SELECT DISTINCT 'site' || CAST(c_custkey % 300 AS VARCHAR) AS project, string_split(unnest([{', '.join(_pick_sql(ENTRIES, f'(c_custkey * {k} + {j}) % {len(ENTRIES)}') for j, k in enumerate((3, 7, 11)))}]), '/')[1] AS entry FROM customer)"""
_MAN = "man(manager, lock_file, other, language, install_command) AS (VALUES " + ",".join("(" + ",".join("NULL" if x is None else q(x) for x in r) + ")" for r in PACKAGE_MANAGERS) + ")"
_DETECT = """locked AS (SELECT project, manager, language, install_command, CASE WHEN bool_or(entry = man.lock_file) THEN any_value(man.lock_file) ELSE any_value(other) END AS lock_file, 'high' AS confidence FROM inventory JOIN man ON entry = man.lock_file OR entry = other GROUP BY project, manager, language, install_command),
 detected AS (SELECT * FROM locked UNION ALL SELECT DISTINCT i.project, m.manager, m.language, m.install_command, CASE WHEN entry = 'node_modules' THEN 'node_modules' ELSE 'venv' END, 'medium'
  FROM inventory i JOIN man m ON (entry = 'node_modules' AND manager = 'npm') OR (entry IN ('__pycache__', 'venv', '.venv') AND manager = 'pip') WHERE NOT EXISTS (SELECT 1 FROM locked l WHERE l.project = i.project AND l.language = m.language))"""

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


add("SC8_npm_manifests", lambda s, d: mf.npm_dependencies(_only(s, d, "package.json")), f"WITH {MANIFEST_SQL} {NPM_SQL}")
add("SC9_pip_manifests", lambda s, d: mf.pip_dependencies(_only(s, d, "requirements.txt")), f"WITH {MANIFEST_SQL}, {_REQ} {PIP_SQL}")
add("SC9_pinned_requirements", lambda s, d: mf.pinned_requirements(_only(s, d, "requirements.txt")),
    f"""WITH {MANIFEST_SQL}, {_REQ} SELECT project, path AS manifest, 'PyPI' AS ecosystem, trim(CASE WHEN contains(l, '==') THEN string_split(l, '==')[1] WHEN contains(l, '>=') THEN string_split(l, '>=')[1] ELSE regexp_extract(l, '^\\S+') END) AS name,
 trim(CASE WHEN contains(l, '==') THEN string_split(l, '==')[2] WHEN contains(l, '>=') THEN string_split(l, '>=')[2] ELSE 'latest' END) AS spec, false AS dev, 'prod' AS kind FROM reqs WHERE l <> '' AND NOT starts_with(l, '#')""")
add("SC10_maven_manifests", lambda s, d: mf.maven_dependencies(_only(s, d, "pom.xml")), f"WITH {MANIFEST_SQL} {POM_SQL}")
add("SC11_cargo_manifests", lambda s, d: mf.cargo_dependencies(_only(s, d, "Cargo.toml")), f"WITH {MANIFEST_SQL} {CARGO_SQL}")
add("SC12_all_manifests", lambda s, d: mf.read_manifests(manifest_files(s, d)).groupBy("ecosystem", "kind").agg(F.count("*").alias("dependencies"), F.countDistinct("project").alias("projects")),
    f"WITH {MANIFEST_SQL}, {_REQ}, alld AS ({NPM_SQL} UNION ALL {PIP_SQL} UNION ALL {POM_SQL} UNION ALL {CARGO_SQL}) SELECT ecosystem, kind, count(*) AS dependencies, count(DISTINCT project) AS projects FROM alld GROUP BY ecosystem, kind")
add("D7_preferred_manifest", lambda s, d: dep.preferred_manifest(manifest_files(s, d)),
    f"WITH {MANIFEST_SQL} SELECT project, arg_min(path, CASE file WHEN 'package.json' THEN 0 WHEN 'requirements.txt' THEN 1 ELSE 2 END) AS manifest FROM manifests WHERE file <> 'Cargo.toml' GROUP BY project")
add("D5_merged_dependencies", lambda s, d: dep.merge_dependencies(uses(s, d)),
    f"WITH {USES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project, ecosystem, name ORDER BY dev DESC, spec DESC) AS k FROM uses) SELECT project, ecosystem, name, spec, dev FROM r WHERE k = 1")
add("J1_F3_vulnerable", lambda s, d: dep.vulnerable(uses(s, d)), f"{HEAD} {VULN_SQL}")
add("F4_outdated", lambda s, d: dep.outdated(uses(s, d)), f"{HEAD} {OUTDATED_SQL}")
add("J2_licenses", lambda s, d: dep.license_issues(uses(s, d)), f"{HEAD} {LICENSE_SQL}")
add("T7_F5_F6_fix_suggestions", lambda s, d: dep.fix_suggestions(dep.check_dependencies(uses(s, d))),
    f"{HEAD}, {ISSUES_SQL} SELECT project, name AS dependency, type, severity, spec AS current_version, fix_version, {COMMAND_SQL} AS command, coalesce(fix, description) AS description, {PRIORITY_SQL} AS priority, {RANK_SQL} AS severity_rank FROM issues")
add("P6_error_suggestions", lambda s, d: dep.fix_suggestions(dep.check_dependencies(uses(s, d)), "error").groupBy("project", "priority").agg(F.count("*").alias("suggestions")),
    f"{HEAD}, {ISSUES_SQL} SELECT project, {PRIORITY_SQL} AS priority, count(*) AS suggestions FROM issues WHERE severity = 'error' GROUP BY 1, 2")
add("G15_E3_dependency_summary", lambda s, d: dep.issue_summary(uses(s, d), dep.check_dependencies(uses(s, d))),
    f"""{HEAD}, {ISSUES_SQL}, a AS (SELECT project, count(*) AS total_dependencies FROM uses GROUP BY project), b AS (SELECT project, count(*) AS total_issues, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'hint') AS hints,
 count(*) FILTER (WHERE type = 'vulnerability') AS vulnerability, count(*) FILTER (WHERE type = 'outdated') AS outdated, count(*) FILTER (WHERE type = 'license') AS license FROM issues GROUP BY project)
 SELECT project, total_dependencies, coalesce(total_issues, 0) AS total_issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(hints, 0) AS hints, coalesce(vulnerability, 0) AS vulnerability, coalesce(outdated, 0) AS outdated, coalesce(license, 0) AS license FROM a LEFT JOIN b USING (project)""")
add("J3_known_vulnerabilities", lambda s, d: dep.known_vulnerabilities(uses(s, d), feed(s, d)),
    f"WITH {USES_SQL}, {FEED_SQL} SELECT project, manifest, ecosystem, name, u.version, id, summary, severity FROM (SELECT *, regexp_replace(spec, '^[\\^~]+', '') AS version FROM uses) u JOIN feed USING (ecosystem, name, version)")
add("J4_package_health", lambda s, d: dep.package_health(uses(s, d), registry(s, d), AS_OF),
    f"WITH {USES_SQL}, {REGISTRY_SQL}, {_HEALTH} SELECT *, CAST(CASE WHEN is_abandoned THEN 30 ELSE 0 END AS INTEGER) AS risk_score FROM health")
add("J5_typosquats", lambda s, d: dep.typosquat_candidates(uses(s, d), registry(s, d)), f"WITH {USES_SQL}, {REGISTRY_SQL}, {_TYPO} SELECT * FROM typo")
_SUPPLY = f"""WITH {USES_SQL}, {REGISTRY_SQL}, {FEED_SQL}, {_HEALTH}, {_TYPO}, u AS (SELECT DISTINCT manifest, ecosystem, name, regexp_replace(spec, '^[\\^~]+', '') AS version FROM uses)
 SELECT manifest, ecosystem, count(*) AS total_packages, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM feed f WHERE f.ecosystem = u.ecosystem AND f.name = u.name AND f.version = u.version)) AS vulnerable_packages,
 count(*) FILTER (WHERE EXISTS (SELECT 1 FROM health h WHERE h.is_abandoned AND h.ecosystem = u.ecosystem AND h.name = u.name)) AS abandoned_packages,
 CAST(sum(CASE WHEN ecosystem = 'PyPI' THEN coalesce((SELECT count(*) FROM typo t WHERE t.ecosystem = u.ecosystem AND t.name = u.name), 0) ELSE 0 END) AS BIGINT) AS typosquatting_risks FROM u GROUP BY manifest, ecosystem"""
add("G16_E12_supply_chain", lambda s, d: dep.supply_chain_report(uses(s, d), feed(s, d), registry(s, d), AS_OF), _SUPPLY)
add("J14_package_managers", lambda s, d: dep.detect_managers(inventory(s, d)), f"WITH {INVENTORY_SQL}, {_MAN}, {_DETECT} SELECT * FROM detected")
add("J14_installer", lambda s, d: dep.detect_installer(inventory(s, d)),
    f"WITH {INVENTORY_SQL}, ins(rank, file_name, install_command) AS (VALUES {','.join(f'({i},{q(a)},{q(b)})' for i, (a, b) in enumerate(INSTALLER_FILES))}) SELECT project, arg_min(file_name, rank) AS file_name, arg_min(install_command, rank) AS install_command FROM inventory JOIN ins ON entry = file_name GROUP BY project")
_FOLD = "fold(language, entry, shown) AS (VALUES " + ",".join(f"({q(k)},{q(x)},{q(v[0])})" for k, v in MODULE_FOLDERS.items() for x in v) + ")"
add("F22_install_issues", lambda s, d: dep.install_issues(inventory(s, d)),
    f"""WITH {INVENTORY_SQL}, {_MAN}, {_DETECT}, {_FOLD} SELECT project, 'missing' AS type, 'error' AS severity, manager, 'Dependencies not installed (' || (SELECT any_value(shown) FROM fold f WHERE f.language = x.language) || ')' AS message, 'Run ''' || install_command || ''' to install dependencies' AS suggestion FROM detected x
 WHERE NOT EXISTS (SELECT 1 FROM inventory i JOIN fold f USING (entry) WHERE i.project = x.project AND f.language = x.language)
 UNION ALL SELECT DISTINCT project, 'recommendation', 'hint', NULL, 'No virtual environment detected for Python project', 'Consider creating a virtual environment (python -m venv venv)' FROM detected x WHERE language = 'python' AND NOT EXISTS (SELECT 1 FROM inventory i WHERE i.project = x.project AND entry IN ({','.join(map(q, VENV_FOLDERS))}))""")
_MANIFEST = "'## 文件：' || manifest || chr(10) || '- 生态系统：' || ecosystem || chr(10) || '- 总包数：' || total_packages"
add("SK5_supply_chain_markdown", lambda s, d: exports.supply_chain_markdown(dep.supply_chain_report(uses(s, d), feed(s, d), registry(s, d), AS_OF)),
    f"""SELECT '# 供应链安全扫描报告' || chr(10) || chr(10) || string_agg({_MANIFEST}, chr(10) || chr(10) ORDER BY k) FILTER (WHERE k <= 20) || chr(10) || chr(10) || '## 📊 总结' || chr(10)
 || '- 🔴 漏洞包：' || CAST(sum(vulnerable_packages) AS BIGINT) || chr(10) || '- 🟡 废弃包：' || CAST(sum(abandoned_packages) AS BIGINT) || chr(10) || '- 🟠 Typosquatting 风险：' || CAST(sum(typosquatting_risks) AS BIGINT) AS markdown
 FROM (SELECT *, row_number() OVER (ORDER BY vulnerable_packages DESC, abandoned_packages DESC, manifest) AS k FROM ({_SUPPLY}))""")
