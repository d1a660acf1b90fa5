"""Advisory, license, registry and install checks on dependency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.language import base_name
from lintlake.functions.text import col_of
from lintlake.functions.versions import has_digits, parse_version
from lintlake.rules.advisories import (
    INSTALLER_FILES,
    MANAGER_SCHEMA,
    MODULE_FOLDERS,
    PACKAGE_MANAGERS,
    VENV_FOLDERS,
    advisories_table,
    license_table,
)

LANGUAGE_OF = {"npm": "javascript", "PyPI": "python", "maven": "java", "crates.io": "rust", "go": "go"}
ISSUE_COLUMNS = [
    "project", "type", "name", "spec", "severity", "category", "cve", "title", "message",
    "description", "fix", "fix_version", "language",
]


def ecosystem_language(ecosystem) -> Column:
    pairs = [F.lit(x) for item in LANGUAGE_OF.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col_of(ecosystem)), F.lit("unknown"))


def preferred_manifest(manifests: DataFrame) -> DataFrame:
    """One manifest per project: package.json, else requirements.txt, else pom.xml."""
    order = ["package.json", "requirements.txt", "pom.xml"]
    name = base_name("path")
    rank = F.when(name == order[0], 0).when(name == order[1], 1).when(name == order[2], 2)
    return (
        manifests.select("project", "path", rank.alias("_rank"))
        .where("_rank IS NOT NULL")
        .groupBy("project")
        .agg(F.min(F.struct("_rank", "path")).alias("_m"))
        .select("project", F.col("_m.path").alias("manifest"))
    )


def merge_dependencies(deps: DataFrame) -> DataFrame:
    """One spec per (project, ecosystem, name): development entries override."""
    return (
        deps.where(F.col("kind").isin("prod", "dev"))
        .groupBy("project", "ecosystem", "name")
        .agg(F.max(F.struct("dev", "spec")).alias("_d"))
        .select("project", "ecosystem", "name", "_d.spec", "_d.dev")
    )


def vulnerable(deps: DataFrame, advisories: DataFrame | None = None, legacy_star: bool = False) -> DataFrame:
    """Dependencies below a fixed version.

    The built-in table is a few dozen rows, so it is broadcast; a table the
    caller brings is left to the optimiser. A spec without any digit names no
    version and reports nothing unless ``legacy_star``.
    """
    spark = deps.sparkSession
    table = advisories_table(spark) if advisories is None else advisories
    table = table.withColumn("_below", parse_version("below_version"))
    if advisories is None:
        table = F.broadcast(table)
    clean = F.regexp_replace(F.lower("name"), r"[@^~>=<]", "")
    keyed = deps.select(
        "project",
        "name",
        "spec",
        ecosystem_language("ecosystem").alias("language"),
        F.when(F.col("ecosystem") == "maven", F.element_at(F.split(clean, ":"), -1)).otherwise(clean).alias("package"),
    )
    if not legacy_star:
        keyed = keyed.where(has_digits("spec"))
    return (
        keyed.join(table, ["language", "package"])
        .where(parse_version("spec") < F.col("_below"))
        .select(
            "project",
            F.lit("vulnerability").alias("type"),
            "name",
            "spec",
            "severity",
            F.lit("security").alias("category"),
            "cve",
            "title",
            F.concat("name", F.lit("@"), "spec", F.lit(" is vulnerable: "), "title").alias("message"),
            "description",
            "fix",
            F.col("below_version").alias("fix_version"),
            "language",
        )
    )


def outdated(deps: DataFrame) -> DataFrame:
    """Specs that allow updates (``^`` or ``~``)."""
    nothing = F.lit(None).cast("string")
    return deps.where(F.col("spec").rlike(r"^[\^~]")).select(
        "project",
        F.lit("outdated").alias("type"),
        "name",
        "spec",
        F.lit("hint").alias("severity"),
        F.lit("maintainability").alias("category"),
        nothing.alias("cve"),
        nothing.alias("title"),
        F.concat("name", F.lit(" version constraint allows updates")).alias("message"),
        F.lit("Consider updating to the latest stable version").alias("description"),
        F.concat(F.lit("Run 'npm update "), "name", F.lit("' or 'pip install --upgrade "), "name", F.lit("'")).alias("fix"),
        nothing.alias("fix_version"),
        ecosystem_language("ecosystem").alias("language"),
    )


# Risk -> severity, message part, description, fix.
_LICENSE_TEXT = {
    "high": ("error", " uses high-risk license: ",
             "This license may require you to open source your code or has other restrictions.",
             "Consider finding an alternative package with a more permissive license."),
    "medium": ("warning", " uses medium-risk license: ", "This license has some restrictions. Review carefully.",
               "Review license terms and ensure compliance."),
    "unknown": ("warning", " has unknown license: ", "The license is unknown. This could be risky.",
                "Investigate the license terms before using in production."),
}


def license_issues(deps: DataFrame) -> DataFrame:
    """``deps(project, ecosystem, name, spec, license)`` against the risk table, any case."""
    nothing = F.lit(None).cast("string")

    def pick(i):
        result = None
        for risk, texts in _LICENSE_TEXT.items():
            test = F.col("risk") == risk
            result = F.when(test, texts[i]) if result is None else result.when(test, texts[i])
        return result

    table = F.broadcast(license_table(deps.sparkSession).where(F.col("risk") != "low"))
    return (
        deps.withColumn("license_key", F.upper("license"))
        .join(table, "license_key")
        .select(
            "project",
            F.lit("license").alias("type"),
            "name",
            "spec",
            pick(0).alias("severity"),
            F.lit("security").alias("category"),
            nothing.alias("cve"),
            F.col("risk").alias("title"),
            F.concat("name", pick(1), "license").alias("message"),
            pick(2).alias("description"),
            pick(3).alias("fix"),
            nothing.alias("fix_version"),
            ecosystem_language("ecosystem").alias("language"),
        )
    )


def check_dependencies(deps: DataFrame) -> DataFrame:
    """Vulnerable and outdated dependencies, plus licenses where the table has them."""
    issues = vulnerable(deps).unionByName(outdated(deps))
    if "license" in deps.columns:
        issues = issues.unionByName(license_issues(deps))
    return issues


def fix_command() -> Column:
    name, version = F.col("name"), F.col("fix_version")
    known = version.isNotNull()
    return (
        F.when((F.col("language") == "javascript") & known, F.concat(F.lit("npm install "), name, F.lit("@"), version))
        .when(F.col("language") == "javascript", F.concat(F.lit("npm update "), name))
        .when((F.col("language") == "python") & known, F.concat(F.lit('pip install "'), name, F.lit(">="), version, F.lit('"')))
        .when(F.col("language") == "python", F.concat(F.lit("pip install --upgrade "), name))
        .when((F.col("language") == "java") & known,
              F.concat(F.lit("Update "), name, F.lit(" version to "), version, F.lit(" in pom.xml")))
        .when(F.col("language") == "java", F.lit("Run 'mvn versions:display-dependency-updates'"))
        .otherwise(F.coalesce("fix", F.lit("Manual update required")))
    )


def fix_priority() -> Column:
    return (
        F.when((F.col("severity") == "error") & (F.col("type") == "vulnerability"), "critical")
        .when(F.col("severity") == "error", "high")
        .when(F.col("severity") == "warning", "medium")
        .otherwise("low")
    )


def severity_order() -> Column:
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def fix_suggestions(issues: DataFrame, severity: str | None = None) -> DataFrame:
    """Issues with command and priority; ``severity_rank`` orders them."""
    if severity:
        issues = issues.where(F.lower("severity") == severity.lower())
    return issues.select(
        "project",
        F.col("name").alias("dependency"),
        "type",
        "severity",
        F.col("spec").alias("current_version"),
        "fix_version",
        fix_command().alias("command"),
        F.coalesce("fix", "description").alias("description"),
        fix_priority().alias("priority"),
        severity_order().alias("severity_rank"),
    )


def issue_summary(deps: DataFrame, issues: DataFrame) -> DataFrame:
    """Totals per project by severity and type."""
    counted = deps.groupBy("project").agg(F.count("*").alias("total_dependencies"))
    found = issues.groupBy("project").agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "hint")],
        *[F.count_if(F.col("type") == t).alias(t) for t in ("vulnerability", "outdated", "license")],
    )
    zero = [c for c in found.columns if c != "project"]
    return counted.join(found, "project", "left").select(
        "project", "total_dependencies", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero]
    )


# ---- supply chain ----------------------------------------------------------


def exact_version(spec) -> Column:
    return F.regexp_replace(col_of(spec), r"^[\^~]+", "")


def known_vulnerabilities(deps: DataFrame, feed: DataFrame) -> DataFrame:
    """Equi join to a feed ``(ecosystem, name, version, id, summary, severity)``."""
    return deps.withColumn("version", exact_version("spec")).join(feed, ["ecosystem", "name", "version"]).select(
        "project", "manifest", "ecosystem", "name", "version", "id", "summary", "severity"
    )


def package_health(packages: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """``packages(ecosystem, name)`` with registry facts; abandoned after a year."""
    day = col_of(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    old = F.coalesce((F.col("ecosystem") == "PyPI") & (F.datediff(day, F.col("last_update")) > 365), F.lit(False))
    return packages.select("ecosystem", "name").distinct().join(registry, ["ecosystem", "name"], "left").select(
        "ecosystem",
        "name",
        "last_update",
        F.coalesce("maintainers", F.lit(0)).alias("maintainers"),
        F.coalesce("weekly_downloads", F.lit(0)).cast("bigint").alias("weekly_downloads"),
        old.alias("is_abandoned"),
        F.when(old, 30).otherwise(0).alias("risk_score"),
    )


def typosquat_candidates(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered names that look like a used package."""
    n = F.col("name")
    variants = F.array(
        F.replace(n, F.lit("-"), F.lit("")),
        F.replace(n, F.lit("-"), F.lit("_")),
        F.concat(n, F.lit("js")),
        F.concat(n, F.lit("lib")),
        F.concat(n, F.lit("official")),
    )
    named = (
        packages.select("ecosystem", "name").distinct()
        .select("ecosystem", "name", F.explode(F.array_distinct(variants)).alias("variant"))
        .where(F.col("variant") != n)
    )
    known = registry.select("ecosystem", F.col("name").alias("variant"))
    return named.join(known, ["ecosystem", "variant"], "left_semi")


def supply_chain_report(deps: DataFrame, feed: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """Totals per manifest.

    Facts are joined per package, not per use, and only counts meet in the
    last aggregation, so popular packages cost no more than rare ones.
    """
    uses = deps.withColumn("version", exact_version("spec")).select("manifest", "ecosystem", "name", "version").distinct()
    bad = feed.select("ecosystem", "name", "version", F.lit(1).alias("_bad")).distinct()
    gone = package_health(deps, registry, as_of).where("is_abandoned").select("ecosystem", "name", F.lit(1).alias("_gone"))
    look = typosquat_candidates(deps.where(F.col("ecosystem") == "PyPI"), registry).groupBy("ecosystem", "name").agg(
        F.count("*").alias("_look")
    )
    return (
        uses.join(bad, ["ecosystem", "name", "version"], "left")
        .join(gone, ["ecosystem", "name"], "left")
        .join(look, ["ecosystem", "name"], "left")
        .groupBy("manifest", "ecosystem")
        .agg(
            F.count("*").alias("total_packages"),
            F.count("_bad").alias("vulnerable_packages"),
            F.count("_gone").alias("abandoned_packages"),
            F.coalesce(F.sum("_look"), F.lit(0)).cast("bigint").alias("typosquatting_risks"),
        )
    )


# ---- installed packages ----------------------------------------------------


def _managers(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PACKAGE_MANAGERS, MANAGER_SCHEMA))


def top_entries(inventory: DataFrame) -> DataFrame:
    """Distinct first path parts per project from ``inventory(project, path)``."""
    return inventory.select("project", F.split("path", "/")[0].alias("entry")).distinct()


def detect_managers(inventory: DataFrame) -> DataFrame:
    """Package managers per project by lock file (high) or module folder (medium)."""
    entries = top_entries(inventory)
    table = _managers(inventory.sparkSession)
    by_lock = (
        entries.join(table, (F.col("entry") == F.col("lock_file")) | (F.col("entry") == F.col("other_lock_file")))
        .groupBy("project", "manager", "language", "install_command")
        .agg(F.min(F.struct((F.col("entry") != F.col("lock_file")).alias("_other"), "entry")).alias("_e"))
        .select("project", "manager", "language", "install_command", F.col("_e.entry").alias("lock_file"), F.lit("high").alias("confidence"))
    )
    folders = entries.select(
        "project",
        F.when(F.col("entry") == "node_modules", "npm").when(F.col("entry").isin("__pycache__", "venv", ".venv"), "pip").alias("manager"),
        F.when(F.col("entry") == "node_modules", "node_modules").otherwise("venv").alias("lock_file"),
    ).where("manager IS NOT NULL").distinct()
    by_folder = (
        folders.join(table.drop("lock_file", "other_lock_file"), "manager")
        .join(by_lock.select("project", "language").distinct(), ["project", "language"], "left_anti")
        .select("project", "manager", "language", "install_command", "lock_file", F.lit("medium").alias("confidence"))
    )
    return by_lock.unionByName(by_folder)


def detect_installer(inventory: DataFrame) -> DataFrame:
    """The file and command that decide how a project is installed."""
    rank = None
    for i, (name, _) in enumerate(INSTALLER_FILES):
        test = F.col("entry") == name
        rank = F.when(test, i) if rank is None else rank.when(test, i)
    commands = F.array(*[F.lit(c) for _, c in INSTALLER_FILES])
    names = F.array(*[F.lit(n) for n, _ in INSTALLER_FILES])
    best = top_entries(inventory).select("project", rank.alias("_rank")).where("_rank IS NOT NULL").groupBy("project").agg(
        F.min("_rank").alias("_rank")
    )
    return best.select(
        "project",
        F.element_at(names, F.col("_rank") + 1).alias("file_name"),
        F.element_at(commands, F.col("_rank") + 1).alias("install_command"),
    )


def install_issues(inventory: DataFrame) -> DataFrame:
    """Missing package folders and virtual environments per detected manager."""
    entries = top_entries(inventory)
    folders = [(language, name, names[0]) for language, names in MODULE_FOLDERS.items() for name in names]
    table = F.broadcast(inventory.sparkSession.createDataFrame(folders, "language string, entry string, shown string"))
    managers = detect_managers(inventory)
    present = entries.join(table, "entry").select("project", "language").distinct()
    missing = (
        managers.join(present, ["project", "language"], "left_anti")
        .join(table.select("language", "shown").distinct(), "language")
        .select(
            "project",
            F.lit("missing").alias("type"),
            F.lit("error").alias("severity"),
            "manager",
            F.concat(F.lit("Dependencies not installed ("), "shown", F.lit(")")).alias("message"),
            F.concat(F.lit("Run '"), "install_command", F.lit("' to install dependencies")).alias("suggestion"),
        )
    )
    envs = entries.where(F.col("entry").isin(*VENV_FOLDERS)).select("project").distinct()
    no_env = (
        managers.where(F.col("language") == "python").select("project").distinct()
        .join(envs, "project", "left_anti")
        .select(
            "project",
            F.lit("recommendation").alias("type"),
            F.lit("hint").alias("severity"),
            F.lit(None).cast("string").alias("manager"),
            F.lit("No virtual environment detected for Python project").alias("message"),
            F.lit("Consider creating a virtual environment (python -m venv venv)").alias("suggestion"),
        )
    )
    return missing.unionByName(no_env)
