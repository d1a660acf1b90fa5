"""Dependency manifests to one row per dependency, by native expressions only.

Input: ``manifests(project, path, text)``. Output:
``deps(project, manifest, ecosystem, name, spec, dev, kind)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.language import base_name
from lintlake.functions.text import java_regex

MANIFEST_NAMES = ["package.json", "requirements.txt", "pom.xml", "Cargo.toml"]
_NPM = (
    "dependencies map<string,string>, devDependencies map<string,string>, "
    "peerDependencies map<string,string>, optionalDependencies map<string,string>, "
    "bundledDependencies array<string>"
)
_POM = (
    r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
)
_CARGO = r"^[^\n]*\[dependencies\][^\n]*\n((?:(?!\[)[^\n]*+(?:\n|\z))*+)"


def _columns(ecosystem, name, spec, dev, kind):
    return [
        "project",
        F.col("path").alias("manifest"),
        F.lit(ecosystem).alias("ecosystem"),
        name.alias("name"),
        spec.alias("spec"),
        dev.alias("dev"),
        kind.alias("kind"),
    ]


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    parsed = manifests.select("project", "path", F.from_json("text", _NPM).alias("_m"))
    entry = lambda kind: lambda k, v: F.struct(F.lit(kind).alias("kind"), k.alias("name"), v.alias("spec"))

    def entries(field, kind):
        as_list = F.transform(F.map_entries(F.col(f"_m.{field}")), lambda e: entry(kind)(e["key"], e["value"]))
        return F.coalesce(as_list, F.array().cast("array<struct<kind:string,name:string,spec:string>>"))

    bundled = F.coalesce(
        F.transform("_m.bundledDependencies", lambda n: entry("bundled")(n, F.lit("*"))),
        F.array().cast("array<struct<kind:string,name:string,spec:string>>"),
    )
    every = F.concat(
        entries("dependencies", "prod"), entries("devDependencies", "dev"), entries("peerDependencies", "peer"),
        entries("optionalDependencies", "optional"), bundled,
    )
    return parsed.select("project", "path", F.explode(every).alias("_d")).select(
        *_columns("npm", F.col("_d.name"), F.col("_d.spec"), F.col("_d.kind") == "dev", F.col("_d.kind"))
    )


def _requirement_lines(manifests: DataFrame) -> DataFrame:
    line = F.regexp_replace("_raw", r"^\s+|\s+$", "")
    return (
        manifests.select("project", "path", F.explode(F.split("text", "\n", -1)).alias("_raw"))
        .select("project", "path", line.alias("_line"))
        .where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    )


def pip_dependencies(manifests: DataFrame) -> DataFrame:
    """Plain ``name`` or ``name<op>version`` lines; ``*`` where no version is given."""
    pattern = r"^([a-zA-Z0-9_-]+)([<>=!~]+.+)?$"
    spec = F.regexp_extract("_line", java_regex(pattern), 2)
    return (
        _requirement_lines(manifests)
        .where(F.col("_line").rlike(java_regex(pattern)))
        .select(
            *_columns(
                "PyPI",
                F.lower(F.regexp_extract("_line", java_regex(pattern), 1)),
                F.when(spec == "", "*").otherwise(spec),
                F.lit(False),
                F.lit("prod"),
            )
        )
    )


def pinned_requirements(manifests: DataFrame) -> DataFrame:
    """The supply-chain reading: the version after ``==`` or ``>=``, else ``latest``."""
    exact, least = F.split("_line", "==", -1), F.split("_line", ">=", -1)
    return _requirement_lines(manifests).select(
        *_columns(
            "PyPI",
            F.trim(
                F.when(F.contains("_line", F.lit("==")), exact[0])
                .when(F.contains("_line", F.lit(">=")), least[0])
                .otherwise(F.split("_line", r"\s+", -1)[0])
            ),
            F.trim(
                F.when(F.contains("_line", F.lit("==")), exact[1])
                .when(F.contains("_line", F.lit(">=")), least[1])
                .otherwise("latest")
            ),
            F.lit(False),
            F.lit("prod"),
        )
    )


def maven_dependencies(manifests: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract_all("text", F.lit(_POM), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("g"), part(2).alias("a"), part(3).alias("v"))
    return manifests.select("project", "path", F.explode(zipped).alias("_d")).select(
        *_columns(
            "maven", F.concat("_d.g", F.lit(":"), "_d.a"), F.col("_d.v"), F.lit(False), F.lit("prod")
        )
    )


def cargo_dependencies(manifests: DataFrame) -> DataFrame:
    """``name = version`` lines of the [dependencies] sections."""
    sections = F.regexp_extract_all("text", F.lit(java_regex(_CARGO, "m")), F.lit(1))
    lines = F.flatten(F.transform(sections, lambda s: F.split(s, "\n", -1)))
    parts = F.split("_line", "=", -1)
    return (
        manifests.select("project", "path", F.explode(lines).alias("_line"))
        .where(F.contains("_line", F.lit("=")) & ~F.contains("_line", F.lit("[dependencies]")))
        .select(
            *_columns(
                "crates.io", F.trim(parts[0]), F.regexp_replace(F.trim(parts[1]), r'^"+|"+$', ""), F.lit(False), F.lit("prod")
            )
        )
    )


def read_manifests(manifests: DataFrame) -> DataFrame:
    """All dependencies of a mixed set of manifests, by file name."""
    name = base_name("path")
    readers = {
        "package.json": npm_dependencies, "requirements.txt": pip_dependencies, "pom.xml": maven_dependencies,
        "Cargo.toml": cargo_dependencies,
    }
    result = None
    for file_name, reader in readers.items():
        rows = reader(manifests.where(name == file_name))
        result = rows if result is None else result.unionByName(rows)
    return result
