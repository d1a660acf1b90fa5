"""Fixed reference tables for dependency checks (a few dozen rows in all)."""

from __future__ import annotations

# Language, package, fixed in, severity, id, title, description, fix.
ADVISORIES = [
    ("javascript", "lodash", "4.17.21", "error", "CVE-2021-23337", "Command Injection",
     "Lodash versions prior to 4.17.21 are vulnerable to Command Injection via the template function.",
     "Upgrade to lodash@4.17.21 or later"),
    ("javascript", "lodash", "4.17.19", "error", "CVE-2020-8203", "Prototype Pollution",
     "Lodash versions prior to 4.17.19 are vulnerable to Prototype Pollution.",
     "Upgrade to lodash@4.17.19 or later"),
    ("javascript", "axios", "0.21.1", "error", "CVE-2021-3749", "Inefficient Regular Expression Complexity",
     "Axios versions prior to 0.21.1 are vulnerable to ReDoS.",
     "Upgrade to axios@0.21.1 or later"),
    ("javascript", "express", "4.17.3", "warning", "CVE-2022-24999", "Open Redirect",
     "Express versions prior to 4.17.3 are vulnerable to open redirect.",
     "Upgrade to express@4.17.3 or later"),
    ("javascript", "minimist", "1.2.6", "error", "CVE-2021-44906", "Prototype Pollution",
     "Minimist versions prior to 1.2.6 are vulnerable to Prototype Pollution.",
     "Upgrade to minimist@1.2.6 or later"),
    ("javascript", "node-fetch", "2.6.7", "warning", "CVE-2022-0235", "Exposure of Sensitive Information",
     "Node-fetch versions prior to 2.6.7 are vulnerable to information exposure.",
     "Upgrade to node-fetch@2.6.7 or later"),
    ("javascript", "json5", "2.2.2", "error", "CVE-2022-46175", "Prototype Pollution",
     "JSON5 versions prior to 2.2.2 are vulnerable to Prototype Pollution.",
     "Upgrade to json5@2.2.2 or later"),
    ("javascript", "moment", "2.29.4", "warning", "CVE-2022-31129", "ReDoS",
     "Moment versions prior to 2.29.4 are vulnerable to ReDoS.",
     "Upgrade to moment@2.29.4 or later, or consider using date-fns or dayjs"),
    ("javascript", "glob-parent", "5.1.2", "error", "CVE-2020-28469", "ReDoS",
     "Glob-parent versions prior to 5.1.2 are vulnerable to ReDoS.",
     "Upgrade to glob-parent@5.1.2 or later"),
    ("javascript", "nanoid", "3.1.31", "warning", "CVE-2021-23566", "Exposure of Sensitive Information",
     "NanoID versions prior to 3.1.31 are vulnerable to information exposure.",
     "Upgrade to nanoid@3.1.31 or later"),
    ("javascript", "qs", "6.5.3", "error", "CVE-2022-24999", "Prototype Pollution",
     "QS versions prior to 6.5.3 are vulnerable to Prototype Pollution.",
     "Upgrade to qs@6.5.3 or later"),
    ("python", "requests", "2.31.0", "warning", "CVE-2023-32681", "Proxy-Authorization Header Leak",
     "Requests versions prior to 2.31.0 may leak Proxy-Authorization headers.",
     "Upgrade to requests@2.31.0 or later"),
    ("python", "urllib3", "1.26.5", "error", "CVE-2021-33503", "ReDoS",
     "urllib3 versions prior to 1.26.5 are vulnerable to ReDoS.",
     "Upgrade to urllib3@1.26.5 or later"),
    ("python", "urllib3", "2.0.6", "warning", "CVE-2023-43804", "Cookie Leak",
     "urllib3 versions prior to 2.0.6 may leak cookies.",
     "Upgrade to urllib3@2.0.6 or later"),
    ("python", "pillow", "9.3.0", "error", "CVE-2022-45198", "DoS",
     "Pillow versions prior to 9.3.0 are vulnerable to DoS via malformed images.",
     "Upgrade to pillow@9.3.0 or later"),
    ("python", "pyyaml", "5.4", "error", "CVE-2020-14343", "Arbitrary Code Execution",
     "PyYAML versions prior to 5.4 are vulnerable to arbitrary code execution.",
     "Upgrade to pyyaml@5.4 or later, use safe_load()"),
    ("python", "jinja2", "2.11.3", "error", "CVE-2020-28493", "ReDoS",
     "Jinja2 versions prior to 2.11.3 are vulnerable to ReDoS.",
     "Upgrade to jinja2@2.11.3 or later"),
    ("python", "cryptography", "3.3.2", "error", "CVE-2020-36242", "Bleichenbacher Timing Attack",
     "Cryptography versions prior to 3.3.2 are vulnerable to timing attacks.",
     "Upgrade to cryptography@3.3.2 or later"),
    ("python", "django", "3.2.4", "error", "CVE-2021-33203", "Directory Traversal",
     "Django versions prior to 3.2.4 are vulnerable to directory traversal.",
     "Upgrade to django@3.2.4 or later"),
    ("python", "flask", "2.2.5", "warning", "CVE-2023-30861", "Session Cookie Exposure",
     "Flask versions prior to 2.2.5 may expose session cookies.",
     "Upgrade to flask@2.2.5 or later"),
    ("python", "numpy", "1.22.0", "warning", "CVE-2021-41496", "Buffer Overflow",
     "NumPy versions prior to 1.22.0 are vulnerable to buffer overflow.",
     "Upgrade to numpy@1.22.0 or later"),
    ("python", "paramiko", "2.10.1", "error", "CVE-2022-24302", "Race Condition",
     "Paramiko versions prior to 2.10.1 are vulnerable to race condition.",
     "Upgrade to paramiko@2.10.1 or later"),
    ("java", "log4j", "2.17.1", "error", "CVE-2021-44228", "Log4Shell RCE",
     "Log4j versions prior to 2.17.1 are vulnerable to remote code execution (Log4Shell).",
     "Upgrade to log4j@2.17.1 or later immediately!"),
    ("java", "spring-core", "5.3.18", "error", "CVE-2022-22965", "Spring4Shell RCE",
     "Spring Framework versions prior to 5.3.18 are vulnerable to RCE (Spring4Shell).",
     "Upgrade to spring-core@5.3.18 or later"),
    ("java", "jackson-databind", "2.13.4.1", "error", "CVE-2022-42003", "DoS",
     "Jackson-databind versions prior to 2.13.4.1 are vulnerable to DoS.",
     "Upgrade to jackson-databind@2.13.4.1 or later"),
    ("rust", "serde", "1.0.149", "warning", "CVE-2022-43660", "Stack Overflow",
     "Serde versions prior to 1.0.149 are vulnerable to stack overflow.",
     "Upgrade to serde@1.0.149 or later"),
    ("go", "golang.org/x/crypto", "0.0.0-20220622213112", "error", "CVE-2022-27191", "DoS",
     "x/crypto versions prior to 0.0.0-20220622213112 are vulnerable to DoS.",
     "Upgrade to golang.org/x/crypto@latest"),
]
# Licenses by risk.
LICENSE_RISKS = {
    "high": ["GPL-3.0", "AGPL-3.0", "SSPL", "CC-BY-NC-SA"],
    "medium": ["GPL-2.0", "LGPL-3.0", "MPL-2.0", "EPL-1.0"],
    "low": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"],
    "unknown": ["UNKNOWN", "UNLICENSED"],
}


def advisory_rows() -> list[tuple]:
    """(language, package, below_version, severity, cve, title, description, fix)."""
    return list(ADVISORIES)


ADVISORY_SCHEMA = (
    "language string, package string, below_version string, severity string, cve string, "
    "title string, description string, fix string"
)


def advisories_table(spark):
    return spark.createDataFrame(advisory_rows(), ADVISORY_SCHEMA)


def license_table(spark):
    rows = [(name.upper(), risk) for risk, names in LICENSE_RISKS.items() for name in names]
    return spark.createDataFrame(rows, "license_key string, risk string")


# Manager, lock file, other lock file, language, install command.
PACKAGE_MANAGERS = [
    ("npm", "package-lock.json", "yarn.lock", "javascript", "npm install"),
    ("yarn", "yarn.lock", None, "javascript", "yarn install"),
    ("pip", "requirements.txt", "Pipfile.lock", "python", "pip install -r requirements.txt"),
    ("pipenv", "Pipfile.lock", None, "python", "pipenv install"),
    ("poetry", "poetry.lock", None, "python", "poetry install"),
    ("maven", "pom.xml", None, "java", "mvn install"),
    ("gradle", "build.gradle", "build.gradle.kts", "java", "gradle build"),
    ("cargo", "Cargo.lock", None, "rust", "cargo build"),
    ("go", "go.sum", None, "go", "go mod download"),
    ("composer", "composer.lock", None, "php", "composer install"),
    ("bundle", "Gemfile.lock", None, "ruby", "bundle install"),
]
MANAGER_SCHEMA = "manager string, lock_file string, other_lock_file string, language string, install_command string"
# Files that name a project's installer, first one wins.
INSTALLER_FILES = [
    ("pnpm-lock.yaml", "pnpm install"), ("yarn.lock", "yarn install"), ("bun.lockb", "bun install"),
    ("bun.lock", "bun install"), ("package-lock.json", "npm install"), ("package.json", "npm install"),
    ("uv.lock", "uv sync"), ("poetry.lock", "poetry install"), ("Pipfile.lock", "pipenv install"),
    ("requirements.txt", "pip install -r requirements.txt"), ("Cargo.toml", "cargo build"),
    ("go.mod", "go mod download"), ("pom.xml", "mvn dependency:resolve"), ("build.gradle", "gradle build"),
    ("build.gradle.kts", "gradle build"),
]
# Folders that hold installed packages, by language; the first names the issue.
MODULE_FOLDERS = {
    "javascript": ["node_modules"], "python": ["site-packages", "dist-packages"], "java": ["target", "build"],
    "rust": ["target"], "go": ["pkg"], "php": ["vendor"], "ruby": ["vendor"],
}
VENV_FOLDERS = ["venv", ".venv", "env", ".env", "virtualenv"]
