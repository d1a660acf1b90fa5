"""Security packs: general families, Python, JavaScript, and four tool-style packs."""

from __future__ import annotations

import re

from .model import Rule

# Family -> (pattern, message, severity, anchors); every pattern ignores case.
_FAMILIES = {
    "sqlInjection": [
        (r"execute\s*\(\s*[\"'`][^\"'`]*%[sd][^\"'`]*[\"'`]\s*[,)]",
         "Potential SQL injection: parameterized formatting without prepared statement", "error", "execute"),
        (r"execute\s*\(\s*[\"'`].*?\+\s*(?:query|sql|query_string|param)",
         "Potential SQL injection: string concatenation with variables", "error", "execute"),
        (r"(?:query|execute|prepare)\s*\(\s*[`][^`]*\$\{[^}]+\}[^`]*[`]",
         "Potential SQL injection: template literal with variable interpolation", "error", "${"),
        (r"FROM\s+\w+\s+WHERE\s+\w+\s*[=<>!]+\s*(?:request\.|req\.|input\.|user_|param|arg)",
         "Potential SQL injection: direct use of user input in WHERE clause", "error", "where"),
    ],
    "xss": [
        (r"innerHTML\s*=\s*", "Potential XSS: using innerHTML can execute arbitrary scripts", "warning", "innerhtml"),
        (r"document\.write\s*\(", "Potential XSS: document.write can execute arbitrary scripts", "warning", "document.write"),
        (r"eval\s*\(", "Potential XSS/Security: eval() executes arbitrary code", "error", "eval"),
        (r"new\s+Function\s*\(", "Potential XSS: Function constructor executes arbitrary code", "error", "function"),
        (r"\$\(.*\)\.html\s*\(", "Potential XSS: jQuery .html() can execute scripts", "warning", ").html"),
    ],
    "commandInjection": [
        (r"exec\s*\(\s*[\"'].*\$\{.*\}", "Potential command injection: template literal in exec()", "error", "exec"),
        (r"execSync\s*\(\s*[\"'].*\+", "Potential command injection: string concatenation in execSync()", "error", "execsync"),
        (r"spawn\s*\(\s*[\"'].*\+", "Potential command injection: string concatenation in spawn()", "error", "spawn"),
        (r"child_process\s*\.\s*exec\s*\(",
         "Security concern: child_process.exec can be dangerous with user input", "warning", "child_process"),
    ],
    "pathTraversal": [
        (r"readFile\s*\(\s*[\"'].*\+", "Potential path traversal: dynamic file path construction", "warning", "readfile"),
        (r"readFileSync\s*\(\s*[\"'].*\+", "Potential path traversal: dynamic file path construction", "warning", "readfilesync"),
        (r"fs\s*\.\s*writeFile\s*\(\s*[\"'].*\+", "Potential path traversal: dynamic file path in writeFile", "warning", "writefile"),
    ],
    "hardcodedCredentials": [
        (r"password\s*[:=]\s*[\"'][^\"']{4,}[\"']", "Security: potential hardcoded password detected", "error", "password"),
        (r"passwd\s*[:=]\s*[\"'][^\"']{4,}[\"']", "Security: potential hardcoded password detected", "error", "passwd"),
        (r"secret\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Security: potential hardcoded secret detected", "error", "secret"),
        (r"api[_-]?key\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Security: potential hardcoded API key detected", "error", "api"),
        (r"token\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Security: potential hardcoded token detected", "error", "token"),
        (r"AWS[_A-Z]*KEY", "Security: potential AWS credential in code", "error", "aws"),
    ],
    "weakCrypto": [
        (r"md5\s*\(", "Security: MD5 is cryptographically weak, use SHA-256 or better", "warning", "md5"),
        (r"sha1\s*\(", "Security: SHA-1 is cryptographically weak, use SHA-256 or better", "warning", "sha1"),
        (r"createHash\s*\(\s*[\"']md5[\"']", "Security: MD5 is cryptographically weak", "warning", "createhash"),
        (r"createHash\s*\(\s*[\"']sha1[\"']", "Security: SHA-1 is cryptographically weak", "warning", "createhash"),
        (r"DES", "Security: DES encryption is weak, use AES", "warning", "des"),
        (r"RC4", "Security: RC4 encryption is weak, use AES", "warning", "rc4"),
    ],
    "insecureRandom": [
        (r"Math\.random\s*\(", "Security: Math.random() is not cryptographically secure", "warning", "math.random"),
        (r"Random\s*\(\s*\)", "Security: java.util.Random is not cryptographically secure", "warning", "random"),
    ],
    "infoDisclosure": [
        (r"console\.log\s*\([^)]*password[^)]*\)", "Security: potential password logged to console", "error", "console.log"),
        (r"console\.log\s*\([^)]*secret[^)]*\)", "Security: potential secret logged to console", "error", "console.log"),
        (r"alert\s*\(", "Security: alert() can expose sensitive information", "hint", "alert"),
    ],
    "insecureHttp": [
        (r"http://(?!localhost|127\.0\.0\.1)", "Security: using insecure HTTP protocol, consider HTTPS", "warning", "http://"),
        (r"verify\s*:\s*false", "Security: SSL/TLS verification disabled", "error", "verify"),
        (r"rejectUnauthorized\s*:\s*false", "Security: SSL/TLS certificate verification disabled", "error", "rejectunauthorized"),
    ],
    "prototypePollution": [
        (r"__proto__", "Security: __proto__ access can lead to prototype pollution", "warning", "__proto__"),
        (r"constructor\s*\.\s*prototype", "Security: direct prototype modification detected", "warning", "constructor"),
    ],
    "unsafeDeserialization": [
        (r"unserialize\s*\(", "Security: unserialize() can be dangerous with untrusted data", "warning", "unserialize"),
        (r"pickle\.loads?\s*\(", "Security: pickle.loads() can execute arbitrary code", "error", "pickle.load"),
        (r"yaml\.load\s*\(", "Security: yaml.load() can be dangerous, use yaml.safe_load()", "warning", "yaml.load"),
    ],
}

# Rule, pattern, flags, severity, category, message, anchors.
_PYTHON = [
    ("security-unsafe-pickle", r"pickle\.loads?\s*\(", "", "error", "security",
     "pickle.loads() can execute arbitrary code. Use json or other safe formats.", "pickle.load"),
    ("security-unsafe-yaml", r"yaml\.load\s*\((?:(?!Loader=)[^)])*+\)", "", "error", "security",
     "yaml.load() without Loader parameter is unsafe. Use yaml.safe_load() instead.", "yaml.load"),
    ("security-hardcoded-password", r"password\s*=\s*[\"'][^\"']+[\"']", "i", "error", "security",
     "Potential hardcoded password detected. Use environment variables.", "password"),
    ("security-assert-usage", r"^\s*assert\s+", "m", "warning", "security",
     "Assert statements can be disabled with -O flag. Do not use for security validation.", "assert"),
    ("security-raw-input", r"\binput\s*\(\s*\)", "", "hint", "security",
     "input() returns a string. Validate and sanitize user input.", "input"),
]
_JAVASCRIPT = [
    ("security-unsafe-json-parse", r"JSON\.parse\s*\(\s*[^)]*responseText", "", "hint", "security",
     "Ensure response data is from a trusted source before parsing", "responsetext"),
    ("security-postmessage-usage", r"postMessage\s*\(", "", "warning", "security",
     "postMessage should validate origin. Use specific targetOrigin.", "postmessage"),
    ("security-sensitive-storage", r"localStorage\.(setItem|getItem)\s*\([^)]*(password|secret|token|key)[^)]*\)",
     "i", "warning", "security", "Avoid storing sensitive data in localStorage", "localstorage."),
]
_BANDIT = [
    ("B101-assert_used", r"^\s*assert\s+", "m", "error", "security",
     "Assert statement detected. Asserts can be disabled with -O flag and should not be used for security validation.", "assert"),
    ("B102-exec_used", r"\bexec\s*\(", "", "error", "security",
     "Use of exec() detected. This can execute arbitrary code and is a security risk.", "exec"),
    ("B103-set_bad_file_permissions", r"os\.chmod\s*\([^,]+,\s*0o7", "", "warning", "security",
     "World-executable file permission detected. Consider restricting permissions.", "os.chmod"),
    ("B104-hardcoded_bind_all_interfaces", r"['\"]0\.0\.0\.0['\"]", "", "warning", "security",
     "Possible binding to all network interfaces (0.0.0.0).", "0.0.0.0"),
    ("B105-hardcoded_password_string", r"password\s*=\s*['\"][^'\"]+['\"]", "i", "error", "security",
     "Possible hardcoded password detected.", "password"),
    ("B108-hardcoded_tmp_directory", r"['\"]/tmp['\"]", "", "warning", "security",
     "Use of hardcoded temporary directory. Consider using tempfile module.", "/tmp"),
    ("B110-try_except_pass", r"except\s*[^:]*:\s*\n\s*pass", "", "warning", "quality",
     "Except block with pass detected. Consider handling the exception.", "pass"),
    ("B112-try_except_continue", r"except\s*[^:]*:\s*\n\s*continue", "", "warning", "quality",
     "Except block with continue detected. Consider handling the exception.", "continue"),
    ("B113-request_without_timeout", r"requests\.(get|post|put|delete)\s*\([^)]*\)(?![^)]*timeout)", "", "warning", "security",
     "Requests call without timeout detected. This can lead to hanging connections.", "requests."),
    ("B201-flask_debug_true", r"app\.run\s*\([^)]*debug\s*=\s*True", "", "error", "security",
     "Flask app running with debug=True. Never deploy with debug mode enabled.", "app.run"),
    ("B324-hashlib_weak", r"hashlib\.(md5|sha1)\s*\(", "", "warning", "security",
     "Use of weak hash algorithm (MD5/SHA1). Consider using SHA-256 or stronger.", "hashlib."),
    ("B501-request_with_no_cert_validation", r"verify\s*=\s*False", "", "error", "security",
     "SSL certificate verification disabled. This is insecure.", "verify"),
    ("B503-ssl_with_bad_defaults", r"ssl\.create_default_context\s*\(\)", "", "hint", "security",
     "SSL context created with default settings. Consider configuring security settings.", "ssl.create_default_context"),
    ("B506-yaml_load", r"yaml\.load\s*\([^)]*\)(?![^)]*Loader)", "", "error", "security",
     "yaml.load() without safe Loader. Use yaml.safe_load() instead.", "yaml.load"),
    ("B601-paramiko_calls", r"paramiko\.(SSHClient|exec_command)", "", "hint", "security",
     "Paramiko call detected. Ensure proper validation of inputs.", "paramiko."),
    ("B602-subprocess_popen_with_shell_equals_true", r"subprocess\.(popen|call|run)\s*\([^)]*shell\s*=\s*True", "i", "error", "security",
     "Subprocess with shell=True detected. This can lead to command injection.", "subprocess."),
    ("B604-any_function_with_shell_equals_true", r"os\.(system|popen|spawn)\s*\(", "", "error", "security",
     "OS command execution detected. Validate all inputs.", "os."),
    ("B608-hardcoded_sql_expressions", r"(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE)\s+.*\+", "i", "error", "security",
     "Possible SQL injection via string concatenation.", "select|insert|update|delete|drop|create"),
    ("B701-jinja2_autoescape_false", r"jinja2\.Environment\s*\([^)]*autoescape\s*=\s*False", "", "error", "security",
     "Jinja2 autoescape disabled. This can lead to XSS vulnerabilities.", "jinja2.environment"),
    ("B703-django_mark_safe", r"mark_safe\s*\(", "", "warning", "security",
     "mark_safe() used. Ensure content is properly sanitized to prevent XSS.", "mark_safe"),
]
_ESLINT = [
    ("security/detect-object-injection", r"\[\s*[^0-9][^\]]*\s*\]\s*=", "", "warning", "security",
     "Object injection detected. Use bracket notation carefully with validated keys.", "["),
    ("security/detect-non-literal-fs-filename",
     r"fs\.(readFile|writeFile|appendFile|createReadStream|createWriteStream)\s*\([^)]*\+", "", "warning", "security",
     "Non-literal file path in fs operation. Validate file paths to prevent path traversal.", "fs."),
    ("security/detect-unsafe-regex", r"/\([^)]*\+[^)]*\+[^)]*\*\)", "", "warning", "security",
     "Potentially unsafe regex detected. This could lead to ReDoS attacks.", "/("),
    ("security/detect-buffer-noassert", r"Buffer\.(read|write)[^(]+\s*,\s*[^,]+,\s*true", "", "error", "security",
     "Buffer noAssert mode detected. This can lead to out-of-bounds access.", "buffer."),
    ("security/detect-child-process", r"child_process\.(exec|spawn|fork)", "", "warning", "security",
     "Child process detected. Validate all inputs to prevent command injection.", "child_process."),
    ("security/detect-disable-mustache-escape", r"escapeMarkup\s*:\s*false", "", "error", "security",
     "Mustache escape disabled. This can lead to XSS vulnerabilities.", "escapemarkup"),
    ("security/detect-eval-with-expression", r"eval\s*\(\s*[^'\"]", "", "error", "security",
     "Eval with expression detected. This can execute arbitrary code.", "eval"),
    ("security/detect-no-csrf-before-method-override", r"methodOverride", "", "hint", "security",
     "methodOverride detected. Ensure CSRF protection is applied before it.", "methodoverride"),
    ("security/detect-non-literal-regexp", r"RegExp\s*\([^)'\"/]+", "", "warning", "security",
     "Non-literal RegExp detected. Validate input to prevent ReDoS.", "regexp"),
    ("security/detect-non-literal-require", r"require\s*\(\s*[^'\"]", "", "warning", "security",
     "Non-literal require detected. This can lead to arbitrary module loading.", "require"),
    ("security/detect-possible-timing-attacks", r"===\s*['\"][^'\"]+['\"]", "", "hint", "security",
     "Possible timing attack. Use timing-safe comparison for sensitive data.", "==="),
    ("security/detect-pseudoRandomBytes", r"pseudoRandomBytes", "", "warning", "security",
     "PseudoRandomBytes detected. Not suitable for cryptographic purposes.", "pseudorandombytes"),
    ("security/detect-new-buffer", r"new\s+Buffer\s*\(", "", "error", "security",
     "new Buffer() is deprecated. Use Buffer.alloc() or Buffer.from().", "buffer"),
    ("security/detect-no-crypto", r"require\s*\(\s*['\"]crypto['\"]\s*\)", "", "hint", "security",
     "Crypto module usage detected. Ensure proper implementation.", "crypto"),
    ("security/detect-object-injection-array", r"Array\.prototype\.[a-z]+\s*=", "", "warning", "security",
     "Array prototype modification detected. This can cause conflicts.", "array.prototype."),
]
_SONAR = [
    ("sonar-too-many-parameters", r"function\s+\w+\s*\([^)]{100,}\)", "", "warning", "maintainability",
     "Function has too many parameters. Consider using an options object.", "function"),
    ("sonar-dead-code", r"return\s*;[\s\S]*?(?=\n\s*\})", "", "error", "quality",
     "Unreachable code after return statement.", "return"),
    ("sonar-unused-variable", r"(?:const|let|var)\s+\w+\s*=\s*[^;]+;(?=\W*\z)", "", "warning", "quality",
     "Variable declared but never used.", "const|let|var"),
    ("sonar-too-many-imports", r"^(import\s+.*;){10,}", "m", "hint", "maintainability",
     "Too many imports. Consider splitting this module.", "import"),
    ("sonar-magic-string", r"['\"][a-zA-Z]{10,}['\"]", "", "hint", "maintainability",
     "Magic string detected. Consider using a named constant.", ""),
    ("sonar-too-deep-nesting", r"^\s{16,}", "m", "warning", "complexity",
     "Deep nesting detected (>4 levels). Consider refactoring.", ""),
    ("sonar-empty-method", r"(public|private|protected)?\s*\w+\s*\([^)]*\)\s*\{\s*\}", "", "hint", "quality",
     "Empty method detected. Consider removing or implementing.", "{"),
    ("sonar-too-many-switch", r"switch\s*\(", "", "hint", "design",
     "Switch statement detected. Consider using polymorphism.", "switch"),
]
SONAR_BRANCHES = (r"\b(if|else if|case)\b", 10, "Too many branches. Consider refactoring with strategy pattern. (Count: {count})")
# Rule, languages, pattern, flags, severity, message, anchors.
_SEMGREP = [
    ("semgrep-generic-sqli", "python javascript java php", r"(SELECT|INSERT|UPDATE|DELETE|DROP).*=.*(\+|f['\"]|format\(|%)", "i", "error",
     "SQL query built using string manipulation. Use parameterized queries instead.", "select|insert|update|delete|drop"),
    ("semgrep-generic-xss", "javascript python php", r"(innerHTML|document\.write|\.html\s*\()", "", "warning",
     "Potential XSS vulnerability. Sanitize user input before rendering.", "innerhtml|document.write|.html"),
    ("semgrep-generic-command-injection", "python javascript php", r"(exec|system|popen|spawn|shell_exec)\s*\([^)]*[\+${]", "", "error",
     "Command injection risk. Avoid shell interpolation with user input.", "exec|system|popen|spawn"),
    ("semgrep-generic-path-traversal", "python javascript java", r"(open|readFile|writeFile|File)\s*\([^)]*[\+${]", "", "warning",
     "Potential path traversal. Validate file paths.", "open|file"),
    ("semgrep-generic-weak-crypto", "python javascript java", r"(md5|sha1|DES|RC4|MD2)\s*\(", "i", "warning",
     "Weak cryptographic algorithm. Use SHA-256 or AES.", "md5|sha1|des|rc4|md2"),
    ("semgrep-generic-hardcoded-secret", "", r"(password|secret|api_key|apikey|token|credential)\s*=\s*['\"][^'\"]{8,}['\"]", "i", "error",
     "Hardcoded secret detected. Use environment variables or a secrets manager.", "password|secret|api_key|apikey|token|credential"),
    ("semgrep-generic-debug-mode", "python javascript php", r"(DEBUG|debug)\s*=\s*(True|true|1)", "i", "error",
     "Debug mode enabled. Disable in production.", "debug"),
    ("semgrep-generic-insecure-random", "python javascript", r"(Math\.random|random\.random|random\.randint)", "", "warning",
     "Insecure random number generator. Use crypto module for security-sensitive operations.", "random"),
    ("semgrep-generic-no-rate-limiting", "javascript python", r"(app\.get|app\.post|@app\.route|@router\.)\s*\([^)]*(login|register|password|api)", "i", "hint",
     "Sensitive endpoint without apparent rate limiting.", "app.get|app.post|@app.route|@router."),
    ("semgrep-generic-unsafe-deserialization", "python java", r"(pickle\.loads?|yaml\.load|ObjectInputStream|readObject)", "", "error",
     "Unsafe deserialization. This can lead to remote code execution.", "pickle.load|yaml.load|objectinputstream|readobject"),
]


# Of a run of word characters the last one decides; first characters are tested before alternatives, and runs give nothing back
# where what follows them cannot be a part of them.
_PROBES = {
    "sonar-empty-method": r"\w\s*\([^)]*\)\s*\{\s*\}",
    "sonar-unused-variable": r"(?=[clv])(?:const|let|var)\s++\w++\s*+=[^;]++;(?=\W*+\z)",
    "sonar-too-many-branches": r"(?=[iec])(?<!\w)(?:if|else if|case)(?!\w)",
    "semgrep-generic-hardcoded-secret": r"(?=[psatc])(?:password|secret|api_key|apikey|token|credential)\s*+=\s*+['\"][^'\"]{8,}+['\"]",
    "semgrep-generic-weak-crypto": r"(?=[msdr])(?:md5|sha1|DES|RC4|MD2)\s*+\(",
}


def _split(anchors: str) -> tuple[str, ...]:
    return tuple(a for a in anchors.split("|") if a)


def _kebab(name: str) -> str:
    return re.sub("([a-z])([A-Z])", r"\1-\2", name).lower()


def _rules(engine, rows, languages=()):
    return [
        Rule(engine, rule, pattern, flags, severity, category, message,
             anchors=_split(anchors), languages=languages, probe=_PROBES.get(rule))
        for rule, pattern, flags, severity, category, message, anchors in rows
    ]


GENERAL = [
    Rule("security", f"security-{_kebab(family)}", pattern, "i", severity, "security", message,
         anchors=_split(anchors), sub_category=family)
    for family, rows in _FAMILIES.items()
    for pattern, message, severity, anchors in rows
]
CREDENTIALS = [r for r in GENERAL if r.sub_category == "hardcodedCredentials"]
PYTHON = _rules("security-python", _PYTHON, ("python",))
JAVASCRIPT = _rules("security-javascript", _JAVASCRIPT, ("javascript", "typescript"))
BANDIT = _rules("bandit", _BANDIT, ("python",))
ESLINT = _rules("eslint-plugin-security", _ESLINT, ("javascript", "typescript"))
SONAR = _rules("sonarqube", _SONAR) + [
    Rule("sonarqube", "sonar-too-many-branches", SONAR_BRANCHES[0], "", "warning", "complexity",
         SONAR_BRANCHES[2], anchors=("if", "case"), kind="threshold", threshold=SONAR_BRANCHES[1],
         probe=_PROBES["sonar-too-many-branches"]),
]
SEMGREP = [
    Rule("semgrep", rule, pattern, flags, severity, "security", message,
         anchors=_split(anchors), languages=tuple(languages.split()), probe=_PROBES.get(rule))
    for rule, languages, pattern, flags, severity, message, anchors in _SEMGREP
]
# Order matters: the first engine to report a spot keeps it.
COMPREHENSIVE = GENERAL + PYTHON + JAVASCRIPT + BANDIT + ESLINT + SONAR + SEMGREP
# The repeat-of-50 rule has its own operator (operators.duplicates).
REPEAT_RULE = Rule("sonarqube", "sonar-duplicate-code", r"(.{50,})\1", "s", "warning", "maintainability",
                   "Possible code duplication detected. Consider extracting common logic.", kind="repeat")
