"""Framework, compliance, further-language, line, deep-check, taint and term packs."""

from __future__ import annotations

from .model import Rule

PY = ("python",)
WEB = ("typescript", "javascript")

# Rule, languages, severity, pattern, flags, message, framework.
_FRAMEWORK = [
    ("django-sql-injection-exclude", PY, "error",
     r"\.objects\.exclude\(\s*\*\*\{[^:}]*(?:contains|startswith|endswith|regex)[^:}]*:", "i",
     "Django exclude 使用用户输入可能导致 SQL 注入", "django"),
    ("django-xss-mark-safe", PY, "error", r"\bmark_safe\s*\([^)]+\)", "", "对用户输入使用 mark_safe 可能导致 XSS", "django"),
    ("django-insecure-password-hash", PY, "warning",
     r"\bmake_password\s*\([^)]*hasher\s*=\s*['\"]?(?:md5|sha1|crypt)[^)]*\)", "", "使用弱密码哈希算法", "django"),
    ("django-missing-csrf", PY, "warning", r"@csrf_exempt\s*\n\s*def\s+\w+\s*\(\s*request\b", "",
     "视图使用 @csrf_exempt 禁用 CSRF 保护", "django"),
    ("flask-debug-enabled", PY, "error", r"\bapp\.run\(\s*debug\s*=\s*True\s*\)", "", "生产环境不应启用 debug 模式", "flask"),
    ("flask-sql-injection", PY, "error", r"\bdb\.session\.execute\(\s*f\"SELECT[^\"]*\"", "",
     "Flask 中使用 f-string 构建 SQL 查询", "flask"),
    ("flask-session-fixation", PY, "warning",
     r"@app\.route\(\s*['\"]/login['\"]\s*\)\s*\n\s*def\s+login\(\s*\)\s*:\s*\n\s*session\[['\"]user['\"]\]\s*=", "",
     "登录后应重新生成 session ID 防止 session 固定攻击", "flask"),
    ("react-dangerous-html-user-input", WEB, "error",
     r"<div\s+dangerouslySetInnerHTML=\{\{\s*__html:[^}]*(?:user|input|content)[^}]*\}\}\s*/>", "",
     "对用户输入使用 dangerouslySetInnerHTML", "react"),
    ("react-eval-user-input", WEB, "error", r"\beval\([^)]+\)", "", "eval 用户输入极其危险", "react"),
    ("react-missing-prop-types", WEB, "info", r"\bfunction\s+\w+\s*\(\s*\w+\s*\)\s*\{", "",
     "组件缺少 PropTypes 或 TypeScript 类型定义", "react"),
    ("vue-v-html-user-input", WEB, "error", r"<div\s+v-html=\"[^\"]*\"\s*>\s*</div>", "",
     "对用户输入使用 v-html 可能导致 XSS", "vue"),
    ("vue-missing-prop-validation", WEB, "info", r"\bprops\s*:\s*\{\s*\w+\s*:\s*\w+\s*,?\s*\}", "", "Props 缺少验证", "vue"),
    ("spring-sql-injection", ("java",), "error", r"@Query\(\s*\"SELECT[^\"]*WHERE[^\"]*=\s*#\{[^}\"]*\}[^\"]*\"\s*\)", "",
     "Spring Data JPQL 中使用 SpEL 可能导致 SQL 注入", "spring"),
    ("spring-path-traversal", ("java",), "error",
     r"@GetMapping\(\s*\"/\{path\}\"\s*\)[^}]*new\s+FileSystemResource\(\s*path\s*\)", "",
     "路径变量直接使用可能导致路径遍历", "spring"),
    ("spring-csrf-disabled", ("java",), "warning", r"\bhttp\.csrf\(\)\.disable\(\)", "", "禁用 CSRF 保护", "spring"),
    ("express-xss-send", WEB, "warning", r"\bres\.send\([^)]+\)", "", "直接发送用户输入可能导致 XSS", "express"),
    ("express-path-traversal", WEB, "error", r"\bres\.sendFile\([^)]+\)", "",
     "res.sendFile 使用用户输入可能导致路径遍历", "express"),
    ("express-missing-rate-limit", WEB, "warning", r"\bapp\.post\(\s*['\"]/login['\"]\s*,(?!\s*rateLimiter\b)", "",
     "登录接口缺少速率限制", "express"),
]
# Rule, severity, pattern, flags, message, standard.
_COMPLIANCE_TEXT = [
    ("gdpr-personal-data-in-logs", PY, "error",
     r"\blogging\.\w+\(\s*f\"[^\"]*\{[^}\"]*(?:email|phone|password|ssn|credit_card|address)[^}\"]*\}", "i",
     "日志中记录个人数据违反 GDPR 第 5 条 - 数据最小化原则", "GDPR"),
    ("gdpr-hardcoded-personal-data", ("python", "javascript", "typescript"), "error",
     r"\b\w*(?:email|phone|address|passport|ssn)\w*\s*=\s*\"[^\"\n]*\"", "i",
     "代码中硬编码个人数据违反 GDPR 第 25 条 - 设计保护数据", "GDPR"),
    ("hipaa-insecure-phi-transmission", PY, "error",
     r"\brequests\.\w+\(\s*\"http://[^\"]*(?:patient|health|medical)[^\"]*\"", "",
     "通过 HTTP 传输健康信息违反 HIPAA 安全规则", "HIPAA"),
    ("pci-weak-crypto-for-card-data", PY, "error", r"\bhashlib\.(?:md5|sha1)\([^)]+\)", "",
     "使用弱加密算法处理卡数据违反 PCI-DSS 要求 3.5", "PCI-DSS"),
    ("pci-logging-card-data", PY, "error", r"\blogging\.\w+\(\s*f\"[^\"]*\{(?:card|pan|cvv|pin)[^}\"]*\}", "i",
     "日志中记录卡数据违反 PCI-DSS 要求 3.2", "PCI-DSS"),
    ("privacy-insecure-data-transfer", PY, "warning",
     r"\bdef\s+transfer_data\([^)]*\)\s*:\s*\n\s*send\([^)]*protocol\s*=\s*\"http\"\s*\)", "",
     "使用不安全协议传输数据违反数据隐私最佳实践", "Privacy"),
]
# Rule, kind of unit, severity, name regex, body must have, body must lack, message, standard.
COMPLIANCE_BODIES = [
    ("gdpr-missing-consent-check", "function", "warning", r"^process_personal_data$", "", r"\.consent\b",
     "处理个人数据前未检查用户同意，违反 GDPR 第 6 条 - 合法性", "GDPR"),
    ("gdpr-data-retention-violation", "function", "warning", r"^store_user_data$", "", r"schedule_deletion\(",
     "存储个人数据未设置保留期限，违反 GDPR 第 5 条 - 存储限制", "GDPR"),
    ("hipaa-unencrypted-phi-storage", "function", "error", r"^save_patient_data$", r"db\.save\(", r"encrypt\(",
     "患者健康信息 (PHI) 未加密存储违反 HIPAA 安全规则", "HIPAA"),
    ("hipaa-missing-access-logs", "function", "error", r"^access_patient_record$", r"db\.get\(", r"log_access\(",
     "访问患者记录未记录审计日志违反 HIPAA 安全规则", "HIPAA"),
    ("hipaa-missing-ba-agreement-check", "function", "warning", r"^share_with_third_party$", r"send_to_external\(", r"has_baa_agreement\(",
     "与第三方共享 PHI 前未验证 BAA 协议违反 HIPAA", "HIPAA"),
    ("pci-plaintext-card-storage", "function", "error", r"^save_card$", r"db\.save\(", r"mask_card\(",
     "明文存储银行卡号违反 PCI-DSS 要求 3.4", "PCI-DSS"),
    ("pci-missing-access-control", "function", "warning", r"^process_payment$", "", r"has_permission\(",
     "支付处理缺少访问控制违反 PCI-DSS 要求 7.1", "PCI-DSS"),
    ("soc2-missing-encryption-at-rest", "function", "warning", r"^save_sensitive_data$", r"file\.write\(", r"encrypt\(",
     "敏感数据未加密存储违反 SOC2 控制 CC6.1", "SOC2"),
    ("soc2-missing-mfa", "function", "warning", r"^authenticate$", r"check_password\(", r"verify_mfa\(",
     "认证缺少多因素认证 (MFA) 违反 SOC2 控制 CC6.2", "SOC2"),
    ("soc2-missing-change-tracking", "function", "warning", r"^update_config$", r"db\.update\(", r"audit_log\.log\(",
     "配置变更未记录审计跟踪违反 SOC2 控制 CC7.2", "SOC2"),
    ("privacy-missing-data-classification", "class", "info", r"User|Customer|Patient|Member", "", r"# Classification: PERSONAL_DATA",
     "包含个人数据的类缺少数据分类标签", "Privacy"),
    ("privacy-missing-data-deletion", "function", "warning", r"^delete_user$", r"db\.delete\(", r"cache\.delete\([^)]*\)[\s\S]*backup\.mark_for_deletion\(",
     "用户删除未清理所有系统违反 GDPR 第 17 条 - 删除权", "GDPR"),
]
# Rule, language, severity, pattern, flags, message.
_LANGUAGE_EXTENSIONS = [
    ("swift-insecure-nsuserdefaults", "swift", "error",
     r"\bUserDefaults\.standard\.set\(\s*(?:password|token|secret|key)\w*\s*,\s*forKey\s*:", "i", "不应在 UserDefaults 中存储敏感数据"),
    ("swift-weak-crypto", "swift", "warning", r"\bCC_(?:MD5|SHA1)\(", "", "使用弱加密算法 (MD5/SHA1)"),
    ("swift-hardcoded-secret", "swift", "error", r"\blet\s+\w*(?:password|apikey|secret|token)\w*\s*=\s*\"[^\"\n]*\"", "i", "硬编码的密钥"),
    ("swift-uiwebview-deprecated", "swift", "warning", r"\bUIWebView\(", "", "UIWebView 已废弃，存在安全风险，应使用 WKWebView"),
    ("kotlin-sql-injection", "kotlin", "error", r"\bdb\.rawQuery\(\s*\"SELECT[^\"]*WHERE[^\"]*=\s*\$\w+[^\"]*\"", "", "SQL 注入风险"),
    ("kotlin-hardcoded-secret", "kotlin", "error", r"\bconst\s+val\s+\w*(?:password|apikey|secret|token)\w*\s*=\s*\"[^\"\n]*\"", "i", "硬编码的密钥"),
    ("kotlin-insecure-random", "kotlin", "warning", r"\bfun\s+generateToken\(\s*\)[^{]*\{[^}]*\bRandom\.nextInt\(\)", "",
     "java.util.Random 不适合安全场景"),
    ("kotlin-missing-null-check", "kotlin", "warning", r"\w+!!\.\w+\(", "", "使用 !! 可能抛出 NullPointerException"),
    ("ruby-sql-injection", "ruby", "error", r"\b\w+\.(?:where|find_by_sql)\(\s*\"[^\"]*#\{[^}\"]*\}[^\"]*\"", "", "SQL 注入风险"),
    ("ruby-eval-user-input", "ruby", "error", r"\beval\([^)]+\)", "", "eval 用户输入极其危险"),
    ("ruby-weak-crypto", "ruby", "warning", r"\bDigest::(?:MD5|SHA1)\.hexdigest\(", "", "使用弱加密算法"),
    ("ruby-hardcoded-secret", "ruby", "error", r"\b\w*(?:password|apikey|secret|token)\w*\s*=\s*\"[^\"\n]*\"", "i", "硬编码的密钥"),
    ("php-sql-injection", "php", "error", r"(?:mysqli_query\(\s*\$\w+\s*,|\$\w+->query\()\s*\"SELECT[^\"]*WHERE[^\"]*=\s*\$\w+[^\"]*\"", "", "SQL 注入风险"),
    ("php-xss-echo", "php", "warning", r"\b(?:echo|print)\s+\$\w+", "", "直接输出用户输入可能导致 XSS"),
    ("php-command-injection", "php", "error", r"\b(?:system|exec|shell_exec)\(\s*\$\w+\s*\)", "", "命令注入风险"),
    ("php-weak-crypto", "php", "warning", r"\b(?:md5|sha1)\([^)]+\)", "", "使用弱加密算法"),
    ("php-hardcoded-secret", "php", "error", r"\$(?:password|api_key)\s*=\s*\"[^\"\n]*\"\s*;", "", "硬编码的密钥"),
]
# Pattern, message, suggestion; one hit per line at most, severity error.
LINE_SECURITY = [
    (r'f"SELECT.*\{', "🔴 SQL 注入风险 - 请使用参数化查询",
     '使用参数化查询：cursor.execute("SELECT * FROM users WHERE id = %s", (user_id,))'),
    (r"eval\(", "🔴 eval 使用风险 - 避免使用 eval", "使用 ast.literal_eval() 或其他安全方法"),
    (r'password\s*=\s*"', "🔴 硬编码密码 - 使用环境变量", '使用环境变量：import os; password = os.environ.get("PASSWORD")'),
    (r'api_key\s*=\s*"', "🔴 硬编码 API 密钥 - 使用环境变量", '使用环境变量：import os; api_key = os.environ.get("API_KEY")'),
]
# Pattern, message; severity major, every hit.
DEEP_SECURITY = [
    (r"eval\s*\(", "使用 eval() 可能导致代码注入"),
    (r"exec\s*\(", "使用 exec() 可能导致代码注入"),
    (r"os\.system\s*\(", "使用 os.system() 可能导致命令注入"),
    (r"subprocess\.call\s*\([^)]*shell\s*=\s*True", "使用 shell=True 可能导致命令注入"),
    (r"pickle\.loads?\s*\(", "使用 pickle 可能导致不安全反序列化"),
    (r"yaml\.load\s*\([^)]*\)", "使用 yaml.load() 可能导致不安全反序列化"),
    (r"input\s*\([^)]*\)\s*eval", "用户输入直接用于 eval"),
    (r"__import__\s*\(", "动态导入可能导致安全风险"),
]
# Names whose quoted values count as secrets.
DEEP_SECRET_NAMES = ["password", "api_key", "secret", "token"]
# Taint sources, and sinks as (pattern, name, weakness id).
TAINT_SOURCES = [
    r"request\.(args|form|json|cookies|headers)",
    r"input\(",
    r"sys\.argv\[\d+\]",
    r"os\.environ\[\"([^\"]+)\"\]",
    r"open\(([^\")]+)\.read\(\)",
]
TAINT_SINKS = [
    (r"execute\(.*?\)", "SQL 执行", "CWE-89"),
    (r"eval\(.*?\)", "代码执行", "CWE-95"),
    (r"exec\(.*?\)", "代码执行", "CWE-95"),
    (r"os\.system\(.*?\)", "命令执行", "CWE-78"),
    (r"subprocess\.(call|run|Popen)\(.*?\)", "命令执行", "CWE-78"),
    (r"__import__\(.*?\)", "动态导入", "CWE-95"),
    (r"soup\(.*?\)", "HTML 解析", "CWE-79"),
    (r"render_template_string\(.*?\)", "模板注入", "CWE-94"),
]
SINK_ADVICE = {
    "SQL 执行": "使用参数化查询，避免字符串拼接",
    "代码执行": "避免使用 eval/exec，使用安全的替代方案",
    "命令执行": "使用 subprocess 并禁用 shell=True",
    "动态导入": "使用白名单控制可导入模块",
    "HTML 解析": "使用 bleach 或 DOMPurify 清理输入",
    "模板注入": "避免使用 render_template_string，传递变量而非字符串",
}
# Sensitive terms by severity.
SENSITIVE_TERMS = {
    "CRITICAL": ["password", "secret", "token", "api_key"],
    "HIGH": ["execute", "eval", "system", "sql"],
    "MEDIUM": ["credential", "shell", "query", "database", "encrypt", "decrypt", "hash", "cipher"],
}

FRAMEWORK = [
    Rule("framework", rule, pattern, flags, severity, "security", message, languages=languages,
         metadata={"framework": framework})
    for rule, languages, severity, pattern, flags, message, framework in _FRAMEWORK
]
COMPLIANCE_TEXT = [
    Rule("compliance", rule, pattern, flags, severity, "compliance", message, languages=languages,
         metadata={"compliance": standard})
    for rule, languages, severity, pattern, flags, message, standard in _COMPLIANCE_TEXT
]
LANGUAGE_EXTENSIONS = [
    Rule("language-extension", rule, pattern, flags, severity, "security", message, languages=(language,))
    for rule, language, severity, pattern, flags, message in _LANGUAGE_EXTENSIONS
]
DEEP_CHECK = [
    Rule("deep-check", "security-pattern", pattern, "", "major", "security", "安全问题：" + message)
    for pattern, message in DEEP_SECURITY
]
