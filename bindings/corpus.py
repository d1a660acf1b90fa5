"""The driver tables read as files, in Spark and as SQL text for the check.

* ``documents``: one file per row, extension by language.
* ``pages``: one web file per row.
* ``orders``: one source file per row. Its statements come from the list
  below, picked by arithmetic on the row's keys, so the corpus grows with the
  table and every rule pack meets hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import sql_string
from lintlake.sources.files import spread

EXTENSIONS = [
    ".js", ".ts", ".py", ".java", ".go", ".rs", ".php", ".rb", ".kt", ".swift", ".py", ".js", ".c", ".cpp", ".cs", ".sh", ".yaml",
]
LANGUAGES = [
    "javascript", "typescript", "python", "java", "go", "rust", "php", "ruby", "kotlin", "swift",
    "python", "javascript", "c", "cpp", "csharp", "shell", "yaml",
]
DOC_EXT = {"en": ".py", "fr": ".js", "de": ".java", "es": ".go"}
DOC_LANG = {"en": "python", "fr": "javascript", "de": "java", "es": "go"}
PICKS = 9

LONG_WORD = "value_" * 24
STATEMENTS = [
    "console.log(item@N);", "debugger;", "var total@N = @M;", "// TODO: tidy @N", "# FIXME later @N",
    "limit = 86400 + @N", "print(value@N)", "try:\n    load(@N)\nexcept:\n    pass",
    "from os import *", "x@N = \"" + LONG_WORD + "\"", "System.out.println(count@N);",
    "try { load(@N); } catch (Exception e) { }", "done@N();\n\n\n\n\nnext@N();",
    "-- hack @M", "execute(\"select %s from t\", id@N)", "execute('select ' + query)",
    "db.query(`select ${id@N} from t`)", "sql = \"SELECT a FROM users WHERE id = request.id\"",
    "el.innerHTML = body@N;", "document.write(body@N);", "eval(code@N)", "const f@N = new Function(src);",
    "$(sel).html(body@N);", "exec(\"ls ${dir@N}\")", "execSync('rm ' + name@N);", "spawn('git ' + arg@N);",
    "child_process.exec(cmd@N);", "fs.readFile('a/' + name@N, cb);", "fs.readFileSync('b/' + name@N);",
    "fs.writeFile('c/' + name@N, data);", "password = \"hunter@M\"", "passwd: 'open@M sesame'",
    "secret = 'abcdefgh@M'", "api_key = \"0123456789@M\"", "token = 'tok_@M_abcdef'", "AWS_ACCESS_KEY",
    "h = md5(data@N)", "h = sha1(data@N)", "crypto.createHash('md5')", "crypto.createHash(\"sha1\")",
    "cipher = DES.new(k@N)", "stream = RC4(k@N)", "r = Math.random() * @N", "r = new Random()",
    "console.log('pw', password@N)", "alert(msg@N)", "url = 'http://example.org/@N'",
    "url = 'http://localhost:8080/@N'", "{ verify: false }", "{ rejectUnauthorized: false }",
    "o.__proto__ = p@N;", "A.constructor.prototype", "unserialize($data@N);", "pickle.loads(blob@N)",
    "cfg = yaml.load(f@N)", "cfg = yaml.load(f@N, Loader=SafeLoader)", "    assert total@N > 0",
    "name = input()", "JSON.parse(xhr.responseText)", "window.postMessage(m@N, '*');",
    "localStorage.setItem('token', t@N);", "os.chmod(p@N, 0o777)", "host = '0.0.0.0'", "d = '/tmp'",
    "while True:\n    try:\n        step()\n    except ValueError:\n        continue",
    "requests.get(url@N)", "requests.post(url@N, timeout=5)", "app.run(host=h, debug=True)", "app.run(debug=True)",
    "hashlib.md5(b@N)", "requests.get(u, verify=False)", "ssl.create_default_context()",
    "paramiko.SSHClient()", "subprocess.run(cmd, shell=True)", "os.system(cmd@N)",
    "q = \"SELECT * FROM t WHERE id = \" + uid@N", "jinja2.Environment(loader=l, autoescape=False)",
    "mark_safe(html@N)", "table[key@N] = 1", "new RegExp(expr@N)", "require(mod@N)",
    "if (kind === 'admin') { go(@N); }", "crypto.pseudoRandomBytes(8)", "new Buffer(@M)",
    "const c = require('crypto');", "Array.prototype.last = fn;", "app.use(methodOverride());",
    "var re = /(a+b+c*)/;", "buf = Buffer.readInt(a , b@N, true)", "t = { escapeMarkup: false }",
    "function many(" + ", ".join(f"argument{i}" for i in range(12)) + ") { go(); }",
    "function early() {\n    return;\n    go(@N);\n  }", "let s@N = 'abcdefghijklm';",
    "                deep(@N);", "public void noop() { }", "switch (k@N) { case 1: go(); }",
    "\n".join(f"if (a{i}) go({i}); else if (b{i}) stop({i});" for i in range(6)), "DEBUG = True",
    "random.randint(1, 6)", "@app.route('/login')\ndef login():\n    session['user'] = u@N",
    "in.readObject();", "for (let i <= list.length; i++) { go(i); }", "if (a@N = b) { go(); }",
    "while (true) { poll(); }", "if (p !== null) { p.go(); }", "if (v === undefined) { go(); }",
    "for (k in ks) { document.getElementById(k); }", "for (k in ks) { out = [].concat(k); }",
    "el.addEventListener('click', go@N);", "setInterval(tick, @M)", "let kept@N = @M; kept@N = 2;",
    "try { go(); } catch (err) {\n  // ignore\n}", "export async function load@N() { return @M; }",
    "function testLoad@N() { go(); }", "def grow@N(items=[]):\n    \"\"\"Grow.\"\"\"\n    global state\n    return items",
    "for (i) { defer f() }", "let v = r.unwrap();", "r.expect(\"no value\");",
    "Item.objects.exclude(**{name__contains: v@N})", "make_password(p, hasher='md5')",
    "@csrf_exempt\ndef view@N(request):\n    return ok", "db.session.execute(f\"SELECT {col@N}\")",
    "<div dangerouslySetInnerHTML={{__html: userText}} />", "function Card(props) { return 1; }",
    "<div v-html=\"body\"></div>", "props: { size: Number }", "@Query(\"SELECT u FROM U u WHERE u.id = #{id}\")",
    "http.csrf().disable();", "res.send(body@N);", "res.sendFile(name@N);", "app.post('/login', handler@N);",
    "logging.info(f\"mail {email} {card}\")", "admin_email = \"root@example.org\"",
    "requests.post(\"http://h/patient\")", "def transfer_data(a, b):\n    send(a, b, protocol=\"http\")",
    "def process_personal_data(d):\n    return d", "def save_card(n):\n    db.save(n)",
    "class UserRecord@N:\n    name = 1", "UserDefaults.standard.set(passwordText, forKey: \"p\")", "CC_MD5(d, 1, o)",
    "let apiToken = \"abc@M\"", "UIWebView(frame)", "db.rawQuery(\"SELECT a WHERE b = $id\", null)",
    "const val SECRET_A = \"abc@M\"", "fun generateToken() { return Random.nextInt() }", "user!!.name()",
    "User.where(\"id = #{id@N}\")", "Digest::MD5.hexdigest(d@N)", "echo $name;", "system($cmd);",
    "$password = \"abc@M\";", "value = request.args", "key = os.environ[\"HOME\"]",
    "rows = cursor.execute(sql@N)", "@router.get('/items/{id}')\ndef item@N(id):\n    return load(id)",
    "class Box@N extends Shape { area(w) { return w * @M; } }", "def step@N(a, b):\n    if a and b:\n        return step(a)\n    return None",
    "func run@N(a int) { if a > 1 { go() } }", "fn calc@N(a: i32) { match a { _ => 1 } }",
    "import util@N", "import { a } from './mod@K';", "const m = require('./mod@K');", "from pkg.mod@K import fn",
    "class Node@K(Base@J):\n    def get(self):\n        return self.x", "helper@K(arg)\nresult = step@J(1)",
    "def helper@K(x):\n    return helper@J(x) + step@K(x)",
    "fun broken@N( {", "func broken@N( {", "int broken@N( {", "void Broken@N( {", "if [ -f a ]; then",
    "for f in *; do", "fi", "done", ": bad@N", "key@N:value",
]
N = len(STATEMENTS)


def picks(key: str, other: str) -> list[str]:
    """SQL arithmetic for the statement numbers (0-based) of one file."""
    return [f"(({key}) * {2 * j + 1} + ({other}) * {j + 1} + {17 * j}) % {N}" for j in range(PICKS)]


def q(text: str) -> str:
    """SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


def _fill_spark(column):
    for token, value in (("@N", F.col("o_orderkey")), ("@M", F.col("o_custkey") + 1000),
                         ("@K", F.col("o_orderkey") % 50), ("@J", (F.col("o_orderkey") + 7) % 50)):
        column = F.replace(column, F.lit(token), value.cast("string"))
    return column


# A key of each table that is read in bulk; small tables stay as they are.
BULK_KEYS = {
    "documents": ["doc_id"], "pages": ["page_id"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber"],
    "events": ["event_id"], "customer": ["c_custkey"],
}


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return spread(df, *BULK_KEYS[table]) if table in BULK_KEYS else df


def document_files(spark, d) -> DataFrame:
    lang = F.col("lang")
    ext = F.when(lang == "en", ".py").when(lang == "fr", ".js").when(lang == "de", ".java").otherwise(".go")
    language = (
        F.when(lang == "en", "python").when(lang == "fr", "javascript").when(lang == "de", "java").otherwise("go")
    )
    return read(spark, d, "documents").select(
        F.col("source").alias("project"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), ext).alias("path"),
        language.alias("language"),
        "text",
    )


def page_files(spark, d) -> DataFrame:
    return read(spark, d, "pages").select(
        F.lit("web").alias("project"),
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit("html").alias("language"),
        F.col("html").alias("text"),
    )


def code_files(spark, d) -> DataFrame:
    statements = ", ".join(sql_string(s) for s in STATEMENTS)
    parts = ", ".join(f"element_at(array({statements}), cast({p} as int) + 1)" for p in picks("o_orderkey", "o_custkey"))
    which = f"cast(o_orderkey % {len(EXTENSIONS)} as int) + 1"
    extensions = ", ".join(sql_string(e) for e in EXTENSIONS)
    languages = ", ".join(sql_string(e) for e in LANGUAGES)
    return read(spark, d, "orders").select(
        F.expr("concat('team', cast(o_custkey % 7 as string)) AS project"),
        F.expr(
            "concat('src/m', cast(o_custkey % 40 as string), '/f', cast(o_orderkey as string), "
            f"element_at(array({extensions}), {which})) AS path"
        ),
        F.expr(f"element_at(array({languages}), {which}) AS language"),
        _fill_spark(F.expr(f"concat_ws('\\n', {parts})")).alias("text"),
    )


# A long unit of each kind, its length by the row's key: text before, repeated line and text after.
LONG_UNITS = {
    "javascript": [("function task@C(a) {\n", "  if (a > 1 && a < 9) { go(a); }\n", 90, "}\n"), ("const run@C = (a) => {\n", "  step(a);\n", 70, "};\n")],
    "python": [("class Job@C:\n    def run(self):\n", "        self.total = self.total + 1\n", 90, "\n    # end\n"),
               ("def stop@C(job):\n", "    if job.total:\n        job.total = 0\n", 60, "done()\n")],
    "go": [("func Walk@C(n int) {\n", "  for i := 0; i < n; i++ { visit(i) }\n", 80, "}\n")],
}
_LONG_ENDINGS = {"javascript": ".js", "python": ".py", "go": ".go"}


def _long_text(parts, literal) -> str:
    pieces = [f"{literal(a)}, repeat({literal(line)}, cast(c_custkey % {n} as int)), {literal(z)}" for a, line, n, z in parts]
    return f"replace(concat({', '.join(pieces)}), '@C', cast(c_custkey as varchar(20)))"


def _long_columns(literal) -> list[str]:
    case = lambda value: "CASE c_custkey % 3 WHEN 0 THEN " + value("javascript") + " WHEN 1 THEN " + value("python") + " ELSE " + value("go") + " END"
    return [
        "'long' AS project",
        f"concat('long/c', cast(c_custkey as varchar(20)), {case(lambda x: literal(_LONG_ENDINGS[x]))}) AS path",
        f"{case(literal)} AS language",
        f"{case(lambda x: _long_text(LONG_UNITS[x], literal))} AS text",
    ]


def long_files(spark, d) -> DataFrame:
    """A file with long functions per customer."""
    return read(spark, d, "customer").selectExpr(*_long_columns(sql_string))


def corpus(spark, d) -> DataFrame:
    return document_files(spark, d).unionByName(page_files(spark, d)).unionByName(code_files(spark, d))


#: The kinds of files in :func:`wide_corpus`.
WIDE = ("documents", "pages", "code", "long")


def wide_corpus(spark, d) -> DataFrame:
    """The corpus and a file with long functions per customer."""
    return corpus(spark, d).unionByName(long_files(spark, d))


def _sql_list(values) -> str:
    return "[" + ",".join(q(v) for v in values) + "]"


DOCUMENT_FILES_SQL = """SELECT source AS project,
 'doc/' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.java' ELSE '.go' END AS path,
 CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'java' ELSE 'go' END AS language,
 text FROM documents"""
PAGE_FILES_SQL = """SELECT 'web' AS project, 'web/' || CAST(page_id AS VARCHAR) || '.html' AS path, 'html' AS language, html AS text FROM pages"""
_FILLED = "array_to_string([" + ",".join(f"s.l[{p} + 1]" for p in picks("o_orderkey", "o_custkey")) + "], chr(10))"
for _token, _value in (("@N", "o_orderkey"), ("@M", "o_custkey + 1000"), ("@K", "o_orderkey % 50"), ("@J", "(o_orderkey + 7) % 50")):
    _FILLED = f"replace({_FILLED}, '{_token}', CAST({_value} AS VARCHAR))"
CODE_FILES_SQL = f"""SELECT 'team' || CAST(o_custkey % 7 AS VARCHAR) AS project,
 'src/m' || CAST(o_custkey % 40 AS VARCHAR) || '/f' || CAST(o_orderkey AS VARCHAR) || {_sql_list(EXTENSIONS)}[o_orderkey % {len(EXTENSIONS)} + 1] AS path,
 {_sql_list(LANGUAGES)}[o_orderkey % {len(EXTENSIONS)} + 1] AS language,
 {_FILLED} AS text
 FROM orders, (SELECT {_sql_list(STATEMENTS)} AS l) s"""


LONG_FILES_SQL = f"SELECT {', '.join(_long_columns(q))} FROM customer"


def files_cte(*kinds: str) -> str:
    """``files AS MATERIALIZED (...)`` over the asked kinds, all by default."""
    by_kind = {"documents": DOCUMENT_FILES_SQL, "pages": PAGE_FILES_SQL, "code": CODE_FILES_SQL, "long": LONG_FILES_SQL}
    kinds = kinds or ("documents", "pages", "code")
    body = "\nUNION ALL\n".join(by_kind[k] for k in kinds)
    return f"files AS MATERIALIZED ({body})"
