"""Queries over conversations, documents and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from commercelake.operators import runs, texts
from commercelake.plans.registry import query

_STRIP = r"E' \t\n\r\f' || chr(11)"


def _flag(column):
    return F.when(column, "true").otherwise("false")


def _flag_sql(expression: str) -> str:
    return f"CASE WHEN {expression} THEN 'true' ELSE 'false' END"


PROMPT = "You guide a structured discovery session."


@query(
    "t01_chat_history",
    f"""WITH m AS (SELECT DISTINCT conv_id, -1 AS position, 'system' AS role, '{PROMPT}' AS content FROM conversations
        UNION ALL SELECT conv_id, turn, role, text FROM conversations)
    SELECT conv_id, position, role, CAST(json_object('role', role, 'content', content) AS VARCHAR) AS message FROM m""",
)
def _(e):
    return texts.chat_history(e.conversations, PROMPT).select("conv_id", "position", "role", "message")


_REPLY_SQL = r"""replies AS (SELECT doc_id, source, CASE doc_id % 3
        WHEN 0 THEN E'Intro\n---SPEC-START---\n ' || text || E' \n---SPEC-END---\nBye'
        WHEN 1 THEN '---SPEC-START---' || text ELSE text END AS reply FROM documents)"""


@query(
    "t02_extract_spec",
    rf"""WITH {_REPLY_SQL} SELECT doc_id, {_flag_sql("contains(reply, '---SPEC-START---')")} AS has_spec,
        CASE WHEN doc_id % 3 = 0 THEN trim(regexp_extract(reply, '(?s)---SPEC-START---(.*?)---SPEC-END---', 1), {_STRIP}) ELSE 'none' END AS spec FROM replies""",
)
def _(e):
    d = F.col("doc_id")
    replies = e.documents.select(
        "doc_id",
        F.when(d % 3 == 0, F.concat(F.lit("Intro\n---SPEC-START---\n "), "text", F.lit(" \n---SPEC-END---\nBye")))
        .when(d % 3 == 1, F.concat(F.lit("---SPEC-START---"), "text"))
        .otherwise(F.col("text"))
        .alias("reply"),
    )
    return texts.extract_spec(replies).select(
        "doc_id", _flag(F.col("has_spec")).alias("has_spec"), F.coalesce("spec", F.lit("none")).alias("spec")
    )


# Replies with several files: every line of a document becomes a block.
_FILES_SQL = r"""raw AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN '# FILE: mod_' || (doc_id % 7) || E'.py\n' ELSE '' END
        || replace(text, E'\n', E'\n---FILE---\n# FILE: part_' || (doc_id % 5) || E'.py\n') AS reply FROM documents),
    blocks AS (SELECT doc_id, source, list_filter(list_transform(string_split(reply, '---FILE---'), lambda x: trim(x, """ + _STRIP + r""")), lambda x: x <> '') AS b FROM raw),
    flat AS (SELECT doc_id, source, unnest(b) AS content, generate_subscripts(b, 1) - 1 AS pos FROM blocks),
    files AS (SELECT doc_id, source, pos, content, coalesce(nullif(trim(regexp_extract(string_split(content, E'\n')[1], '# FILE: ([^\n]+)', 1), """ + _STRIP + r"""), ''), 'unknown.py') AS filename FROM flat)"""


def _generated(e):
    d = F.col("doc_id")
    head = F.when(d % 2 == 0, F.concat(F.lit("# FILE: mod_"), (d % 7).cast("string"), F.lit(".py\n"))).otherwise("")
    separator = F.concat(F.lit("\n---FILE---\n# FILE: part_"), (d % 5).cast("string"), F.lit(".py\n"))
    return e.documents.select("doc_id", "source", F.concat(head, F.replace("text", F.lit("\n"), separator)).alias("reply"))


def _files(e):
    return texts.split_files(_generated(e), "doc_id", "source")


@query("t03_split_files", f"WITH {_FILES_SQL} SELECT doc_id, pos, filename, content FROM files")
def _(e):
    return texts.split_files(_generated(e), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "filename", "content")


_CLEAN_SQL = r"""raw AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN E'```python\n' ELSE '' END
        || CASE WHEN doc_id % 3 = 0 THEN '# FILE: gen_' || (doc_id % 4) || E'.py\n' ELSE '' END || text
        || CASE WHEN doc_id % 2 = 0 THEN E'\n```' ELSE '' END AS raw FROM documents),
    clean AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '(?m)^```\w*\n?', ''), '(?m)\n?```$', ''), """ + _STRIP + r""") AS content FROM raw)"""


@query(
    "t04_clean_generated",
    rf"""WITH {_CLEAN_SQL} SELECT doc_id, content, coalesce(nullif(trim(regexp_extract(content, '(?m)^# FILE: (.+)', 1), {_STRIP}), ''), 'unknown.py') AS filename,
        len(string_split(content, E'\n')) AS lines FROM clean""",
)
def _(e):
    d = F.col("doc_id")
    raw = F.concat(
        F.when(d % 2 == 0, "```python\n").otherwise(""),
        F.when(d % 3 == 0, F.concat(F.lit("# FILE: gen_"), (d % 4).cast("string"), F.lit(".py\n"))).otherwise(""),
        "text",
        F.when(d % 2 == 0, "\n```").otherwise(""),
    )
    return texts.clean_generated(e.documents.select("doc_id", raw.alias("raw"))).drop("raw")


@query(
    "t05_salvage_json_array",
    """SELECT page_id, coalesce(html, '') AS name, 'tool' AS type, page_id % 5 AS relevance FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0
    UNION ALL SELECT page_id, coalesce(url, '') || '#2', 'none', page_id % 3 FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0""",
)
def _(e):
    p = F.col("page_id")
    html, second = F.coalesce("html", F.lit("")), F.concat(F.coalesce("url", F.lit("")), F.lit("#2"))
    kind = F.lit(None).cast("string")
    array = F.to_json(
        F.array(
            F.struct(html.alias("name"), F.lit("tool").alias("type"), (p % 5).alias("relevance")),
            F.struct(second.alias("name"), kind.alias("type"), (p % 3).alias("relevance")),
        )
    )
    reply = (
        F.when(p % 11 == 0, "Nothing found.")
        .when(p % 7 == 0, F.concat(F.lit('Items: [{"name": '), html, F.lit("}, oops]")))
        .otherwise(F.concat(F.lit("Here they are:\n```json\n"), array, F.lit("\n```\nDone.")))
    )
    out = texts.salvage_json_array(
        e.pages.select("page_id", reply.alias("reply")), "page_id", "name string, type string, relevance bigint"
    )
    return out.select("page_id", "name", F.coalesce("type", F.lit("none")).alias("type"), "relevance")


_LOG_SQL = r"""logs AS (SELECT conv_id, turn, coalesce(text, '') || E'\n' || CASE WHEN conv_id % 5 = 4 THEN 'no tests ran' ELSE repeat(E'test_x PASSED\n', turn % 4) || repeat(E'FAILED test_y\n', conv_id % 3)
        || repeat(E'ERROR test_z\n', (conv_id + turn) % 2) || '=== ' || (conv_id % 3) || ' failed, ' || (turn % 4) || ' passed in 0.24s ===' END AS log FROM conversations),
    parsed AS (SELECT conv_id, turn,
        coalesce(CAST(nullif(regexp_extract(log, '(\d+) passed', 1), '') AS BIGINT), 0) AS passed_summary,
        coalesce(CAST(nullif(regexp_extract(log, '(\d+) failed', 1), '') AS BIGINT), 0) AS failed_summary,
        len(list_filter(string_split(log, E'\n'), lambda x: contains(x, 'PASSED'))) AS passed,
        len(list_filter(string_split(log, E'\n'), lambda x: contains(x, 'FAILED'))) AS failed,
        len(list_filter(string_split(log, E'\n'), lambda x: contains(x, 'ERROR'))) AS errors,
        array_to_string(list_filter(string_split(log, E'\n'), lambda x: regexp_matches(x, '^(FAILED|ERROR)')), E'\n') AS failures FROM logs)"""


def _logs(e):
    c, t = F.col("conv_id"), F.col("turn")
    repeat = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    log = F.concat(
        repeat("test_x PASSED\n", t % 4),
        repeat("FAILED test_y\n", c % 3),
        repeat("ERROR test_z\n", (c + t) % 2),
        F.lit("=== "),
        (c % 3).cast("string"),
        F.lit(" failed, "),
        (t % 4).cast("string"),
        F.lit(" passed in 0.24s ==="),
    )
    return e.conversations.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(c % 5 == 4, "no tests ran").otherwise(log)).alias("log"))


@query("t09_parse_test_log", f"WITH {_LOG_SQL} SELECT * FROM parsed")
def _(e):
    return texts.parse_test_log(_logs(e)).drop("log")


def _secret_sql(label: str, pattern: str, i: int) -> str:
    return f"SELECT '{label}' AS label, regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}') AS m FROM documents"


_SECRETS_SQL = " UNION ALL ".join(_secret_sql(*item, i) for i, item in enumerate(texts.SECRET_PATTERNS.items()))


@query(
    "t12_secret_scan",
    f"""WITH s AS ({_SECRETS_SQL}) SELECT label, count(*) FILTER (len(m) > 0) AS documents, CAST(sum(len(m)) AS BIGINT) AS matches,
        CASE WHEN sum(len(m)) > 0 THEN 'FAIL' ELSE 'OK' END AS result FROM s GROUP BY 1""",
)
def _(e):
    return texts.secret_scan(e.documents)


@query(
    "t12_secret_matches",
    f"WITH s AS ({_SECRETS_SQL.replace('SELECT ', 'SELECT doc_id, ')}) SELECT doc_id, label, unnest(m) AS match FROM s",
)
def _(e):
    return texts.secret_matches(e.documents, "doc_id")


@query(
    "t13_count_requirements",
    rf"""WITH s AS (SELECT doc_id, len(string_split(text, E'\n')) AS n FROM documents)
    SELECT doc_id, n AS requirements, {_flag_sql("n >= 5")} AS enough FROM s""",
)
def _(e):
    spec = F.concat(F.lit("RF-01: "), F.replace("text", F.lit("\n"), F.lit("\nRF-02: ")))
    out = texts.count_requirements(e.documents.select("doc_id", spec.alias("spec")))
    return out.select("doc_id", "requirements", _flag(F.col("enough")).alias("enough"))


@query("t14_count_tests", r"SELECT doc_id, len(string_split(text, E'\n')) - 1 AS tests FROM documents")
def _(e):
    line = F.when(F.col("doc_id") % 2 == 0, "\nasync def test_x(): ").otherwise("\ndef test_x(): ")
    return texts.count_tests(e.documents.select("doc_id", F.replace("text", F.lit("\n"), line).alias("content"))).drop("content")


@query(
    "t15_strip_header",
    r"""WITH """ + _FILES_SQL + r""" SELECT doc_id, pos, CASE WHEN starts_with(content, '# FILE:') THEN array_to_string(string_split(content, E'\n')[2:], E'\n') ELSE content END AS content FROM files""",
)
def _(e):
    files = texts.split_files(_generated(e), "doc_id")
    return files.select("doc_id", F.col("pos").cast("bigint").alias("pos"), texts.strip_header(F.col("content")).alias("content"))


@query(
    "t16_fix_bundle",
    r"""WITH b AS (SELECT source, doc_id, '--- doc_' || doc_id || E'.txt ---\n' || text AS block FROM documents)
    SELECT source, row_number() OVER w AS position, CAST(coalesce(sum(length(block) + 2) OVER (PARTITION BY source ORDER BY 'doc_' || doc_id || '.txt'
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before, block FROM b WINDOW w AS (PARTITION BY source ORDER BY 'doc_' || doc_id || '.txt')""",
)
def _(e):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = e.documents.select("source", name.alias("filename"), F.col("text").alias("content"))
    return texts.fix_bundle(files, "source", "filename")


_KNOWN_SQL = """known AS (SELECT DISTINCT source, 'mod_' || (doc_id % 7) || '.py' AS filename FROM documents WHERE lang = 'en'
    UNION SELECT DISTINCT source, 'routes_' || lang || '.py' FROM documents WHERE lang <> 'en')"""


def _known_files(e):
    english = F.concat(F.lit("mod_"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))
    name = F.when(F.col("lang") == "en", english).when(F.col("lang") != "en", F.concat(F.lit("routes_"), "lang", F.lit(".py")))
    return e.documents.select("source", name.alias("filename")).where("filename IS NOT NULL").distinct()


@query(
    "t17_infer_filename",
    rf"""WITH {_KNOWN_SQL}, o AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'given.py' ELSE 'unknown.py' END AS filename,
        text || CASE WHEN doc_id % 3 = 0 THEN E'\n# FILE: mod_' || (doc_id % 7) || '.py' WHEN doc_id % 3 = 1 THEN E'\nrouter = APIRouter()' ELSE '' END AS content FROM documents)
    SELECT doc_id, CASE WHEN filename <> 'unknown.py' THEN filename ELSE coalesce((SELECT min(k.filename) FROM known k WHERE k.source = o.source
        AND (contains(o.content, '# FILE: ' || k.filename) OR (contains(o.content, 'router = APIRouter') AND contains(k.filename, 'routes')))), 'unknown.py') END AS filename FROM o""",
)
def _(e):
    d = F.col("doc_id")
    tail = (
        F.when(d % 3 == 0, F.concat(F.lit("\n# FILE: mod_"), (d % 7).cast("string"), F.lit(".py")))
        .when(d % 3 == 1, "\nrouter = APIRouter()")
        .otherwise("")
    )
    outputs = e.documents.select(
        "doc_id", "source", F.when(d % 4 == 0, "given.py").otherwise("unknown.py").alias("filename"), F.concat("text", tail).alias("content")
    )
    return texts.infer_filename(outputs, _known_files(e), "doc_id", "source").select("doc_id", "filename")


@query(
    "t18_discard_unknown_targets",
    f"WITH {_KNOWN_SQL}, {_FILES_SQL} SELECT doc_id, pos, filename FROM files WHERE (source, filename) IN (SELECT source, filename FROM known)",
)
def _(e):
    kept = texts.discard_unknown_targets(_files(e), _known_files(e), "source")
    return kept.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "filename")


@query(
    "w03_progressive_context",
    """SELECT conv_id, turn, count(*) OVER w - 1 AS context_files, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS context_chars FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(e):
    return texts.progressive_context(e.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "context_files", "context_chars")


@query(
    "w03_context_of_last",
    """SELECT d.source, target, doc_id, text FROM documents d JOIN (SELECT source, max(doc_id) AS target FROM documents GROUP BY 1) t
    ON d.source = t.source WHERE doc_id < target""",
)
def _(e):
    last = e.documents.groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    return texts.context_of(e.documents.select("source", "doc_id", "text"), last, "source", "doc_id")


# --- run logs -------------------------------------------------------------------

KINDS = ["environment", "security", "finance", "gateway", "carrier", "notifier"]
_STATUS_SQL = f"""status AS (SELECT user_id AS environment, strftime(ts, '%Y-%m-%d') AS day,
    {KINDS}[1 + event_id % 6] AS kind, k < 97 AS flag, k % 2 = 0 AND k % 3 <> 0 AS usable FROM activity)"""
_READY_SQL = """bool_and(CASE WHEN kind = 'environment' THEN flag END) AS f1, bool_and(CASE WHEN kind = 'security' THEN flag END) AS f2,
    bool_and(CASE WHEN kind = 'finance' THEN flag END) AS f3, count(*) FILTER (kind = 'gateway' AND usable) >= 1 AS payments,
    count(*) FILTER (kind = 'carrier' AND usable) >= 2 AS carriers, count(*) FILTER (kind = 'notifier' AND usable) >= 1 AS notifications"""
_IS_READY = "coalesce(f1, false) AND coalesce(f2, false) AND coalesce(f3, false) AND payments AND carriers AND notifications"


def _status(e):
    k = F.col("k")
    return e.activity.select(
        F.col("user_id").alias("environment"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 6 + 1).cast("int")).alias("kind"),
        (k < 97).alias("flag"),
        (k % 2 == 0).alias("enabled"),
        (k % 3 != 0).alias("healthy"),
    )


@query(
    "g08_readiness",
    f"""WITH {_STATUS_SQL}, r AS (SELECT environment, {_READY_SQL} FROM status GROUP BY 1)
    SELECT environment, {_flag_sql('payments')} AS payments, {_flag_sql('carriers')} AS carriers, {_flag_sql('notifications')} AS notifications,
        {_flag_sql(_IS_READY)} AS ready FROM r""",
)
def _(e):
    out = runs.readiness(_status(e), ["environment"])
    return out.select("environment", *[_flag(F.col(c)).alias(c) for c in ("payments", "carriers", "notifications", "ready")])


@query(
    "g09_smoke_checks",
    f"""WITH {_STATUS_SQL}, r AS (SELECT environment, day, {_READY_SQL} FROM status GROUP BY 1, 2)
    SELECT environment, day, 'persistence=true,payments=' || payments || ',carriers=' || carriers || ',notifications=' || notifications
        || ',launch=' || ({_IS_READY}) AS checks, {_flag_sql(_IS_READY)} AS passed FROM r""",
)
def _(e):
    out = runs.smoke_checks(_status(e), ["environment", "day"])
    names = ["persistence", "payments", "carriers", "notifications", "launch"]
    listed = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col("checks")[n].cast("string")) for n in names])
    return out.select("environment", "day", listed.alias("checks"), _flag(F.col("passed")).alias("passed"))


@query(
    "g10_integration_status",
    f"""SELECT user_id AS provider, {_flag_sql('coalesce(arg_max(k % 2 = 0, (ts, event_id)) FILTER (k % 3 <> 0), false)')} AS enabled,
        {_flag_sql('coalesce(arg_max(k % 5 = 0, (ts, event_id)) FILTER (k % 4 <> 0), false)')} AS healthy,
        coalesce(arg_max(event_type, (ts, event_id)) FILTER (k % 7 = 0), 'sandbox') AS mode FROM activity GROUP BY 1""",
)
def _(e):
    k = F.col("k")
    changes = e.activity.select(
        F.col("user_id").alias("provider"),
        F.col("ts").alias("at"),
        "event_id",
        F.when(k % 3 != 0, k % 2 == 0).alias("enabled"),
        F.when(k % 4 != 0, k % 5 == 0).alias("healthy"),
        F.when(k % 7 == 0, F.col("event_type")).alias("mode"),
    )
    out = runs.integration_status(changes)
    return out.select("provider", _flag(F.col("enabled")).alias("enabled"), _flag(F.col("healthy")).alias("healthy"), "mode")


@query(
    "g11_health_rollup",
    """SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) FILTER (event_type = 'error' AND k < 50) AS failures,
        count(*) FILTER (event_type = 'error' AND k >= 50) AS skipped,
        CASE WHEN count(*) FILTER (event_type = 'error' AND k < 50) > 0 THEN 'failed' ELSE 'passed' END AS overall FROM activity GROUP BY 1""",
)
def _(e):
    checks = e.activity.select(
        F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("OK").alias("status"),
        (F.col("k") < 50).alias("mandatory"),
    )
    return runs.health_rollup(checks, ["hour"])


@query(
    "g12_scorecard",
    """WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, sum(value) AS total FROM activity GROUP BY 1),
    c AS (SELECT user_id, [n >= 60, bad < 15, total < 3500] AS m FROM r),
    l AS (SELECT user_id, m, len(list_filter(m, lambda x: x)) || '/3 criteria passed' AS score, unnest([1, 2, 3]) AS i FROM c)
    SELECT user_id, ['enough calls', 'few errors', 'within budget'][i] AS label, CASE WHEN m[i] THEN 'PASS' ELSE 'FAIL' END AS result, score FROM l""",
)
def _(e):
    per_run = e.activity.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.sum("value_cents").alias("total")
    )
    criteria = {"enough calls": F.col("n") >= 60, "few errors": F.col("bad") < 15, "within budget": F.col("total") < 350000}
    return runs.scorecard(per_run, "user_id", criteria)


@query(
    "g13_stage_timings",
    """WITH s AS (SELECT cycle, phase, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM traces GROUP BY 1, 2)
    SELECT cycle, phase, seconds, CAST(sum(seconds) OVER (PARTITION BY cycle) AS BIGINT) AS total_seconds,
        CAST(sum(seconds) OVER (PARTITION BY cycle) AS BIGINT) // 60 AS total_minutes FROM s""",
)
def _(e):
    return runs.stage_timings(e.traces, "cycle", "phase")


@query(
    "g14_retry_summary",
    f"""WITH a AS (SELECT user_id, k % 4 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM activity QUALIFY n <= 3),
    r AS (SELECT user_id, min(n) FILTER (ok) AS won, max(n) AS made FROM a GROUP BY 1)
    SELECT user_id, coalesce(won, made) AS attempts, CASE WHEN won IS NOT NULL THEN won - 1 WHEN made >= 3 THEN made - 1 ELSE made END AS fixes,
        {_flag_sql('won IS NULL AND made >= 3')} AS exhausted FROM r""",
)
def _(e):
    attempts = e.activity.select("user_id", "ts", "event_id", (F.col("k") % 4 == 0).alias("ok"))
    return runs.retry_summary(attempts, "user_id").withColumn("exhausted", _flag(F.col("exhausted")))


@query(
    "g15_test_outcomes",
    f"""WITH {_LOG_SQL} SELECT conv_id, turn, passed, failed, errors, CASE WHEN passed > 0 THEN 'PASS' WHEN failed > 0 OR errors > 0 THEN 'FAIL' ELSE 'SKIP' END AS status FROM parsed""",
)
def _(e):
    return texts.test_outcome(texts.parse_test_log(_logs(e))).select("conv_id", "turn", "passed", "failed", "errors", "status")


@query(
    "g16_artifact_sizes",
    r"""SELECT source, count(*) AS files, CAST(sum(len(string_split(text, E'\n'))) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM documents GROUP BY 1""",
)
def _(e):
    return runs.artifact_sizes(e.documents, "source", "text")
