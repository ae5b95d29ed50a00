"""Queries for sources, sinks and search-result research."""

from __future__ import annotations

from pyspark.sql import functions as F

from commercelake.functions.money import as_money
from commercelake.functions.text import strip_tags
from commercelake.operators import checkout, research
from commercelake.plans.registry import query
from commercelake.session import shared_path
from commercelake.sources import payloads, snapshots, versioned
from commercelake.sources.tables import SCHEMAS, load_entities

# --- sources and sinks ----------------------------------------------------------


@query(
    "s01_load_entities",
    " UNION ALL ".join(f"SELECT '{name}' AS entity, count(*) AS records FROM {name}" for name in SCHEMAS),
)
def _(e):
    tables = load_entities(e.spark, e.folder)
    return research.union_all(
        *[df.agg(F.count("*").alias("records")).select(F.lit(name).alias("entity"), "records") for name, df in tables.items()]
    )


@query(
    "s02_snapshot_upsert",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version,
        CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS DECIMAL(18,2)) AS balance FROM customer
    UNION ALL SELECT -c_custkey - 1, 2, CAST(c_acctbal + 1 AS DECIMAL(18,2)) FROM customer WHERE c_mktsegment = 'MACHINERY'""",
)
def _(e):
    base = e.customer.select("c_custkey", F.lit(1).alias("version"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    raised = (F.col("c_acctbal") + 1).cast("decimal(18,2)").alias("balance")
    changed = e.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(2).alias("version"), raised)
    added = e.customer.where("c_mktsegment = 'MACHINERY'").select(
        (-F.col("c_custkey") - 1).alias("c_custkey"), F.lit(2).alias("version"), raised
    )
    root, schema = shared_path(e.spark, "balances"), "c_custkey BIGINT, version INT, balance DECIMAL(18,2)"
    versioned.write_changes(base, root, 1, "c_custkey")
    versioned.compact(e.spark, root, schema, "c_custkey")
    versioned.write_changes(changed.unionByName(added), root, 2, "c_custkey")
    return versioned.read_version(e.spark, root, schema, "c_custkey")


@query(
    "s03_tagged_round_trip",
    "SELECT item_id, title, price, CAST(stock AS INT) AS stock, CASE WHEN active THEN 'true' ELSE 'false' END AS active FROM items",
)
def _(e):
    record = {
        "title": F.col("title"),
        "price": as_money(F.col("price_cents")),
        "stock": F.col("stock"),
        "active": F.col("active"),
    }
    packed = e.items.select("item_id", snapshots.encode_tagged(record, {"price"}).alias("payload"))
    types = {"title": "string", "price": "decimal(18,2)", "stock": "int", "active": "boolean"}
    out = packed.select("item_id", snapshots.decode_tagged(F.col("payload"), types).alias("r")).select("item_id", "r.*")
    return out.withColumn("active", F.when(F.col("active"), "true").otherwise("false"))


@query("s04_checkpoint_restore", "SELECT item_id, price FROM items")
def _(e):
    path = shared_path(e.spark, "checkpoints")
    prices = e.items.select("item_id", as_money(F.col("price_cents")).alias("price"))
    for _ in range(2):
        snapshots.checkpoint(prices, path, "RB1")
    snapshots.checkpoint(prices.withColumn("price", (F.col("price") * 2).cast("decimal(18,2)")), path, "RB2")
    return snapshots.restore(e.spark, path, "RB1", "item_id BIGINT, price DECIMAL(18,2)")


@query("s05_read_documents", "SELECT source, sum(length(text) + 1) AS chars FROM documents GROUP BY 1")
def _(e):
    path = shared_path(e.spark, "texts")
    e.documents.select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 10000).text(path)
    files = payloads.read_documents(e.spark, path)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("text")).alias("chars"))


@query(
    "s06_flatten_results",
    """SELECT url AS query, i - 1 AS rank, CASE WHEN i % 5 = 0 THEN '' ELSE 'Title ' || i END AS title,
        url || '#' || i AS url, CASE WHEN i % 3 = 0 THEN '' ELSE html END AS snippet
    FROM pages, range(1, 13) t(i) WHERE i <= page_id % 12 AND i <= 8""",
)
def _(e):
    i = lambda x: x.cast("string")
    hits = F.transform(
        F.sequence(F.lit(1), (F.col("page_id") % 12).cast("int"), F.lit(1)),
        lambda x: F.struct(
            F.when(x % 5 != 0, F.concat(F.lit("Title "), i(x))).alias("title"),
            F.concat("url", F.lit("#"), i(x)).alias("url"),
            F.when(x % 3 != 0, F.col("html")).alias("content"),
        ),
    )
    some = e.pages.where("page_id % 12 > 0").select(
        F.col("url").alias("query"), F.to_json(F.struct(hits.alias("results"))).alias("payload")
    )
    none = e.pages.where("page_id % 12 = 0").select(F.col("url").alias("query"), F.lit('{"results": []}').alias("payload"))
    return payloads.flatten_results(some.unionByName(none)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "s07_flatten_instant_answers",
    """WITH p AS (SELECT *, page_id % 2 = 0 AS has_abstract FROM pages),
    t AS (SELECT page_id, url, html || i AS text, CASE WHEN i % 2 = 0 THEN '' ELSE url || '/' || i END AS first_url,
        has_abstract, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n
        FROM p, range(1, 10) r(i) WHERE i <= 6 AND i % 3 <> 0)
    SELECT url AS query, 0 AS rank, CASE WHEN page_id % 4 = 0 THEN 'Heading' ELSE url END AS title, url || '/a' AS url, html AS snippet
    FROM p WHERE has_abstract
    UNION ALL SELECT url, n - 1 + CASE WHEN has_abstract THEN 1 ELSE 0 END, left(text, 80), first_url, text FROM t""",
)
def _(e):
    p = F.col("page_id")
    topics = F.transform(
        F.sequence(F.lit(1), F.lit(9)),
        lambda x: F.struct(
            F.when(x % 3 != 0, F.concat("html", x.cast("string"))).alias("Text"),
            F.when(x % 2 != 0, F.concat("url", F.lit("/"), x.cast("string"))).alias("FirstURL"),
        ),
    )
    payload = F.to_json(
        F.struct(
            F.when(p % 4 == 0, "Heading").alias("Heading"),
            F.when(p % 2 == 0, F.col("html")).alias("AbstractText"),
            F.concat("url", F.lit("/a")).alias("AbstractURL"),
            topics.alias("RelatedTopics"),
        )
    )
    answers = e.pages.select(F.col("url").alias("query"), payload.alias("payload"))
    return payloads.flatten_instant_answers(answers).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "s08_extract_html_results",
    r"""WITH h AS (SELECT url AS query, replace(replace(replace(replace(html, '<li><a href="', '<li><span class="result__url">u</span><a class="result__a" href="'),
            '<p>', '<a class="result__snippet">'), '</p>', '</a>'), '</li>', '') AS html FROM pages),
    x AS (SELECT query, regexp_extract_all(html, 'class="result__a"[^>]*>([^\n]*?)</a>', 1) AS t,
        regexp_extract_all(html, 'class="result__url"[^>]*>([^\n]*?)</span>', 1) AS u,
        regexp_extract_all(html, '(?s)class="result__snippet"[^>]*>(.*?)</a>', 1) AS s FROM h),
    y AS (SELECT query, i - 1 AS rank, trim(regexp_replace(t[i], '<[^>]+>', '', 'g'), E' \t\n\r\f' || chr(11)) AS title,
        trim(coalesce(u[i], ''), E' \t\n\r\f' || chr(11)) AS url, trim(regexp_replace(s[i], '<[^>]+>', '', 'g'), E' \t\n\r\f' || chr(11)) AS snippet
        FROM x, range(1, 9) r(i) WHERE i <= len(t) AND i <= len(s))
    SELECT * FROM y WHERE title <> '' AND snippet <> ''""",
)
def _(e):
    html = F.col("html")
    for old, new in (
        ('<li><a href="', '<li><span class="result__url">u</span><a class="result__a" href="'),
        ("<p>", '<a class="result__snippet">'),
        ("</p>", "</a>"),
        ("</li>", ""),
    ):
        html = F.replace(html, F.lit(old), F.lit(new))
    out = payloads.extract_html_results(e.pages.select(F.col("url").alias("query"), html.alias("html")))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def _items(e):
    """Scored items, as a model's output would hold them."""
    p = F.col("page_id")
    return e.pages.select(
        "page_id",
        F.when(p % 13 != 0, F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("name"),
        F.when(p % 3 == 0, "tool").when(p % 3 == 1, "model").alias("type"),
        (p % 5 + 1).alias("relevance"),
        F.when(p % 4 != 0, p % 5).alias("viability"),
        F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("description"),
        F.when(p % 2 == 0, F.col("url")).alias("source_url"),
    )


_ITEMS_SQL = """found AS (SELECT page_id, CASE WHEN page_id % 13 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS name,
    CASE page_id % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'model' END AS type, page_id % 5 + 1 AS relevance,
    CASE WHEN page_id % 4 <> 0 THEN page_id % 5 END AS viability, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS description,
    CASE WHEN page_id % 2 = 0 THEN url END AS source_url FROM pages)"""
_RENDER_SQL = r"""concat_ws(E'\n', '### ' || coalesce(name, 'Unknown'), '- **Tipo:** ' || coalesce(type, '-'),
    '- **Relevancia SDLC:** ' || relevance || '/5', '- **Viabilidade HW:** ' || coalesce(CAST(viability AS VARCHAR), '-') || '/5',
    '- **Descricao:** ' || coalesce(description, ''), CASE WHEN coalesce(source_url, '') <> '' THEN '- **Fonte:** ' || source_url END)"""
_REPORT_SQL = f"""first20 AS (SELECT * FROM results ORDER BY query_pos, rank LIMIT 20),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_pos, rank) AS n FROM first20 WHERE url <> '') WHERE n = 1)"""


@query(
    "s09_write_report",
    f"""WITH {_ITEMS_SQL}, {_REPORT_SQL}, q AS (SELECT DISTINCT query, query_pos FROM results)
    SELECT 0 AS section, 1 AS position, '**Queries executadas:** ' || (SELECT count(*) FROM q) AS line, '2024-01-30' AS run_date
    UNION ALL SELECT 0, 2, '**Resultados brutos coletados:** ' || (SELECT count(*) FROM results), '2024-01-30'
    UNION ALL SELECT 0, 3, '**Novos itens identificados:** ' || (SELECT count(*) FROM found), '2024-01-30'
    UNION ALL SELECT 1, row_number() OVER (ORDER BY query_pos), '- `' || query || '`', '2024-01-30' FROM q
    UNION ALL SELECT 2, row_number() OVER (ORDER BY page_id), {_RENDER_SQL}, '2024-01-30' FROM found
    UNION ALL SELECT 3, row_number() OVER (ORDER BY query_pos, rank), '- [' || left(title, 80) || '](' || url || ')', '2024-01-30' FROM kept""",
)
def _(e):
    ordered = e.results.select("query", (F.col("query_pos") + 1).alias("position")).distinct()
    lines = research.report(_items(e), "page_id", e.results, ordered, "2024-01-30")
    path = shared_path(e.spark, "report")
    for _ in range(2):
        research.write_report(lines, path)
    return e.spark.read.schema("section BIGINT, position BIGINT, line STRING, run_date STRING").json(path)


@query(
    "s10_append_once",
    "SELECT strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS events, sum(event_id) AS ids FROM events GROUP BY 1",
)
def _(e):
    path = shared_path(e.spark, "backlog")
    batch = e.activity.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run_date"))
    snapshots.append_once(batch.where("run_date <= '2024-01-20'"), path)
    snapshots.append_once(batch, path)
    held = e.spark.read.schema("event_id BIGINT, run_date STRING").parquet(path)
    return held.groupBy("run_date").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query(
    "s11_append_events",
    """SELECT 'checkout' AS log, decision, count(*) AS events FROM decided WHERE decision <> 'rejected' GROUP BY ALL
    UNION ALL SELECT 'antifraud', decision, count(*) FROM decided WHERE decision = 'blocked' GROUP BY ALL""",
)
def _(e):
    path = shared_path(e.spark, "logs")
    rows = checkout.logged(checkout.classify(e.checkouts)).select("event_id", "decision", "log")
    for _ in range(2):
        snapshots.append_log(rows.where("decision = 'approved'"), path, "first")
        snapshots.append_log(rows.where("decision = 'blocked'"), path, "second")
    held = e.spark.read.schema("event_id BIGINT, decision STRING, batch STRING, log STRING").parquet(path)
    return held.groupBy("log", "decision").agg(F.count("*").alias("events"))


@query(
    "s12_read_error_logs",
    """WITH m AS (SELECT *, CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'click' THEN 'WARN ' ELSE 'INFO ' END || value AS message FROM activity),
    tail AS (SELECT * FROM m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 24 HOURS ORDER BY ts DESC, event_id DESC LIMIT 500)
    SELECT event_id, message FROM tail WHERE regexp_matches(message, 'ERROR|WARN') ORDER BY ts, event_id LIMIT 100""",
)
def _(e):
    level = F.when(F.col("event_type") == "error", "ERROR ").when(F.col("event_type") == "click", "WARN ").otherwise("INFO ")
    log = e.activity.withColumn("message", F.concat(level, as_money(F.col("value_cents")).cast("string")))
    return payloads.recent_errors(log).select("event_id", "message")


# --- fallback, dedup, top-k -----------------------------------------------------

_RESULT_COLUMNS = ["query", "query_pos", "source_rank", "rank", "title", "url", "snippet"]


@query(
    "d01_dedup_by_url",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_pos, rank) AS n FROM results WHERE url <> '')
    SELECT query, query_pos, source_rank, rank, title, url, snippet FROM n WHERE n = 1
    UNION ALL SELECT '', query_pos, source_rank, rank, title, url, snippet FROM results WHERE url = ''""",
)
def _(e):
    return research.dedup_by_url(e.results).select(*_RESULT_COLUMNS)


@query(
    "d02_first_nonempty_source",
    "SELECT * FROM results QUALIFY source_rank = min(source_rank) OVER (PARTITION BY query)",
)
def _(e):
    return research.first_nonempty_source(e.results).select(*_RESULT_COLUMNS)


@query("k01_top_per_query", "SELECT query, rank, title FROM results QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 8")
def _(e):
    return research.top_per_query(e.results, 8).select("query", "rank", "title")


@query("k02_first_results", "SELECT query, rank, title FROM results ORDER BY query_pos, rank LIMIT 40")
def _(e):
    return research.first_results(e.results, 40).select("query", "rank", "title")


# Backlog texts: each document with a heading, a bold name and a table row in front.
_BACKLOG_SQL = r"""backlog AS (SELECT doc_id, source, '### ' || (doc_id % 9) || '. Tool ' || (doc_id % 97) || E'\n**' || lang || ' Model**' || E'\n| ' || source || E' | x |\n' || text AS text FROM documents)"""
_NAMES_SQL = (
    _BACKLOG_SQL
    + r""", names AS (SELECT doc_id, kind, lower(trim(unnest(l), E' \t\n\r\f' || chr(11))) AS name FROM (
        SELECT doc_id, 'heading' AS kind, regexp_extract_all(text, '###\s+([^\n]+)', 1) AS l FROM backlog
        UNION ALL SELECT doc_id, 'bold', regexp_extract_all(text, '\*\*([^\n]+?)\*\*', 1) FROM backlog
        UNION ALL SELECT doc_id, 'cell', regexp_extract_all(text, '(?m)^\|\s*([^|]+?)\s*\|', 1) FROM backlog))"""
)


def _backlog(e):
    d = F.col("doc_id")
    return e.documents.select(
        "doc_id",
        "source",
        F.concat(
            F.lit("### "),
            (d % 9).cast("string"),
            F.lit(". Tool "),
            (d % 97).cast("string"),
            F.lit("\n**"),
            "lang",
            F.lit(" Model**\n| "),
            "source",
            F.lit(" | x |\n"),
            "text",
        ).alias("text"),
    )


@query("k03_known_list", f"""WITH {_NAMES_SQL}, f AS (SELECT DISTINCT name FROM names ORDER BY name LIMIT 60)
    SELECT string_agg(name, ', ' ORDER BY name) AS known FROM f""")
def _(e):
    return research.known_list(research.extract_known_names(_backlog(e), "doc_id"))


@query(
    "k04_report_sources",
    f"WITH {_REPORT_SQL} SELECT query, rank, '- [' || left(title, 80) || '](' || url || ')' AS line FROM kept",
)
def _(e):
    return research.report_sources(e.results).drop("query_pos")


@query("u01_union_sources", "SELECT query, source_rank, count(*) AS results, sum(length(snippet)) AS chars FROM results GROUP BY ALL")
def _(e):
    parts = [e.results.where(F.col("source_rank") == s) for s in range(3)]
    both = research.union_all(*parts)
    return both.groupBy("query", "source_rank").agg(F.count("*").alias("results"), F.sum(F.length("snippet")).alias("chars"))


@query("u02_known_set", f"WITH {_NAMES_SQL} SELECT DISTINCT name FROM names UNION SELECT lower(p_name) FROM part")
def _(e):
    names = research.extract_known_names(_backlog(e), "doc_id")
    return research.known_set(names, e.part.select(F.col("p_name").alias("name")))


# --- names and routing ----------------------------------------------------------


@query(
    "j08_new_items",
    r"""WITH known AS (SELECT lower(trim(text, E' \t\n\r\f' || chr(11))) AS name FROM documents JOIN labels USING (doc_id)
        UNION SELECT lower(trim(text, E' \t\n\r\f' || chr(11))) FROM benchmark)
    SELECT doc_id FROM documents WHERE lower(trim(text, E' \t\n\r\f' || chr(11))) NOT IN (SELECT name FROM known)""",
)
def _(e):
    known = e.documents.join(e.labels, "doc_id", "left_semi").select("text").unionByName(e.benchmark.select("text"))
    fresh = research.new_items(e.documents.withColumnRenamed("text", "name"), known.withColumnRenamed("text", "name"))
    return fresh.select("doc_id")


INSTALLED = ["coder-large:30b", "coder-small:7b", "general:14b"]


@query(
    "j10_route_model",
    """SELECT event_id, CASE k % 4 WHEN 0 THEN 'coder-large:30b' WHEN 1 THEN 'general:14b' WHEN 2 THEN
        CASE k % 3 WHEN 0 THEN 'coder-small:7b' ELSE 'coder-large:30b' END ELSE 'coder-large:30b' END AS model FROM activity""",
)
def _(e):
    k = F.col("k")
    requests = e.activity.select(
        "event_id",
        F.when(k % 4 == 0, "coder:32b").when(k % 4 == 1, "general:latest").when(k % 4 == 2, "absent:1b").otherwise("").alias("preferred"),
        F.when(k % 3 == 0, "coder-small:14b").otherwise("unknown:2b").alias("fallback"),
    )
    return research.route_model(requests, INSTALLED).select("event_id", "model")


@query(
    "j12_resolve_alias",
    """SELECT event_id, CASE WHEN k % 5 <= 2 THEN alias WHEN alias = 'fix' THEN 'review' ELSE 'none' END AS served_by,
        CASE WHEN k % 5 <= 2 THEN CASE alias WHEN 'review' THEN 'cloud' ELSE 'local' END WHEN alias = 'fix' THEN 'cloud' ELSE 'none' END AS backend
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'fix' WHEN 'view' THEN 'review' ELSE 'codegen' END AS alias FROM activity)""",
)
def _(e):
    t = F.col("event_type")
    calls = e.activity.select(
        "event_id",
        F.when(t == "error", "fix").when(t == "view", "review").otherwise("codegen").alias("alias"),
        (F.col("k") % 5).alias("failures"),
    )
    out = research.resolve_alias(calls, {"fix": "local", "review": "cloud", "codegen": "local"}, {"fix": "review"})
    return out.select(
        "event_id", F.coalesce("served_by", F.lit("none")).alias("served_by"), F.coalesce("backend", F.lit("none")).alias("backend")
    )


# --- rendering ------------------------------------------------------------------


@query(
    "t06_format_search_block",
    r"""WITH f AS (SELECT *, row_number() OVER (ORDER BY query_pos, rank) AS n FROM results ORDER BY query_pos, rank LIMIT 40)
    SELECT string_agg(n || '. TITLE: ' || title || E'\n   URL: ' || url || E'\n   SNIPPET: ' || left(snippet, 300), E'\n\n' ORDER BY n) AS block FROM f""",
)
def _(e):
    return research.format_search_block(e.results)


@query("t07_render_item", f"WITH {_ITEMS_SQL} SELECT page_id, {_RENDER_SQL} AS markdown FROM found")
def _(e):
    return _items(e).select("page_id", research.render_item().alias("markdown"))


_ENTRY_SQL = r"""n || '. ' || coalesce(name, '?') || ' (' || coalesce(type, '-') || E')\n   SDLC ' || relevance || '/5 | HW '
    || coalesce(CAST(viability AS VARCHAR), '-') || E'/5\n   ' || left(description, 120)"""


@query(
    "w04_numbered_digest",
    f"WITH {_ITEMS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM found) SELECT n AS position, {_ENTRY_SQL} AS entry FROM o",
)
def _(e):
    return research.numbered_digest(_items(e), "page_id")


@query(
    "t08_digest_message",
    rf"""WITH {_ITEMS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM found)
    SELECT n AS position, {_ENTRY_SQL} AS entry FROM o
    UNION ALL SELECT 0, E'Weekly Research\n\n' || count(*) || E' novo(s) item(ns) encontrado(s):\n' FROM o
    UNION ALL SELECT count(*) + 1, E'\nVer backlog' FROM o""",
)
def _(e):
    return research.digest_message(_items(e), "page_id", "Weekly Research", "Ver backlog")


@query("t10_extract_known_names", f"WITH {_NAMES_SQL} SELECT doc_id, kind, name, count(*) AS n FROM names GROUP BY ALL")
def _(e):
    return research.extract_known_names(_backlog(e), "doc_id").groupBy("doc_id", "kind", "name").agg(F.count("*").alias("n"))


@query("t11_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def _(e):
    return e.pages.select("page_id", strip_tags(F.col("html")).alias("text"))
