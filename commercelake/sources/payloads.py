"""Files and payloads that enter as text: documents, search responses, HTML, error logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.functions.text import strip, strip_tags

MAX_RESULTS = 8
MAX_TOPICS = 6
TITLE_CHARS = 80


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text); no file reads as no row."""
    try:
        rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "path STRING, text STRING")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def flatten_results(payloads: DataFrame) -> DataFrame:
    """JSON search responses (query, payload) to at most eight results each."""
    parsed = F.from_json("payload", "results array<struct<title:string,url:string,content:string>>")
    hits = F.slice(F.coalesce(parsed["results"], F.array()), 1, MAX_RESULTS)
    return payloads.select("query", F.posexplode(hits).alias("rank", "hit")).select(
        "query",
        "rank",
        F.coalesce("hit.title", F.lit("")).alias("title"),
        F.coalesce("hit.url", F.lit("")).alias("url"),
        F.coalesce("hit.content", F.lit("")).alias("snippet"),
    )


def flatten_instant_answers(payloads: DataFrame) -> DataFrame:
    """JSON instant answers: the abstract if it has text and URL, then the first six topics
    that have a text."""
    schema = (
        "Heading string, AbstractText string, AbstractURL string, "
        "RelatedTopics array<struct<Text:string,FirstURL:string>>"
    )
    a = F.from_json("payload", schema)
    row = "array<struct<title:string,url:string,snippet:string>>"
    has_abstract = (F.coalesce(a["AbstractText"], F.lit("")) != "") & (F.coalesce(a["AbstractURL"], F.lit("")) != "")
    abstract = F.struct(
        F.coalesce(a["Heading"], F.col("query")).alias("title"),
        a["AbstractURL"].alias("url"),
        a["AbstractText"].alias("snippet"),
    )
    topics = F.slice(F.coalesce(a["RelatedTopics"], F.array()), 1, MAX_TOPICS)
    with_text = F.filter(topics, lambda t: F.coalesce(t["Text"], F.lit("")) != "")
    related = F.transform(
        with_text,
        lambda t: F.struct(
            F.substring(t["Text"], 1, TITLE_CHARS).alias("title"),
            F.coalesce(t["FirstURL"], F.lit("")).alias("url"),
            t["Text"].alias("snippet"),
        ),
    )
    lead = F.when(has_abstract, F.array(abstract)).otherwise(F.array().cast(row))
    return payloads.select("query", F.posexplode(F.concat(lead.cast(row), related.cast(row))).alias("rank", "hit")).select(
        "query", "rank", "hit.*"
    )


# The markup that titles, URLs and snippets are found by.
TITLE_PATTERN = r'class="result__a"[^>]*>([^\n]*?)</a>'
URL_PATTERN = r'class="result__url"[^>]*>([^\n]*?)</span>'
SNIPPET_PATTERN = r'(?s)class="result__snippet"[^>]*>(.*?)</a>'


def extract_html_results(pages: DataFrame) -> DataFrame:
    """HTML result pages (query, html): titles, URLs and snippets paired by position, the
    first eight of each page, without those that lack a title or a snippet."""
    found = pages.select(
        "query",
        F.regexp_extract_all("html", F.lit(TITLE_PATTERN), 1).alias("titles"),
        F.regexp_extract_all("html", F.lit(URL_PATTERN), 1).alias("urls"),
        F.regexp_extract_all("html", F.lit(SNIPPET_PATTERN), 1).alias("snippets"),
    )
    pairs = F.least(F.size("titles"), F.size("snippets"), F.lit(MAX_RESULTS))
    hits = found.select(
        "query", "urls", "snippets", F.posexplode(F.slice("titles", F.lit(1), pairs)).alias("rank", "title")
    ).select(
        "query",
        "rank",
        strip(strip_tags(F.col("title"))).alias("title"),
        F.coalesce(strip(F.get("urls", F.col("rank"))), F.lit("")).alias("url"),
        strip(strip_tags(F.get("snippets", F.col("rank")))).alias("snippet"),
    )
    return hits.where("title <> '' AND snippet <> ''")


def recent_errors(log: DataFrame, hours: int = 24, tail: int = 500, head: int = 100) -> DataFrame:
    """Of the last `tail` lines of the last `hours`, the first `head` with ERROR or WARN."""
    newest = log.agg(F.max("ts")).scalar()
    recent = log.where(F.col("ts") >= newest - F.expr(f"INTERVAL {hours} HOURS"))
    last = recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(tail)
    return last.where(F.col("message").rlike("ERROR|WARN")).orderBy("ts", "event_id").limit(head)
