"""Search-result research: source fallback, dedup, known names, routing, report.

Results: query, query_pos (its place in the query list), source_rank, rank, title, url, snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.functions.text import strip
from commercelake.operators.ordered import numbered

BLOCK_RESULTS = 40
BLOCK_SNIPPET = 300
KNOWN_NAMES = 60
REPORT_SOURCES = 20
DIGEST_CHARS = 120

# The wording of items, digest and report.
ITEM_TYPE = "- **Tipo:** "
ITEM_RELEVANCE = "- **Relevancia SDLC:** "
ITEM_VIABILITY = "- **Viabilidade HW:** "
ITEM_DESCRIPTION = "- **Descricao:** "
ITEM_SOURCE = "- **Fonte:** "
DIGEST_EMPTY = "Nenhum item novo encontrado esta semana."
DIGEST_COUNT = " novo(s) item(ns) encontrado(s):"
REPORT_QUERIES = "Queries executadas"
REPORT_RESULTS = "Resultados brutos coletados"
REPORT_ITEMS = "Novos itens identificados"


def first_nonempty_source(results: DataFrame) -> DataFrame:
    """Per query keep the rows of the best source that returned any.

    The best source is an aggregate of one row per query, so the rows themselves never
    have to meet in one task; a query with very many rows is split by the join.
    """
    best = results.groupBy("query").agg(F.min("source_rank").alias("source_rank"))
    return results.join(best, ["query", "source_rank"], "left_semi")


def union_all(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def dedup_by_url(results: DataFrame) -> DataFrame:
    """First row per URL in the order of the query list, then rank; rows without a URL are
    all kept, without their query's text but at its position."""
    columns = results.columns
    firsts = (
        results.where("url <> ''")
        .groupBy("url")
        .agg(F.min_by(F.struct(*columns), F.struct("query_pos", "rank")).alias("_row"))
        .select("_row.*")
    )
    blanks = results.where("url = ''").withColumn("query", F.lit(""))
    return firsts.unionByName(blanks)


def top_per_query(results: DataFrame, n: int) -> DataFrame:
    """First n per query; Spark limits each task's groups before the shuffle."""
    order = Window.partitionBy("query").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def first_results(results: DataFrame, n: int) -> DataFrame:
    """The first n, queries in the order of their list."""
    return results.orderBy("query_pos", "rank").limit(n)


# --- names ------------------------------------------------------------------------
# Where a name stands in a Markdown backlog.
HEADING = r"###\s+([^\n]+)"
BOLD = r"\*\*([^\n]+?)\*\*"
FIRST_CELL = r"(?md)^\|\s*([^|]+?)\s*\|"


def extract_known_names(documents: DataFrame, id_column: str, strip_ordinal: bool = False) -> DataFrame:
    """(id, kind, name): headings, bold text and first table cells, lower case.

    strip_ordinal drops a leading "1. ", which otherwise stays part of the name.
    """

    def names(pattern: str) -> Column:
        return F.regexp_extract_all("text", F.lit(pattern), 1)

    kinds = F.array(
        F.struct(F.lit("heading").alias("kind"), names(HEADING).alias("names")),
        F.struct(F.lit("bold").alias("kind"), names(BOLD).alias("names")),
        F.struct(F.lit("cell").alias("kind"), names(FIRST_CELL).alias("names")),
    )
    found = documents.select(id_column, F.inline(kinds)).select(id_column, "kind", F.explode("names").alias("name"))
    name = F.lower(strip(F.col("name")))
    if strip_ordinal:
        name = F.regexp_replace(name, r"^\d+\.\s*", "")
    return found.withColumn("name", name)


def known_set(names: DataFrame, discarded: DataFrame) -> DataFrame:
    """Distinct lower-case names: those found and those discarded."""
    return names.select("name").unionByName(discarded.select(F.lower("name").alias("name"))).distinct()


def new_items(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose trimmed, lower-case name is not known.

    Names can be long texts, so their digests are compared. Both sides come straight from a
    shuffle, so adaptive execution splits a text that many candidates share.
    """

    def key() -> Column:
        return F.sha2(F.lower(strip(F.col("name"))), 256).alias("_key")

    return candidates.withColumn("_key", key()).join(known.select(key()), "_key", "left_anti").select(*candidates.columns)


def known_list(known: DataFrame, n: int = KNOWN_NAMES) -> DataFrame:
    """The alphabetically first n distinct names in one string."""
    first = known.select("name").distinct().orderBy("name").limit(n)
    listed = F.array_join(F.array_sort(F.collect_list("name")), ", ")
    return first.agg(F.when(F.count("*") == 0, "(none)").otherwise(listed).alias("known"))


# --- routing ----------------------------------------------------------------------


def route_model(requests: DataFrame, installed: list[str]) -> DataFrame:
    """Add model: the first installed name that starts with the preferred name's part before
    ':', else with the fallback's, else the first installed.

    An empty name is a prefix of everything and so picks the first installed model.
    """
    names = F.array(*map(F.lit, installed)) if installed else F.array().cast("array<string>")

    def match(wanted: str) -> Column:
        prefix = F.split_part(F.coalesce(wanted, F.lit("")), F.lit(":"), F.lit(1))
        return F.get(F.filter(names, lambda name: name.startswith(prefix)), F.lit(0))

    return requests.withColumn("model", F.coalesce(match("preferred"), match("fallback"), F.get(names, F.lit(0))))


def resolve_alias(calls: DataFrame, backends: dict[str, str], fallbacks: dict[str, str], retries: int = 2) -> DataFrame:
    """Add served_by and backend. calls: alias, failures (failed tries before a success)."""

    def lookup(table: dict[str, str], key: Column) -> Column:
        entries = [F.lit(x) for pair in table.items() for x in pair]
        return F.try_element_at(F.create_map(*entries), key)

    served = F.when(F.col("failures") <= retries, F.col("alias")).otherwise(lookup(fallbacks, F.col("alias")))
    return calls.withColumn("served_by", served).withColumn("backend", lookup(backends, F.col("served_by")))


# --- rendering --------------------------------------------------------------------


def render_item() -> Column:
    """An item as Markdown; the source line only if there is a URL."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.coalesce("name", F.lit("Unknown"))),
        F.concat(F.lit(ITEM_TYPE), F.coalesce("type", F.lit("-"))),
        F.concat(F.lit(ITEM_RELEVANCE), F.coalesce(F.col("relevance").cast("string"), F.lit("-")), F.lit("/5")),
        F.concat(F.lit(ITEM_VIABILITY), F.coalesce(F.col("viability").cast("string"), F.lit("-")), F.lit("/5")),
        F.concat(F.lit(ITEM_DESCRIPTION), F.coalesce("description", F.lit(""))),
        F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit(ITEM_SOURCE), "source_url")),
    )


def format_search_block(results: DataFrame) -> DataFrame:
    """One string with the first 40 results, numbered."""
    first = first_results(results, BLOCK_RESULTS)
    rows = F.array_sort(F.collect_list(F.struct("query_pos", "rank", "title", "url", "snippet")))
    entry = F.transform(
        rows,
        lambda r, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". TITLE: "),
            r["title"],
            F.lit("\n   URL: "),
            r["url"],
            F.lit("\n   SNIPPET: "),
            F.substring(r["snippet"], 1, BLOCK_SNIPPET),
        ),
    )
    return first.agg(F.array_join(entry, "\n\n").alias("block"))


def numbered_digest(items: DataFrame, order: str) -> DataFrame:
    """(position, entry): three text lines per item."""
    entry = F.concat(
        F.col("position").cast("string"),
        F.lit(". "),
        F.coalesce("name", F.lit("?")),
        F.lit(" ("),
        F.coalesce("type", F.lit("-")),
        F.lit(")\n   SDLC "),
        F.coalesce(F.col("relevance").cast("string"), F.lit("-")),
        F.lit("/5 | HW "),
        F.coalesce(F.col("viability").cast("string"), F.lit("-")),
        F.lit("/5\n   "),
        F.substring(F.coalesce("description", F.lit("")), 1, DIGEST_CHARS),
    )
    return numbered(items, [order]).select("position", entry.alias("entry"))


def digest_message(items: DataFrame, order: str, title: str, footer: str) -> DataFrame:
    """The message as ordered rows (position, entry), to be written as a text file.

    Position 0 is the header with the count. Without items it is the whole message.
    """
    count = items.agg(F.count("*").alias("n"))
    header = count.select(
        F.lit(0).cast("bigint").alias("position"),
        F.when(F.col("n") == 0, F.lit(f"{title}\n\n{DIGEST_EMPTY}"))
        .otherwise(F.concat(F.lit(f"{title}\n\n"), F.col("n").cast("string"), F.lit(f"{DIGEST_COUNT}\n")))
        .alias("entry"),
    )
    end = count.where("n > 0").select((F.col("n") + 1).alias("position"), F.lit(f"\n{footer}").alias("entry"))
    return header.unionByName(numbered_digest(items, order)).unionByName(end)


def report_sources(results: DataFrame) -> DataFrame:
    """Of the first 20 results, one line per distinct URL; the limit comes first."""
    first = first_results(results, REPORT_SOURCES).where("url <> ''")
    kept = first.groupBy("url").agg(F.min_by(F.struct("query", "query_pos", "rank", "title"), F.struct("query_pos", "rank")).alias("r"))
    title = F.substring(F.coalesce("r.title", "url"), 1, 80)
    return kept.select("r.query", "r.query_pos", "r.rank", F.concat(F.lit("- ["), title, F.lit("]("), "url", F.lit(")")).alias("line"))


def report(items: DataFrame, order: str, results: DataFrame, queries: DataFrame, run_date: str) -> DataFrame:
    """The weekly report as ordered rows (run_date, section, position, line)."""

    def counted(df: DataFrame, position: int, label: str) -> DataFrame:
        text = F.concat(F.lit(f"**{label}:** "), F.col("n").cast("string"))
        return df.agg(F.count("*").alias("n")).select(F.lit(0).alias("section"), F.lit(position).alias("position"), text.alias("line"))

    header = union_all(
        counted(queries, 1, REPORT_QUERIES),
        counted(results, 2, REPORT_RESULTS),
        counted(items, 3, REPORT_ITEMS),
    )
    listed = numbered(items, [order]).select(F.lit(2).alias("section"), "position", render_item().alias("line"))
    asked = queries.select(F.lit(1).alias("section"), "position", F.concat(F.lit("- `"), "query", F.lit("`")).alias("line"))
    top = Window.orderBy("query_pos", "rank")
    sources = report_sources(results).select(
        F.lit(3).alias("section"), F.row_number().over(top).alias("position"), "line"
    )
    return union_all(header, asked, listed, sources).withColumn("run_date", F.lit(run_date))


def write_report(lines: DataFrame, path: str) -> None:
    """One folder per run date; a run that is repeated replaces its own."""
    ordered = lines.sortWithinPartitions("section", "position").write.mode("overwrite")
    ordered.option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)
