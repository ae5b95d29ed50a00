"""Conversation and document jobs: history, markers, file blocks, logs, secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercelake.functions.text import file_header, first_line, line_count, replace_first, strip
from commercelake.operators.ordered import running
from commercelake.operators.skew import salted_join

# Markers and names of the text formats.
SPEC_START = "---SPEC-START---"
SPEC_END = "---SPEC-END---"
FILE_SEPARATOR = "---FILE---"
UNKNOWN_FILE = "unknown.py"

# Fixed values, in this dialect; the two paths hold any folder name where a caller would put
# their own (pass `patterns` for that), and the last pattern is an addition.
SECRET_PATTERNS = {
    "host-specific home paths": r"(?i)/home/[a-z0-9_-]+/[a-z0-9_-]+",
    "tunnel credential UUID paths": r"(?i)/etc/[a-z]+/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.json",
    "private key material": r"(?i)BEGIN [A-Z ]+PRIVATE KEY",
    "likely token values": r"(?i)(bearer\s+[a-z0-9._-]{20,}|(api[_-]?key|client[_-]?secret|auth[_-]?token)\s*[:=]\s*[\"']?[a-z0-9._-]{20,})",
    "quoted hex tokens": r"(?i)token\s*=\s*\"[0-9a-f]{40}\"",
}
# Every match of a pattern holds one of these, in any case.
SECRET_LITERALS = {
    "host-specific home paths": ["/home/"],
    "tunnel credential UUID paths": ["/etc/"],
    "private key material": ["private key"],
    "likely token values": ["bearer", "api", "client", "auth"],
    "quoted hex tokens": ["token"],
}


def _matches(label: str, pattern: str, literals: dict[str, list[str]]) -> Column:
    """All matches; a text without any of the label's literals skips the pattern."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    if label not in literals:
        return found
    some = F.lit(False)
    for literal in literals[label]:
        some = some | F.contains(F.lower("text"), F.lit(literal))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def chat_history(messages: DataFrame, system_prompt: str) -> DataFrame:
    """Ordered messages per conversation, the system prompt first at position -1.

    Rows instead of one array per conversation: a conversation of any length stays spread
    over the cluster, and sorting by (conv_id, position) gives the request body's order.
    """
    lead = messages.select("conv_id").distinct()
    lead = lead.select(
        "conv_id", F.lit(-1).cast("bigint").alias("position"), F.lit("system").alias("role"), F.lit(system_prompt).alias("content")
    )
    turns = messages.select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return lead.unionByName(turns).withColumn("message", F.to_json(F.struct("role", "content")))


def extract_spec(replies: DataFrame) -> DataFrame:
    """Add has_spec (a start marker occurs) and spec, the trimmed text between the markers."""
    block = rf"(?s){SPEC_START}(.*?){SPEC_END}"
    return replies.withColumn("has_spec", F.contains("reply", F.lit(SPEC_START))).withColumn(
        "spec", F.when(F.col("reply").rlike(block), strip(F.regexp_extract("reply", block, 1)))
    )


def split_files(replies: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, pos, filename, content): blocks between separators, blank ones dropped;
    the name stands in a block's first line."""
    blocks = F.filter(F.transform(F.split("reply", FILE_SEPARATOR), strip), lambda b: b != "")
    name = strip(F.regexp_extract(first_line(F.col("content")), r"# FILE: ([^\n]+)", 1))
    return replies.select(*keep, F.posexplode(blocks).alias("pos", "content")).withColumn(
        "filename", F.when(name == "", UNKNOWN_FILE).otherwise(name)
    )


def clean_generated(outputs: DataFrame, requested: str | None = None) -> DataFrame:
    """Add content (first opening and first closing fence removed, trimmed), filename and lines.

    Without a header in the content the name is that of the requested column, if given.
    """
    opened = replace_first(F.col("raw"), r"(?md:^)```\w*\n?")
    closed = replace_first(opened, r"\n?```(?md:$)")
    out = outputs.withColumn("content", strip(closed))
    name = file_header(F.col("content"))
    asked = F.coalesce(F.nullif(F.col(requested), F.lit("")), F.lit(UNKNOWN_FILE)) if requested else F.lit(UNKNOWN_FILE)
    return out.withColumn("filename", F.when(name == "", asked).otherwise(name)).withColumn(
        "lines", line_count(F.col("content"))
    )


def salvage_json_array(replies: DataFrame, id_column: str, schema: str) -> DataFrame:
    """Rows of the JSON array between the first '[' and the last ']', fences ignored; a reply
    without a valid array gives none."""
    plain = F.regexp_replace("reply", r"```(?:json)?\s*", "")
    array = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    valid = F.when(F.try_parse_json(array).isNotNull(), array)
    return replies.select(id_column, F.inline(F.from_json(valid, f"array<struct<{schema}>>")))


def parse_test_log(logs: DataFrame) -> DataFrame:
    """Counts from the summary line and counts of lines with a status, and the failing lines."""

    def summary(word: str) -> Column:
        return F.coalesce(F.regexp_extract("log", rf"(\d+) {word}", 1).try_cast("bigint"), F.lit(0).cast("bigint"))

    lines = F.split("log", "\n")

    def having(word: str) -> Column:
        return F.size(F.filter(lines, lambda x: F.contains(x, F.lit(word)))).cast("bigint")

    return logs.select(
        "*",
        summary("passed").alias("passed_summary"),
        summary("failed").alias("failed_summary"),
        having("PASSED").alias("passed"),
        having("FAILED").alias("failed"),
        having("ERROR").alias("errors"),
        F.array_join(F.filter(lines, lambda x: x.rlike("^(FAILED|ERROR)")), "\n").alias("failures"),
    )


def test_outcome(parsed: DataFrame) -> DataFrame:
    """Add status: PASS if any test passed, else FAIL if any failed or broke, else SKIP."""
    return parsed.withColumn(
        "status", F.when(F.col("passed") > 0, "PASS").when((F.col("failed") > 0) | (F.col("errors") > 0), "FAIL").otherwise("SKIP")
    )


test_outcome.__test__ = False


def denylist(lines: list[str]) -> dict[str, str]:
    """Extra patterns of a deny list; blank lines and comments are skipped."""
    return {line: f"(?i){line}" for line in lines if line.strip() and not line.lstrip().startswith("#")}


def secret_scan(documents: DataFrame, patterns: dict[str, str] = SECRET_PATTERNS, literals=SECRET_LITERALS) -> DataFrame:
    """One row per pattern: OK or FAIL, documents hit, matches. One pass over whole texts."""
    counted = documents.select(
        *[F.size(_matches(label, p, literals)).alias(f"n{i}") for i, (label, p) in enumerate(patterns.items())]
    ).agg(
        *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(patterns))],
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(patterns))],
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(f"d{i}").alias("documents"), F.col(f"m{i}").alias("matches"))
            for i, label in enumerate(patterns)
        ]
    )
    return counted.select(F.inline(rows)).withColumn("result", F.when(F.col("matches") > 0, "FAIL").otherwise("OK"))


def secret_matches(
    documents: DataFrame, id_column: str, patterns: dict[str, str] = SECRET_PATTERNS, literals=SECRET_LITERALS
) -> DataFrame:
    """(id, label, match) for every match of every pattern."""
    found = F.array(
        *[
            F.struct(F.lit(label).alias("label"), _matches(label, p, literals).alias("found"))
            for label, p in patterns.items()
        ]
    )
    return documents.select(id_column, F.inline(found)).select(id_column, "label", F.explode("found").alias("match"))


def count_requirements(specs: DataFrame, minimum: int = 5) -> DataFrame:
    """Add requirements (lines that begin RF-<n>) and whether there are enough."""
    n = F.regexp_count("spec", F.lit(r"(?md)^RF-\d+")).cast("bigint")
    return specs.withColumn("requirements", n).withColumn("enough", F.col("requirements") >= minimum)


def count_tests(files: DataFrame) -> DataFrame:
    """Add tests: lines that define a test function, async ones included."""
    return files.withColumn("tests", F.regexp_count("content", F.lit(r"(?md)^(async )?def test_")).cast("bigint"))


def strip_header(content: Column) -> Column:
    """Drop the first line if it is a '# FILE:' header."""
    return F.when(content.startswith("# FILE:"), F.regexp_replace(content, r"\A[^\n]*(\n|\z)", "")).otherwise(content)


def fix_bundle(files: DataFrame, run: str, order: str) -> DataFrame:
    """A run's files as blocks in order: (run, position, chars_before, block).

    The bundle is the blocks joined by a blank line; chars_before is where a block starts in
    it. It stays rows because a run may hold more text than one cell or task can.
    """
    block = F.concat(F.lit("--- "), "filename", F.lit(" ---\n"), "content")
    rows = files.select(run, order, block.alias("block")).withColumn("_size", (F.length("block") + 2).cast("bigint"))
    out = running(rows, [run], [order], {"position": ("count", F.lit(1)), "_end": ("sum", F.col("_size"))})
    return out.select(run, "position", (F.col("_end") - F.col("_size")).alias("chars_before"), "block")


def progressive_context(files: DataFrame, run: str, order: str, text: str) -> DataFrame:
    """For each file what precedes it in its run: context_files and context_chars.

    A file's context is the run's files before it, which this keeps as a range: the rows of
    the run with a lower order. Copying the texts would square the size of a run; use
    context_of for the texts of chosen files.
    """
    sized = files.withColumn("_size", F.length(text).cast("bigint"))
    out = running(sized, [run], [order], {"_files": ("count", F.lit(1)), "_chars": ("sum", F.col("_size"))})
    return out.select(
        *files.columns, (F.col("_files") - 1).alias("context_files"), (F.col("_chars") - F.col("_size")).alias("context_chars")
    )


def context_of(files: DataFrame, targets: DataFrame, run: str, order: str) -> DataFrame:
    """The rows that form the context of the given (run, order) targets."""
    wanted = targets.select(run, F.col(order).alias("target"))
    return salted_join(files, wanted, [run]).where(F.col(order) < F.col("target"))


def infer_filename(outputs: DataFrame, known: DataFrame, id_column: str, run: str) -> DataFrame:
    """Name outputs without a file name after a known file of their run: one whose header
    stands in the content or, for router code, one with 'routes' in its name; first by name.

    Headers are read out of the content and matched by an equi join, so no output is
    compared with every known file.
    """
    nameless = F.coalesce("filename", F.lit("")).isin("", UNKNOWN_FILE)
    open_ = outputs.where(nameless).select(id_column, run, "content")
    names = known.select(run, F.col("filename").alias("_name")).distinct()
    headers = F.array_distinct(F.regexp_extract_all("content", F.lit(r"# FILE: ([^\s]*?\.py)"), 1))
    by_header = salted_join(open_.select(id_column, run, F.explode(headers).alias("_name")), names, [run, "_name"])
    first_route = names.where(F.contains("_name", F.lit("routes"))).groupBy(run).agg(F.min("_name").alias("_name"))
    routers = open_.where(F.contains("content", F.lit("router = APIRouter"))).select(id_column, run)
    by_route = salted_join(routers, first_route, [run]).select(id_column, run, "_name")
    inferred = (
        by_header.select(id_column, run, "_name").unionByName(by_route).groupBy(id_column).agg(F.min("_name").alias("_name"))
    )
    name = F.when(nameless, F.coalesce("_name", F.lit(UNKNOWN_FILE))).otherwise(F.col("filename"))
    return outputs.join(inferred, id_column, "left").withColumn("filename", name).drop("_name")


def discard_unknown_targets(outputs: DataFrame, known: DataFrame, run: str) -> DataFrame:
    """Keep outputs whose file already exists in the run.

    Both sides come straight from a shuffle, so adaptive execution splits a hot file.
    """
    return outputs.join(known.select(run, "filename"), [run, "filename"], "left_semi").select(*outputs.columns)
