"""The registered queries of the thirteen operators and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.session import shared_path, ship_package


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op3_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm import token_index

    path = shared_path(spark, "token-index")
    token_index.write_index(_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=1)
    return token_index.records(spark, path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "best"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.quality import verdicts

    return verdicts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), vocabulary(), end_id=2).drop("copy")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm import personal_data

    docs = _table(spark, sf_dir, "documents")
    return personal_data.digest(personal_data.find(docs, personal_data.fit(docs)))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.main_text import extract

    pages = extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm.merkle import verified_documents

    return verified_documents(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from commercelake.llm import url_filter

    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_urls(spark)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_dedup,
        op3_token_index,
        op4_toxicity,
        op5_quality_rules,
        op6_mixing,
        op7_license_scan,
        op8_packing,
        op9_personal_data,
        op10_main_text,
        op11_ranked_search,
        op12_merkle_manifest,
        op13_url_filter,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
        ),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(least(d.doc_id, min(reach.b)), d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
    """,
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    "op11_ranked_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ),
        i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
        all_ AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM n),
        m AS (SELECT doc_id, 25 + (75 * n * n_docs) // length AS m FROM n, all_),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, all_ GROUP BY term, n_docs),
        s AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, text,
                   concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                   xor(list_reduce(
                       list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: (ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) >> (i % 8)::INT) & 1),
                       lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295), 1) & 1 = 0 AS tampered
            FROM documents
        ),
        leaf AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
                   sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
            FROM d
        ),
        low(source, level, idx, digest, n) AS (
            SELECT source, 0, idx, leaf, n FROM leaf
            UNION ALL
            SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
            FROM low WHERE n > 1 GROUP BY source, level, idx // 3
        ),
        subroots AS (
            SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
        ),
        high(level, idx, digest, n) AS (
            SELECT 0, idx, digest, n FROM subroots
            UNION ALL
            SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
            FROM high WHERE n > 1 GROUP BY level, idx // 3
        ),
        low_steps AS (
            SELECT x.source, x.level, x.idx, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') || '.'
                || coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS step
            FROM low x JOIN low y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.idx // 3 = y.idx // 3
            WHERE x.n > 1 GROUP BY ALL
        ),
        high_steps AS (
            SELECT x.level, x.idx, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') || '.'
                || coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS step
            FROM high x JOIN high y ON x.level = y.level AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL
        ),
        steps AS (
            SELECT doc_id, level, step FROM leaf l JOIN low_steps s
                ON l.source IS NOT DISTINCT FROM s.source AND s.idx = l.idx // power(3, level)::BIGINT
            UNION ALL
            SELECT doc_id, 100 + level, step FROM leaf l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source
                JOIN high_steps s ON s.idx = r.idx // power(3, level)::BIGINT
        ),
        proof AS (SELECT doc_id, list(step ORDER BY level) AS p FROM steps GROUP BY doc_id),
        ends AS (
            SELECT l.doc_id, leaf, r.digest AS subroot, h.digest AS root,
                   sha256(replace(array_to_string(coalesce(p, []), ''), '.', '')) AS proof_sha256,
                   list_reduce(coalesce(p, []), lambda c, x: sha256(split_part(x, '.', 1) || c || split_part(x, '.', 2)), coalesce(changed, leaf)) AS folded_root
            FROM leaf l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN high h ON h.n = 1 LEFT JOIN proof p ON p.doc_id = l.doc_id
        )
        SELECT *, folded_root = root AS verified FROM ends
    """,
}
