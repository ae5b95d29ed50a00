"""The mix takes rows, not identifiers: shared and missing identifiers, and rows that repeat."""

from collections import Counter

from pyspark.sql import functions as F

from commercelake.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _copy string, epochs string"


def test_rows_of_one_identifier_are_taken_by_themselves(spark):
    rows = [(1, "a b c", "en", "s"), (1, "d e f", "en", "s"), (1, "d e f", "en", "t"), (None, "g h", "en", "s"), (None, "i j", "en", None)]
    rows += [(2, "same words here", "en", "s")] * 5 + [(3, None, "en", "s"), (4, "", "en", "t")]
    rows += [(10 + i, "w " * (i % 9 + 1), "de", "t") for i in range(60)]
    df = spark.createDataFrame([(*r, 0, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    found = mixing.mixed(df)
    assert found.columns == df.columns
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in found.collect())
    hashed = df.withColumn("_h", F.xxhash64("doc_id", "source", "text"))
    names = {r["_h"]: (r["doc_id"], r["source"], r["text"]) for r in hashed.collect()}
    want = Counter()
    for r in mixing.mix_counts(df.withColumn("_h", F.xxhash64("doc_id", "source", "text")), carry=("_h",)).collect():
        want[names[r["_h"]]] += r["epochs"]
    assert got == +want
    assert max(want.values()) <= 2 * 5 and all(n <= 2 for k, n in want.items() if k[0] != 2)
    assert got[(1, "s", "a b c")] >= 1 or got[(1, "s", "d e f")] >= 1


def test_no_rows(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
