"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

A rule names a host and the start of a path, and fits its host and all subdomains. Of the rules that
fit the longest decides. Every other URL goes to the model: each distinct n-gram of LENGTHS bytes
of the host, and of the path, falls into one of 2**BITS buckets; a URL's values are equal and have
length one. The model is fitted on a small table of labelled URLs.

A null URL, or one without `://`, has an empty host and path: no rule fits, and the model's base
decides. Lower case means A-Z only. Repeated rows are judged again; other columns are ignored, and
empty tables give no rows. Without labels everything not ruled out is allowed.
"""

from __future__ import annotations

import csv
import io
import pkgutil
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.llm.words import Lanes, chunks, mix, text_bytes

LENGTHS = (3, 4, 5, 6)
BITS = 18
#: Labelled rows the model is fitted on; of more, those with the least hashes.
MAX_LABELLED = 50_000
#: Weight of the squared length of the coefficients, and steps of the fit.
PENALTY = 3e-4
STEPS = 400

# Verdict, host, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits.

    Rules are a short list and become one expression. Of equally long ones that of the longer host
    comes first, then blocks.
    """
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    dotted = F.concat(F.lit("."), host)
    fits = [F.when(F.endswith(dotted, F.lit("." + h)) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in best]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule: string, verdict: string>"))


def grams(column: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of the rows of a text column, with repeats."""
    data, offsets = text_bytes(column)
    lanes, rows, buckets = Lanes(data).at, [], []
    for n in LENGTHS:
        counts = np.maximum(np.diff(offsets) - n + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[row]
        gram = lanes[place] & np.uint64((1 << 8 * n) - 1)
        rows.append(row)
        buckets.append((mix(gram * np.uint64(16) + np.uint64(2 * n + kind)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct buckets of each row; a host stands between dots, as its labels do."""
    dotted = pa.compute.binary_join_element_wise("", pa.compute.fill_null(hosts, ""), "", ".")
    both = [grams(dotted, 0), grams(paths, 1)]
    row, bucket = (np.concatenate([x[i] for x in both]) for i in (0, 1))
    codes = np.unique(row << BITS | bucket)
    return codes >> BITS, codes & ((1 << BITS) - 1)


@dataclass
class Model:
    base: float
    weights: np.ndarray  # one for each bucket, float32

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probability of a block for each of n rows."""
        size = np.maximum(np.bincount(row, minlength=n), 1)
        return _sigmoid(self.base + np.bincount(row, self.weights[bucket], n) / np.sqrt(size))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(row: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Model:
    """Least penalised log loss, by gradient steps with momentum; the base has no penalty."""
    used, column = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(label)), 1))[row]
    # A row's values and the base's 1 have a squared length of two, so a quarter of that bounds the curvature.
    rate = 1 / (0.25 * 2 + PENALTY)
    x = old = np.zeros(len(used) + 1)
    for step in range(STEPS):
        ahead = x + step / (step + 3) * (x - old)
        error = (_sigmoid(ahead[-1] + np.bincount(row, value * ahead[column], len(label))) - label) / len(label)
        slope = np.append(np.bincount(column, value * error[row], len(used)), error.sum())
        slope[:-1] += PENALTY * ahead[:-1]
        x, old = ahead - rate * slope, x
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:-1]
    return Model(float(x[-1]), weights)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table of the package: url, label (1: block)."""
    text = pkgutil.get_data(__package__, "url_labels.txt").decode()
    return spark.createDataFrame([(r["url"], int(r["label"])) for r in csv.DictReader(io.StringIO(text))], "url string, label int")


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled (url, label: 1 block, 0 allow). Rows without a label do not count."""
    url = F.col("url").cast("string")
    rows = labelled.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col("label").cast("int").alias("label"))
    order = (F.xxhash64("host", "path", "label"), "host", "path", "label")
    held = rows.where("label is not null").orderBy(*order).limit(max_labelled).toArrow()
    if not len(held):
        return Model(-30.0, np.zeros(1 << BITS, np.float32))
    hosts, paths, label = (held.column(i).combine_chunks() for i in range(3))
    return _fit(*features(hosts, paths), label.to_numpy().astype(float))


def score(rows: DataFrame, model: Model, kept: Sequence[str]) -> DataFrame:
    """The kept columns of rows (with host and path), and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(0), b.column(1)
            sizes = [pa.compute.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hosts, paths)]
            for a, z in chunks(np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]), 1 << 19):
                found = model.scores(*features(hosts.slice(a, z - a), paths.slice(a, z - a)), z - a)
                some = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*some.columns[2:], pa.array(found)], [*some.schema.names[2:], "score"])

    columns = [F.col("host").alias("_host"), F.col("path").alias("_path"), *kept]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*columns).mapInArrow(run, f"{schema}, score double")


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict and the model's score of each of pages (page_id, url)."""
    url = F.col("url").cast("string")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = score(cut, model, ("page_id", "host", "path"))
    ruled = scored.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), "score")
