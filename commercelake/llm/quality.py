"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. Per language and source the half of the
texts with the least determinant of its covariance is sought by concentration steps: distances
under the present centre and covariance, their median from a histogram, and the mean and
covariance of the rows below it. All groups take a step in the same few aggregates, so a hot
group is only a larger sum. Texts too far from their group by Mahalanobis distance are rejected.

Groups of fewer than MIN_GROUP vectors use those of their language, then of all rows; with
fewer than that in all, nothing is rejected by distance. To the covariance comes the sampling
noise of the one text (FLOORS, larger for short texts), since a statistic that is zero in half of the
texts has no spread of its own. The half's covariance counts times CONSISTENCY in the cutoff.

Null and empty texts have no words and fail the base rules. Null languages or sources form
groups of their own. A repeated row counts again. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commercelake.llm.words import chunks, text_bytes, windows, word_hashes, word_spans
from commercelake.session import cut_lineage

MIN_WORDS = 50
MIN_GROUP = 200
STEPS = 6
#: A normal covariance in 4 dimensions by that of its inner half: 0.5 / P(chi2(6) < median of chi2(4)).
CONSISTENCY = 2.109
#: Standard deviations by chance in a text of NOISE_WORDS words and NOISE_LINES lines, by the root of CONSISTENCY:
#: mean word length, and a quarter of an event (the variance of a root of a count) of symbols, lines, and 6 words at once.
#: Longer texts have them too: what tells texts apart does not vanish with length.
NOISE_WORDS, NOISE_LINES = 200, 10
FLOORS = tuple(x / CONSISTENCY**0.5 for x in (0.04, 0.81, 0.16, 0.087))
#: Squared distance under the half's covariance beyond which a text is rejected: the 0.9999 quantile for 4 degrees.
CUTOFF = CONSISTENCY * 23.51
BINS_PER_E = 64
_X = ("x0", "x1", "x2", "x3")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeat_words(hashes: np.ndarray) -> int:
    """Words in 3-word windows found twice or more."""
    found = windows(hashes, 3)
    if not len(found):
        return 0
    _, back, count = np.unique(found, return_inverse=True, return_counts=True)
    inside = np.zeros(len(hashes), bool)
    at = np.flatnonzero(count[back] > 1)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    out = {k: np.zeros(rows, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    for a, z in chunks(offsets):
        raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        starts, ends, at = word_spans(raw, own)
        hashes = word_hashes(raw, starts, ends, fold=False)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
        out["n_words"][a:z] = np.diff(at)
        out["word_chars"][a:z] = np.diff(chars[at])
        out["n_symbols"][a:z] = np.diff(symbols[own])
        whole = raw.tobytes()
        for i in range(z - a):
            first, last = at[i], at[i + 1]
            if first == last:
                continue
            out["n_repeat_words"][a + i] = _repeat_words(hashes[first:last])
            lines = [x for x in whole[own[i] : own[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
            out["n_lines"][a + i] = len(lines)
            out["n_dup_lines"][a + i] = len(lines) - len(set(lines))
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics and base_failed of every row."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = text_statistics(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(v) for v in found.values()]], names=[*b.schema.names[:3], *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        stats,
        f"doc_id {kind}, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
            "x1": F.log1p(1000.0 * F.col("n_symbols") / words),
            "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "x3": F.sqrt(F.col("n_repeat_words") / words),
            # Variances by chance, as multiples of those in FLOORS.
            "_vw": F.greatest(F.lit(1.0), NOISE_WORDS / words),
            "_vl": F.greatest(F.lit(1.0), NOISE_LINES / F.greatest(F.col("n_lines"), F.lit(1))),
        }
    )


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def _moments(rows: DataFrame) -> DataFrame:
    """Per group: mean and covariance."""
    return rows.groupBy(F.col("_group").alias("_g")).agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)],
        *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i, j in _PAIRS],
    )


def _measure(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with _d, the squared distance under the covariance of the group and the noise of the text."""
    floors, names = np.square(FLOORS), rows.columns

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = {k: b.column(k).to_numpy(zero_copy_only=False) for k in (*_X, "_vw", "_vl", *[f"m{i}" for i in range(4)], *[f"c{i}{j}" for i, j in _PAIRS])}
            c = np.zeros((b.num_rows, 4, 4))
            for i, j in _PAIRS:
                c[:, i, j] = c[:, j, i] = v[f"c{i}{j}"]
            for i in range(4):
                c[:, i, i] += floors[i] * v["_vl" if i == 2 else "_vw"]
            off = np.stack([v[x] - v[f"m{i}"] for i, x in enumerate(_X)], axis=1)
            d = (off * np.linalg.solve(c, off[:, :, None])[:, :, 0]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(d)], names=[*names, "_d"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _with_model(rows, model).mapInArrow(distance, f"{schema}, _d double")


def _with_model(rows: DataFrame, model: DataFrame, group: str = "_group") -> DataFrame:
    """The model has a row per group, few beside the rows; a hot group's rows are salted."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    repeated = model.withColumn("_at", F.expr("explode(sequence(0L, 15L))"))
    return salted.join(repeated, (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_at"))).drop("_salt", "_at", "_g")


def verdicts(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, steps: int = STEPS) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared) and kept of every row."""
    stats = cut_lineage(statistics(docs))
    good = _vector(stats.where(~F.col("base_failed")))
    # Groups are named as JSON, so that nulls and any characters are told apart.
    names = [F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")]
    rows = good.withColumns({"_fine": names[0], "_lang": names[1], "_all": names[2]})
    fine = rows.groupBy("_fine", "_lang").agg(F.count("*").alias("_nf"))
    langs = Window.partitionBy("_lang")
    level = (
        fine.select("*", F.sum("_nf").over(langs).alias("_nl"))
        .select(
            F.col("_fine").alias("_name"),
            F.when(F.col("_nf") >= min_group, F.col("_fine")).when(F.col("_nl") >= min_group, F.col("_lang")).otherwise(F.lit("all")).alias("_group"),
        )
    )
    spread = level.select(F.col("_name").alias("_g"), "_group")
    rows = _with_model(rows, spread, "_fine")
    rows = cut_lineage(rows.select("doc_id", "_fine", "_lang", *_X, "_vw", "_vl", "_group"))
    # A group's model is learned from all rows of its level, not only from those that use it.
    used = level.select(F.col("_group").alias("_u")).distinct()
    members = rows.select(*_X, "_vw", "_vl", "doc_id", F.explode(F.array("_fine", "_lang", F.lit("all"))).alias("_group"))
    members = cut_lineage(members.join(used, F.col("_group") == F.col("_u"), "left_semi"))
    model = cut_lineage(_moments(members))
    for _ in range(steps):
        far = _measure(members.select("doc_id", *_X, "_vw", "_vl", "_group"), model)
        binned = far.withColumn("_bin", F.floor(F.log(F.col("_d") + 1e-6) * BINS_PER_E))
        order = Window.partitionBy("_group").orderBy("_bin")
        counts = binned.groupBy("_group", "_bin").agg(F.count("*").alias("_c"))
        counts = counts.select("*", F.sum("_c").over(order).alias("_run"), F.sum("_c").over(Window.partitionBy("_group")).alias("_tot"))
        median = counts.where(2 * F.col("_run") >= F.col("_tot")).groupBy(F.col("_group").alias("_g")).agg(F.min("_bin").alias("_mid"))
        near = _with_model(binned, median).where(F.col("_bin") <= F.col("_mid"))
        model = cut_lineage(_moments(near))
    sizes = members.groupBy(F.col("_group").alias("_gs")).agg(F.count("*").alias("_members"))
    model = model.join(sizes.where(F.col("_members") >= min_group), F.col("_g") == F.col("_gs"), "left_semi")
    judged = _measure(rows.select("doc_id", *_X, "_vw", "_vl", "_group"), model)
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("_d").alias("distance")).groupBy("_id").agg(F.max("distance").alias("distance"))
    joined = stats.join(judged, stats["doc_id"] == F.col("_id"), "left").drop("_id")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return joined.withColumn("kept", kept)
