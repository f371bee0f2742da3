"""Quality rules: hashed n-gram likelihood ratio of a trusted target to the raw corpus.

Words and word pairs are hashed into ``BUCKETS`` buckets. One multinomial is
counted over all documents, one over trusted documents; a document's score is
the mean log ratio of its n-grams, in one fixed order of arithmetic, and one
threshold decides on every document. Base rules on counts come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import quantiles
from . import common
from .common import SPACE, written
from .decontamination import words_between

BUCKETS = 1 << 16
#: One trusted document in so many is left out of the counts and sets the threshold.
CALIBRATE = 4
#: Quantile of the scores of these that the threshold starts from, and how far below it lies.
REFUSED, MARGIN = 0.002, 0.03
SMOOTHING = 1.0
_POSITION_BITS = 28


def with_words(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    cut = docs.select(*keep, F.col(text_col).alias("__text"), words_between(F.col(text_col), SPACE).alias("__w"))
    return cut.select(*keep, "__text", "__w", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))


def features(h: Column) -> Column:
    """Buckets of the words and the word pairs of a document."""
    pairs = F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.array().cast("array<long>"))
    return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents (quality 1, toxic 0) that make the target."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__trusted")).where("__trusted is not null").distinct()


def _sent(trusted: DataFrame) -> DataFrame:
    """Up to ``BROADCAST_IDS`` ids are broadcast, so that texts are not shuffled."""
    return F.broadcast(trusted) if trusted.count() <= common.BROADCAST_IDS else trusted


def _calibrates() -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "__trusted"), F.lit(CALIBRATE)) == 0


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(target share / raw share) of every bucket, counted over all documents."""
    h = with_words(docs, text_col, [id_col]).select(F.col(id_col).alias("__id"), features(F.col("__h")).alias("__f"))
    trusted = trusted.where(~_calibrates())
    flagged = h.join(_sent(trusted), F.col("__id") == F.col("__trusted"), "left").select(F.col("__trusted").isNotNull().cast("long").alias("__t"), F.explode_outer("__f").alias("__b"))
    rows = flagged.groupBy("__b").agg(F.count(F.lit(1)).alias("raw"), F.sum("__t").alias("target")).where("__b is not null").collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["__b"]], target[r["__b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    # The raw share smooths the target: a bucket that the target has not seen enough of says little.
    prior = [(x + SMOOTHING) / n_raw for x in raw]
    return [math.log((t + SMOOTHING * BUCKETS * q) / n_target / q) for t, q in zip(target, prior, strict=True)]


def score(h: Column, table: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 without words."""
    # One literal that is cast, not an array of 65,536 literals: Spark folds it once, when it plans.
    logs = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    total = F.aggregate(features(h), F.lit(0.0), lambda s, b: s + F.get(logs, b))
    return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(F.lit(0.0))


def repeat_words(h: Column, t: Column) -> Column:
    """Words in 3-word windows that occur twice or more; ``t`` are the windows' hashes.

    Windows are sorted as numbers whose high bits are the hash and whose low bits
    the position, so that equal ones stand together; neighbours are compared in
    full.
    """
    low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    packed = F.array_sort(F.transform(t, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    where = lambda x: x.bitwiseAND(low).cast("int")

    def equal(s: Column, x: Column, j: Column) -> Column:
        y = F.get(s, j)
        return F.coalesce((F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)) & (F.get(t, where(x)) == F.get(t, where(y))), F.lit(False))

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: equal(s, x, i - 1) | equal(s, x, i + 1) | equal(s, x, i - 2) | equal(s, x, i + 2))
        at = F.array_sort(F.transform(twice, where))
        end = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n"), (p + 3).alias("to")))
        return end["n"]

    return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(F.transform(F.array(packed), count)[0])


def measured(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, then ``__n``, ``__chars``, ``__symbols``, ``__dup_lines``, ``__repeats``, ``__score``."""
    keep = docs.columns if keep is None else keep
    h = with_words(docs, text_col, keep)
    three = F.when(F.size("__h") > 2, F.transform(F.sequence(F.lit(0), F.size("__h") - 3), lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = h.select(*keep, "__h", F.size("__w").cast("long").alias("__n"), F.length(F.array_join("__w", "")).cast("long").alias("__chars"), F.coalesce(F.regexp_count("__text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("__symbols"), lines.alias("__lines"), three.alias("__t"))
    return step.select(*keep, "__n", "__chars", "__symbols", F.coalesce(F.size("__lines") - F.size(F.array_distinct("__lines")), F.lit(0)).cast("long").alias("__dup_lines"), repeat_words(F.col("__h"), F.col("__t")).cast("long").alias("__repeats"), score(F.col("__h"), table).alias("__score"))


def threshold(docs: DataFrame, trusted: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> float:
    """The score that all but ``REFUSED`` of the calibrating documents reach, less ``MARGIN``.

    The quantile is exact, with linear interpolation, from cumulative counts over
    blocks of the scores, which are written once: no task gathers all of them.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__x")).join(_sent(trusted.where(_calibrates())), F.col("__id") == F.col("__trusted"), "left_semi")
    scored = written(with_words(own, "__x", ["__id"]).where(F.size("__w") >= 50).select(score(F.col("__h"), table).alias("__score")), "scores")
    found = quantiles(scored, ["__score"], [REFUSED]).first()
    return -math.inf if found is None else found["value"] - MARGIN


def op2_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, score and verdict of every document.

    Null and blank texts have no words and fail the base rules. Without trusted
    documents the ratio is 1 for all and only the base rules decide. Repeated
    rows are judged alike; ties at the threshold are kept.
    """
    docs = docs.select("doc_id", "text")
    trusted = written(trusted_ids(labels), "trusted")
    table = weights(docs, trusted)
    limit = threshold(docs, trusted, table)
    out = measured(docs, table, keep=["doc_id"])
    failed = (F.col("__n") < 50) | (100 * F.col("__repeats") > 50 * F.col("__n"))
    return out.select("doc_id", F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dup_lines").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (F.col("__score") >= limit)).alias("kept"), F.col("__score").alias("score"))
