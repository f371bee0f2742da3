"""Language ID by interpolated Kneser-Ney character models.

One 4-gram model for each language, counted over all training documents. A gram
is four folded code points packed into 64 bits; a model keeps its grams of each
order, and their contexts, as sorted arrays of these keys, or as Parquet tables
where there are too many to hold (``GramTables``). A document's language
is the one of the lowest cross-entropy per scored character. Documents whose
entropy is far above what training documents of that language show are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import quantiles_of
from .common import text_slices, written

ORDER = 4
SPACE = 32
#: Distinct 4-grams of all languages that are held in memory; where there are more, models are tables.
MAX_GRAMS = 400_000
#: A document is rejected at so many standard deviations above the mean entropy, and not
#: below ``MARGIN`` times what all but the last hundredth of the training documents show:
#: a few mislabelled ones among them do not open the door for others like them.
REJECT_Z, MARGIN, QUANTILE = 8.0, 2.5, 0.99
UNIFORM = 1.0 / 4096
_CHUNK = 1_000_000


def folded(cp: int) -> int:
    """Letters in lower case, below 2**16; whatever is no letter is a space."""
    c = chr(cp)
    if not c.isalpha():
        return SPACE
    low = ord(c.lower()[0])
    return low if low < 0x10000 else 0xE000 + low % 0x1900


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram keys of ``texts``, each position's index into them (-1: not scored), and where texts begin.

    A text begins after three spaces. A position is scored if its character or
    the one before is a letter.
    """
    pad = " " * (ORDER - 1)
    cps = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + ORDER - 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    seen = np.flatnonzero(np.bincount(cps))
    table = np.zeros(int(seen[-1]) + 1, dtype=np.int64)
    fold = np.array([folded(int(c)) for c in seen], dtype=np.int64)
    alphabet, ids = np.unique(fold, return_inverse=True)
    table[seen] = ids
    c = table[cps]
    pair = c[:-1] * len(alphabet) + c[1:]
    pairs, pair = _dense(pair, len(alphabet) ** 2)
    quad = pair[:-2] * len(pairs) + pair[2:]
    quads, quad = _dense(quad, len(pairs) ** 2)
    left, right = pairs[quads // len(pairs)], pairs[quads % len(pairs)]
    a, b, d, e = (alphabet[x] for x in (left // len(alphabet), left % len(alphabet), right // len(alphabet), right % len(alphabet)))
    keys = (a.astype(np.uint64) << np.uint64(48)) | (b.astype(np.uint64) << np.uint64(32)) | (d.astype(np.uint64) << np.uint64(16)) | e.astype(np.uint64)
    at = np.full(len(cps), -1, dtype=np.int64)
    at[ORDER - 1 :] = np.where(((d != SPACE) | (e != SPACE))[quad], quad, -1)
    for k in range(ORDER - 1):
        at[starts + k] = -1
    return keys, at, starts


def _dense(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size > 1 << 25:
        return np.unique(codes, return_inverse=True)
    flag = np.zeros(size, dtype=bool)
    flag[codes] = True
    found = np.flatnonzero(flag)
    number = np.zeros(size, dtype=np.int32)
    number[found] = np.arange(len(found), dtype=np.int32)
    return found, number[codes].astype(np.int64)


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts, null and empty ones left out, about a million characters at a time."""
    rows, own, n = [], [], 0
    for i, t in enumerate(texts):
        if t:
            rows.append(i)
            own.append(t)
            n += len(t) + ORDER
            if n >= _CHUNK:
                yield rows, own
                rows, own, n = [], [], 0
    if rows:
        yield rows, own


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each partition: counts are summed before they are shuffled."""
    total: dict[str, list] = {}

    def merge(parts: list) -> list:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)))]

    for batch in (part for whole in batches for part in text_slices(whole, 1)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, own in chunks([t if x == lang else None for x, t in zip(langs, texts, strict=True)]):
                keys, at, _ = grams(own)
                n = np.bincount(at[at >= 0], minlength=len(keys))
                parts = total.setdefault(lang, [])
                parts.append((keys[n > 0], n[n > 0]))
                if len(parts) > 16:
                    total[lang] = merge(parts)
    for lang, parts in total.items():
        keys, n = merge(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class KneserNey:
    """Interpolated Kneser-Ney model of one language in sorted arrays."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(float)
        self.levels = []
        for k in range(ORDER, 0, -1):
            few, pairs = (n == 1).sum(), (n == 2).sum()
            cut = few / (few + 2 * pairs) if few else 0.5
            contexts, which = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(which, weights=n)
            types = np.bincount(which)
            # keys, their discounted share, contexts, the mass that goes to the next order
            self.levels.append((keys, np.maximum(n - cut, 0) / total[which], contexts, np.minimum(1.0, cut * types / total)))
            if k > 1:  # counts of the next order are the number of characters seen before a gram
                keys, n = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                n = n.astype(float)

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), missing)
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[i] == keys, values[i], missing)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each gram's last character after the others."""
        p = np.full(len(keys), UNIFORM)
        for k, (own, share, contexts, back) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            g = keys & np.uint64((1 << 16 * k) - 1) if k < 4 else keys
            p = self._find(own, share, g, 0.0) + self._find(contexts, back, g >> np.uint64(16), 1.0) * p
        return -np.log2(np.maximum(p, 1e-12))


def entropies(texts: list[str | None], models: list[KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """Bits for each text and model, and the number of scored characters of each text."""
    bits, n = np.zeros((len(texts), len(models))), np.zeros(len(texts))
    for rows, own in chunks(texts):
        keys, at, starts = grams(own)
        keep = at >= 0
        n[rows] = np.add.reduceat(keep.astype(np.int64), starts)
        for j, m in enumerate(models):
            cost = np.append(m.cost(keys), 0.0)
            bits[rows, j] = np.add.reduceat(cost[at], starts)
    return bits, n


class GramTables:
    """The same models as tables: nothing of them is gathered on the driver or in a worker."""

    def __init__(self, counts: DataFrame):
        """``counts``: (lang, gram, n) of all 4-grams."""
        self.names = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
        self.levels = []
        for k in range(ORDER, 0, -1):
            few, pairs = (F.sum((F.col("n") == i).cast("double")) for i in (1, 2))
            cut = counts.groupBy("lang").agg(F.when(few > 0, few / (few + 2 * pairs)).otherwise(0.5).alias("cut"))
            own = counts.withColumn("context", F.shiftrightunsigned("gram", 16))
            contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).join(F.broadcast(cut), "lang")
            shares = own.join(contexts, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")).alias("share"))
            back = contexts.select("lang", "context", F.least(F.lit(1.0), F.col("cut") * F.col("types") / F.col("total")).alias("back"))
            self.levels.append((written(shares.sort("gram"), f"language-shares{k}"), written(back.sort("context"), f"language-contexts{k}")))
            if k > 1:
                counts = written(counts.groupBy("lang", _low("gram", k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"language-grams{k - 1}")

    def _chances(self, asked: DataFrame, k: int) -> DataFrame:
        """(lang, gram, p) of the distinct grams ``asked`` of order ``k``."""
        shares, back = self.levels[ORDER - k]
        each = asked.select("gram", F.explode(F.array(*(F.lit(x) for x in self.names))).alias("lang")).withColumn("context", F.shiftrightunsigned("gram", 16))
        found = each.join(shares, ["lang", "gram"], "left").join(back, ["lang", "context"], "left")
        if k > 1:
            lower = self._chances(asked.select(_low("gram", k - 1).alias("gram")).distinct(), k - 1).withColumnRenamed("gram", "low")
            found = found.withColumn("low", _low("gram", k - 1)).join(lower, ["lang", "low"])
        else:
            found = found.withColumn("p", F.lit(UNIFORM))
        return found.select("lang", "gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(__key, __h, __n) of each distinct text of the column ``__text``: entropies by model, and scored characters."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in text_slices(whole, 1)):
                names = batch.column(0)
                for rows, own in chunks(batch.column(1).to_pylist()):
                    keys, at, starts = grams(own)
                    doc = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(at))))
                    found, n = np.unique((doc * len(keys) + at)[at >= 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.asarray(rows)[found // len(keys)])), pa.array(keys[found % len(keys)].astype(np.int64)), pa.array(n.astype(np.int64))], ["__key", "gram", "n"])

        seen = texts.select(text_key(F.col("__text")).alias("__key"), "__text").mapInArrow(count, "__key string, gram long, n long")
        seen = written(seen.groupBy("__key", "gram").agg(F.max("n").alias("n")), "language-occurrences")
        cost = self._chances(seen.select("gram").distinct(), ORDER).groupBy("gram").agg(*(F.max(F.when(F.col("lang") == x, -F.log2(F.greatest("p", F.lit(1e-12))))).alias(f"c{i}") for i, x in enumerate(self.names)))
        summed = seen.join(cost, "gram").groupBy("__key").agg(F.sum("n").cast("double").alias("__n"), *(F.sum(F.col("n") * F.col(f"c{i}")).alias(f"b{i}") for i in range(len(self.names))))
        return written(summed.select("__key", F.array(*(F.col(f"b{i}") / F.col("__n") for i in range(len(self.names)))).alias("__h"), "__n"), "language-entropies")


def _low(gram: str, k: int) -> Column:
    """The last ``k`` characters of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))


def text_key(text: Column) -> Column:
    return F.md5(text)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, KneserNey] | GramTables:
    """A model for each language of ``docs``; rows without language or text are left out."""
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    n = written(own.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    if n.count() > MAX_GRAMS:
        return GramTables(n)
    return {lang: KneserNey(g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy()) for lang, g in sorted(n.toPandas().groupby("lang"))}


def calibrate(docs: DataFrame, models: dict[str, KneserNey] | GramTables, lang_col: str, text_col: str) -> dict[str, tuple[float, float, float, float]]:
    """Mean entropy, variance of a character, variance of a long text, and the limit in deviations, by language.

    They come from every training document: sums by language, and exact quantiles
    from blocked counts, so that no task and not the driver gathers the documents.
    """
    names = models.names if isinstance(models, GramTables) else list(models)
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("__text")).where(F.col("lang").isin(names))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            langs, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                bits, n = entropies([t if x == lang else None for x, t in zip(langs, own, strict=True)], [models[lang]])
                ok = n > 0
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(ok.sum()), pa.string()), pa.array(bits[ok, 0] / n[ok]), pa.array(n[ok])], ["lang", "h", "n"])

    out = {lang: (4.0, 16.0, 0.25, REJECT_Z) for lang in names}
    if not names:
        return out
    if isinstance(models, GramTables):
        scored = texts.withColumn("__key", text_key(F.col("__text"))).join(models.entropies(texts), "__key")
        own_model = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("lang")).cast("int")
        rows = scored.select("lang", F.get("__h", own_model - 1).alias("h"), F.col("__n").alias("n"))
    else:
        rows = texts.mapInArrow(measure, "lang string, h double, n double")
    # Three figures a document, read three times.
    rows = written(rows, "language-calibration")
    means = {r["lang"]: r["mean"] for r in rows.groupBy("lang").agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("mean")).collect()}
    apart = F.col("h") - _of_language(means)
    spreads = {r["lang"]: r for r in rows.groupBy("lang").agg(F.sum(F.col("n") * apart * apart).alias("spread"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).collect()}
    char = {lang: max(4.0, r["spread"] / r["docs"]) for lang, r in spreads.items()}
    long = {lang: max(0.01, r["spread"] / r["n"]) for lang, r in spreads.items()}
    counts = rows.select(F.col("lang").alias("column"), (apart / F.sqrt(_of_language(long) + _of_language(char) / F.col("n"))).alias("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("nr"), F.lit(0).cast("long").alias("ns"))
    for r in quantiles_of(written(counts, "language-deviations"), [QUANTILE]).collect() if means else []:
        lang = r["column"]
        out[lang] = (means[lang], char[lang], long[lang], max(REJECT_Z, MARGIN * r["value"]))
    return out


def _of_language(found: dict[str, float]) -> Column:
    """The figure of the row's ``lang``."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in found.items() for x in pair)), F.col("lang")) if found else F.lit(None).cast("double")


def identify(docs: DataFrame, models: dict[str, KneserNey] | GramTables, limits: dict[str, tuple[float, float, float, float]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``), then ``__lang``, ``__score``, ``__entropy``, ``__rejected``.

    ``__lang`` is ``und``, with score 0, entropy null and rejected, where the text
    is null or has no letter, or nothing was learned. ``__score`` is the share of
    the best model in the likelihood of at most 64 characters; on a tie the first
    language by name is taken. Whole texts are scored, however long; repeated rows
    score alike; an empty table gives an empty result. Other columns pass through
    unread, whatever their names but those of the four added.
    """
    keep = docs.columns if keep is None else keep
    if isinstance(models, GramTables):
        return _identify_by_tables(docs, models, limits, text_col, keep)
    source = docs.select(F.col(text_col).alias(_free("__text", keep)), *(F.col(f"`{c}`") for c in keep))
    told = T.StructType([T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__entropy", T.DoubleType()), T.StructField("__rejected", T.BooleanType())])
    schema = T.StructType([*source.schema.fields[1:], *told.fields])
    names, fitted = list(models), list(models.values())
    mean, char, long, limit = (np.array([limits[x][i] for x in names]) for i in range(4))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 0)):
            bits, n = entropies(batch.column(0).to_pylist(), fitted)
            known = (n > 0) & bool(names)
            h = bits / np.maximum(n, 1)[:, None]
            if names:
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                p = 1 / np.exp2(-(h - low[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
                far = (low - mean[best]) > limit[best] * np.sqrt(long[best] + char[best] / np.maximum(n, 1))
            else:
                best, low, p, far = np.zeros(len(h), int), np.zeros(len(h)), np.zeros(len(h)), np.ones(len(h), bool)
            out = [pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(low, mask=~known), pa.array(far | ~known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*keep, "__lang", "__score", "__entropy", "__rejected"])

    return source.mapInArrow(score, schema)


def _free(name: str, taken: list[str]) -> str:
    return name if name not in taken else _free(name + "_", taken)


def _identify_by_tables(docs: DataFrame, models: GramTables, limits: dict[str, tuple[float, float, float, float]], text_col: str, keep: list[str]) -> DataFrame:
    text = _free("__text", keep)
    own = docs.select(F.col(text_col).alias(text), *(F.col(f"`{c}`") for c in keep))
    found = own.withColumn("__key", text_key(F.col(text))).join(models.entropies(own.select(F.col(text).alias("__text"))), "__key", "left").drop(text, "__key")
    best = found.withColumn("__entropy", F.array_min("__h")).withColumn("__best", F.array_position("__h", F.col("__entropy")).cast("int") - 1)
    mean, char, long, limit = (F.get(F.array(*(F.lit(float(limits[x][i])) for x in models.names)), F.col("__best")) for i in range(4))
    total = F.aggregate("__h", F.lit(0.0), lambda a, h: a + F.pow(F.lit(2.0), -(h - F.col("__entropy")) * F.least("__n", F.lit(64.0))))
    far = F.col("__entropy") - mean > limit * F.sqrt(long + char / F.col("__n"))
    name = F.get(F.array(*(F.lit(x) for x in models.names)), F.col("__best"))
    return best.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(name, F.lit("und")).alias("__lang"), F.coalesce(1 / total, F.lit(0.0)).alias("__score"), "__entropy", F.coalesce(far, F.lit(True)).alias("__rejected"))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def learned(docs: DataFrame) -> tuple[dict | GramTables, dict]:
    """Models and limits from the documents that are not held out."""
    own = docs.select("doc_id", "lang", "text").where(~F.coalesce(held_out(), F.lit(False)))
    models = train(own)
    return models, calibrate(own, models, "lang", "text")


def op8_language_id(docs: DataFrame) -> DataFrame:
    """Predicted language of every document."""
    models, limits = learned(docs)
    out = identify(docs.select("doc_id", "text"), models, limits, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__entropy").alias("entropy"), F.col("__rejected").alias("rejected"))
