"""Distances between the columns of a real and a synthetic table.

Values are counted by (column, value) once, in one scan of each table, and the
counts are kept: they are the small side of everything that follows. Figures of
one row a column or block of a column are collected and come back as constants;
they are as small as the schema, or one row for a million distinct values. Cumulative
shares come from windows over blocks of a column, with the sums of earlier blocks
added. Crowded blocks are cut again, so their number follows the data and a column
of very many values is no single task's work.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import column, is_numeric, is_time, micros, present
from .date_votes import chosen

SCORE_OK = 0.2
#: Blocks that a column, and every block of too many values, is cut into; values that one may hold.
BLOCKS = 32
BLOCK_VALUES = 1 << 20
#: Figures of blocks that are broadcast; more are joined as they are.
BROADCAST_ROWS = 100_000
DELTA = 0.1
DAY = 86_400_000_000


def both(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Shared columns of both tables, tagged ``src`` r or s."""
    shared = [c for c in real.columns if c in set(synth.columns)]
    own = [column(c) for c in shared]
    return real.select(F.lit("r").alias("src"), *own).unionByName(synth.select(F.lit("s").alias("src"), *own))


def long_values(pairs: list[tuple[str, Column]], df: DataFrame, kind: str, key: list[str] | None = None) -> DataFrame:
    """(key..., column, value) of the given columns without nulls; ``kind`` is double or string."""
    keep = ["src"] if key is None else key
    cells = F.array(*(F.struct(F.lit(name).alias("column"), c.cast(kind).alias("value")) for name, c in pairs))
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*").where("value is not null")


def counted(values: DataFrame, keys: tuple[str, ...] = ("column", "value")) -> DataFrame:
    """(column, value, nr, ns): how often each value is in the real and the synthetic table.

    The counts are persisted, in memory and then on disk; lost blocks are counted again.
    """
    return values.groupBy(*keys).agg(F.count_if(F.col("src") == "r").alias("nr"), F.count_if(F.col("src") == "s").alias("ns")).persist()


def constants(found: dict, kind: str) -> Column:
    """A dictionary by column name as a constant map."""
    return F.from_json(F.lit(json.dumps(found)), f"map<string,{kind}>")


def of_column(found: dict, kind: str = "double") -> Column:
    """The entry of the row's column."""
    return F.try_element_at(constants(found, kind), F.col("column"))


def summaries(counts: DataFrame, blocks: int = BLOCKS) -> dict[str, Row]:
    """One row for each numeric column: cuts between blocks, totals, the real mean, ranges and numbers of distinct values."""
    side = {x: F.when(F.col(f"n{x}") > 0, F.col("value")) for x in "rs"}
    ranges = [c for x, v in side.items() for c in (F.min(v).alias(f"{x}_lo"), F.max(v).alias(f"{x}_hi"), F.count(v).alias(f"{x}_unique"))]
    mean = (F.sum(F.col("nr") * F.col("value")) / F.sum("nr")).alias("mean")
    rows = counts.groupBy("column").agg(_cuts(blocks), F.sum("nr").alias("tr"), F.sum("ns").alias("ts"), F.count(F.lit(1)).alias("values"), mean, *ranges).collect()
    return {r["column"]: r for r in rows}


def _cuts(blocks: int) -> Column:
    return F.percentile_approx("value", [i / blocks for i in range(1, blocks)], 1000).alias("cuts")


def _place(cuts: Column) -> Column:
    """How many of the cuts are below the row's value; 0 without cuts."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col("value"))), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side if its known number of rows allows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _dealt(counts: DataFrame, known: dict[str, Row], blocks: int, most: int) -> DataFrame:
    """``counts`` with ``block``: numbers that ascend with the values of a column, at most ``most`` values each.

    The first cuts are those of ``known``; blocks of more values are cut again, as
    often as it takes. Cuts are kept as they came, for counted again after a lost
    executor they might differ: at most one row for every ``most`` values, and
    none but the first of columns of fewer than ``blocks`` times as many.
    """
    cuts = of_column({c: sorted(set(r["cuts"])) for c, r in known.items()}, "array<double>")
    dealt = counts.withColumn("block", _place(cuts).cast("long"))
    # Of up to this many values no first block is too large: a cut is off by 1/1000 of them at most.
    open_ = any(r["values"] > most * blocks * 0.9 for r in known.values())
    while open_:
        own = dealt.groupBy("column", "block").agg(_cuts(blocks), F.count(F.lit(1)).alias("values"), F.min("value").alias("low"), F.max("value").alias("high"))
        # The least value is a cut too: where one value stands very often it is apart from the others at last.
        crowded = own.where((F.col("values") > most) & (F.col("low") < F.col("high"))).select("column", "block", F.array_distinct(F.concat(F.array("low"), "cuts"))).collect()
        if not crowded:
            break
        finer = counts.sparkSession.createDataFrame(crowded, "column string, block long, cuts array<double>")
        again = dealt.join(small(finer, len(crowded)), ["column", "block"], "left")
        dealt = again.withColumn("block", F.col("block") * (blocks + 1) + _place(F.col("cuts"))).drop("cuts")
    return dealt


def cumulative(counts: DataFrame, blocks: int = BLOCKS, known: dict[str, Row] | None = None, keep: list[str] | None = None, most: int = BLOCK_VALUES) -> DataFrame:
    """``counts`` with cr, cs (values up to and with this one), tr, ts (totals), dx (to the next value) and the columns ``keep``.

    A block holds at most ``most`` values, so there are the more of them the more
    distinct values a column has, and no window grows with it.
    """
    known = summaries(counts, blocks) if known is None else known
    dealt = _dealt(counts, known, blocks, most)
    rows, ahead, last = [], {}, {}
    for r in sorted(dealt.groupBy("column", "block").agg(F.sum("nr").alias("br"), F.sum("ns").alias("bs"), F.min("value").alias("bx")).collect(), key=lambda r: (r["column"], r["block"])):
        c = r["column"]
        if c in last:
            rows[last[c]][-1] = r["bx"]
        at = ahead.get(c, (0, 0))
        last[c] = len(rows)
        rows.append([c, r["block"], known[c]["tr"], known[c]["ts"], *at, None])
        ahead[c] = (at[0] + r["br"], at[1] + r["bs"])
    starts = counts.sparkSession.createDataFrame([tuple(r) for r in rows], "column string, block long, tr long, ts long, r0 long, s0 long, next double")
    # Rows of one value stand in one block, in the order of what else is kept.
    upto = Window.partitionBy("column", "block").orderBy("value", *(keep or []))
    running = upto.rowsBetween(Window.unboundedPreceding, 0)
    after = F.coalesce(F.lead("value").over(upto), F.col("next"))
    return dealt.join(small(starts, len(rows)), ["column", "block"]).select("column", "value", "nr", "ns", *(keep or []), "tr", "ts", (F.sum("nr").over(running) + F.col("r0")).alias("cr"), (F.sum("ns").over(running) + F.col("s0")).alias("cs"), (after - F.col("value")).alias("dx"))


def _quantile(p: float) -> Column:
    """Linear interpolation between the real values of ranks around p."""
    h = (F.col("tr") - 1) * p
    low = F.floor(h)
    at = lambda k: F.max(F.when((F.col("cr") > k) & (F.col("cr") - F.col("nr") <= k), F.col("value")))
    a, b = at(low), at(F.least(low + 1, F.col("tr") - 1))
    return a + (b - a) * F.max(h - low)


def spread_of(q25: Column, q75: Column, std: Column, low: Column, high: Column) -> Column:
    """The first positive of interquartile range, standard deviation and range; else 1."""
    return F.when(low == high, F.lit(1.0)).when(q75 > q25, q75 - q25).when(std > 0, std).when(high > low, high - low).otherwise(F.lit(1.0))


def numeric_distances(counts: DataFrame, known: dict[str, Row] | None = None) -> DataFrame:
    """(column, distance, ks, spread, r_lo, r_hi, r_unique, s_lo, s_hi, s_unique) for columns with values on both sides."""
    known = summaries(counts) if known is None else known
    c = cumulative(counts, known=known)
    gap = F.abs(F.col("cr") / F.col("tr") - F.col("cs") / F.col("ts"))
    real, synth = F.col("nr") > 0, F.col("ns") > 0
    # About the mean: sums of squares lose the variance of large numbers close together.
    d = F.col("value") - of_column({k: r["mean"] for k, r in known.items() if r["mean"] is not None})
    var = F.sum(F.col("nr") * d * d) / (F.sum("nr") - 1)
    out = c.where("tr > 0 and ts > 0").groupBy("column").agg(
        F.sum(gap * F.coalesce("dx", F.lit(0.0))).alias("distance"), F.max(gap).alias("ks"), _quantile(0.25).alias("q25"), _quantile(0.75).alias("q75"),
        F.sqrt(F.when(F.sum("nr") > 1, var)).alias("std"),
        F.min(F.when(real, F.col("value"))).alias("r_lo"), F.max(F.when(real, F.col("value"))).alias("r_hi"), F.count_if(real).alias("r_unique"),
        F.min(F.when(synth, F.col("value"))).alias("s_lo"), F.max(F.when(synth, F.col("value"))).alias("s_hi"), F.count_if(synth).alias("s_unique"),
    )
    return out.withColumn("spread", spread_of(F.col("q25"), F.col("q75"), F.col("std"), F.col("r_lo"), F.col("r_hi")))


def peaks(histogram: Column) -> Column:
    """Strict local maxima of a list of counts: a plateau is one, edges never are, low ones (15 %) do not count; 1 at least."""
    top = F.array_max(histogram)
    start = F.struct(F.lit(None).cast("long").alias("prev"), F.lit(False).alias("rising"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        up, down = F.coalesce(c > s["prev"], F.lit(False)), F.coalesce(c < s["prev"], F.lit(False))
        peak = down & s["rising"] & (s["prev"] >= 0.15 * top)
        return F.struct(c.alias("prev"), (up | (s["rising"] & ~down)).alias("rising"), (s["n"] + peak.cast("int")).alias("n"))

    return F.greatest(F.lit(1), F.aggregate(histogram, start, step, lambda s: s["n"]))


def histograms(counts: DataFrame, known: dict[str, Row] | None = None, bins: int = 30) -> DataFrame:
    """(column, src, histogram): equal bins, as many as distinct values but at most ``bins``, the last one closed."""
    known = summaries(counts) if known is None else known
    figure = lambda name, x, kind: of_column({c: r[f"{x}_{name}"] for c, r in known.items()}, kind).alias(name)
    cell = lambda x: F.struct(F.lit(x).alias("src"), F.col(f"n{x}").alias("n"), figure("lo", x, "double"), figure("hi", x, "double"), F.least(figure("unique", x, "bigint"), F.lit(bins)).alias("nb"))
    each = counts.select("column", "value", F.explode(F.array(cell("r"), cell("s"))).alias("c")).where("c.n > 0")
    at = F.when(F.col("c.hi") > F.col("c.lo"), F.least(F.floor((F.col("value") - F.col("c.lo")) * F.col("c.nb") / (F.col("c.hi") - F.col("c.lo"))), F.col("c.nb") - 1)).otherwise(F.lit(0))
    binned = each.groupBy("column", F.col("c.src").alias("src"), F.col("c.nb").alias("nb"), at.cast("int").alias("bin")).agg(F.sum("c.n").alias("n"))
    full = binned.groupBy("column", "src", "nb").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return full.select("column", "src", F.transform(F.sequence(F.lit(0), F.col("nb").cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("histogram"))


def mode_counts(counts: DataFrame, known: dict[str, Row] | None = None) -> DataFrame:
    """(column, real_modes, synth_modes)."""
    h = histograms(counts, known).withColumn("modes", peaks(F.col("histogram")))
    return h.groupBy("column").agg(F.max(F.when(F.col("src") == "r", F.col("modes"))).alias("real_modes"), F.max(F.when(F.col("src") == "s", F.col("modes"))).alias("synth_modes"))


def total_variation(counts: DataFrame) -> DataFrame:
    """(column, distance): half the sum of absolute differences of shares."""
    rows = counts.groupBy("column").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts")).collect()
    both_there = {x: {r["column"]: r[x] for r in rows if r["tr"] and r["ts"]} for x in ("tr", "ts")}
    diff = F.abs(F.col("nr") / of_column(both_there["tr"], "bigint") - F.col("ns") / of_column(both_there["ts"], "bigint"))
    return counts.where(F.col("column").isin(list(both_there["tr"]))).groupBy("column").agg((0.5 * F.sum(diff)).alias("distance"))


def column_kinds(real: DataFrame, synth: DataFrame, meta: dict | None = None) -> dict[str, str]:
    """numeric, datetime or categorical for each shared column; ids are left out.

    A column is numeric if it is so on both sides; metadata decides on ids and dates.
    """
    sdtype = {c: m.get("sdtype") for c, m in ((meta or {}).get("columns") or {}).items()}
    out = {}
    for c in real.columns:
        if c not in synth.columns or sdtype.get(c) == "id":
            continue
        a, b = real.schema[c].dataType, synth.schema[c].dataType
        numeric = is_numeric(a) and is_numeric(b)
        out[c] = "datetime" if sdtype.get(c) == "datetime" or (is_time(a) and is_time(b)) else "numeric" if numeric else "categorical"
    return out


def value_frames(real: DataFrame, synth: DataFrame, kinds: dict[str, str], meta: dict | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Counts of numeric (and date) values, and of categories. Where types differ, values never match."""
    formats = {c: m.get("datetime_format") for c, m in ((meta or {}).get("columns") or {}).items()}
    # Dates that stand as text without a format: by a vote of the values of both tables.
    open_ = [c for c, k in kinds.items() if k == "datetime" and not formats.get(c) and not (is_time(real.schema[c].dataType) and is_time(synth.schema[c].dataType))]
    if open_:
        texts_of = lambda df: df.select(*(column(c).cast("string").alias(c) for c in open_))
        formats |= chosen(texts_of(real).unionByName(texts_of(synth)), open_)

    def number(df: DataFrame, c: str) -> Column:
        t = df.schema[c].dataType
        return micros(column(c), t, formats.get(c)) if kinds[c] == "datetime" else present(column(c).cast("double"), t)

    def text(df: DataFrame, c: str, src: str) -> Column:
        mark = "" if type(real.schema[c].dataType) is type(synth.schema[c].dataType) else f"{src}:"
        return F.concat(F.lit(mark), present(column(c), df.schema[c].dataType).cast("string"))

    null = {"number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}

    def cells(df: DataFrame, src: str) -> DataFrame:
        own = [(c, {"text": text(df, c, src)} if k == "categorical" else {"number": number(df, c).cast("double")}) for c, k in kinds.items()]
        every = F.array(*(F.struct(F.lit(c).alias("column"), *((v | {x: n for x, n in null.items() if x not in v})[x].alias(x) for x in null)) for c, v in own))
        return df.select(F.lit(src).alias("src"), F.explode(every).alias("cell")).select("src", "cell.*").where("number is not null or text is not null")

    if not kinds:
        return None, None
    counts = counted(cells(real, "r").unionByName(cells(synth, "s")), ("column", "number", "text"))
    some = {k == "categorical" for k in kinds.values()}
    numbers = counts.where("number is not null").select("column", F.col("number").alias("value"), "nr", "ns")
    texts = counts.where("text is not null").select("column", F.col("text").alias("value"), "nr", "ns")
    return numbers if False in some else None, texts if True in some else None


FINDINGS = "column string, dtype string, metric string, distance double, score double, ok boolean, real_modes int, synth_modes int, modal_warning string"


def evaluate(real: DataFrame, synth: DataFrame, meta: dict | None = None) -> DataFrame:
    """One row for each comparable column: distance, score and verdict.

    Categories are compared by total variation, numbers and dates by the
    Wasserstein distance over the spread of the real column. Distances of dates
    are in days. Columns without values on one side give no row.
    """
    kinds = column_kinds(real, synth, meta)
    numbers, texts = value_frames(real, synth, kinds, meta)
    out = real.sparkSession.createDataFrame([], FINDINGS)
    if numbers is not None:
        known = summaries(numbers)
        stats = numeric_distances(numbers, known)
        dates = [c for c, k in kinds.items() if k == "datetime"]
        modes = mode_counts(numbers.where(~F.col("column").isin(dates)) if dates else numbers, known) if len(dates) < len([k for k in kinds.values() if k != "categorical"]) else None
        found = stats.join(F.broadcast(modes), "column", "left") if modes is not None else stats.withColumns({"real_modes": F.lit(None).cast("int"), "synth_modes": F.lit(None).cast("int")})
        score, date = F.col("distance") / F.col("spread"), F.col("column").isin(dates)
        lost = (F.col("real_modes") >= 2) & (F.col("synth_modes") < F.col("real_modes"))
        warning = F.when(lost, F.concat(F.col("real_modes").cast("string"), F.lit(" → "), F.col("synth_modes").cast("string")))
        out = out.unionByName(found.select("column", F.when(date, "datetime").otherwise("numeric").alias("dtype"), F.lit("wasserstein").alias("metric"), F.round(F.col("distance") / F.when(date, F.lit(DAY)).otherwise(1), 4).alias("distance"), F.round(score, 4).alias("score"), (score < SCORE_OK).alias("ok"), F.col("real_modes").cast("int").alias("real_modes"), F.col("synth_modes").cast("int").alias("synth_modes"), warning.alias("modal_warning")))
    if texts is not None:
        d = F.col("distance")
        out = out.unionByName(total_variation(texts).select("column", F.lit("categorical").alias("dtype"), F.lit("tv").alias("metric"), F.round(d, 4).alias("distance"), F.round(d, 4).alias("score"), (d < SCORE_OK).alias("ok"), F.lit(None).cast("int").alias("real_modes"), F.lit(None).cast("int").alias("synth_modes"), F.lit(None).cast("string").alias("modal_warning")))
    return out


def correlations(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, rc, sc) of all column pairs in both tables, over rows where both are present; null if one is constant."""
    number = lambda df, src: df.select(F.lit(src).alias("src"), *(present(column(c).cast("double"), T.DoubleType()).alias(c) for c in columns))
    rows = number(real, "r").unionByName(number(synth, "s"))
    cells = []
    for a, b in combinations(columns, 2):
        r = []
        for src in "rs":
            there = (F.col("src") == src) & column(a).isNotNull() & column(b).isNotNull()
            x, y = F.when(there, column(a)), F.when(there, column(b))
            sx, sy = F.stddev_samp(x), F.stddev_samp(y)
            r.append(F.when((sx > 0) & (sy > 0), F.covar_samp(x, y) / (sx * sy)).alias(f"{src}c"))
        cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), *r))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def pair_severity(real_corr: Column, synth_corr: Column, delta: Column) -> Column:
    """hoog: a sign turned on a correlation of 0.4 or more, or a change above 0.5; matig: a real correlation of 0.2 or more."""
    turned = (real_corr * synth_corr < 0) & (F.abs(real_corr) >= 0.4)
    return F.when(turned | (delta > 0.5), "hoog").when(F.abs(real_corr) >= 0.2, "matig").otherwise("laag")


def evaluate_pairs(real: DataFrame, synth: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs whose correlation differs by more than 0.1, with severity, the largest change first; none with fewer than two numeric columns."""
    names = columns or [c for c, k in column_kinds(real, synth).items() if k == "numeric"]
    if len(names) < 2:
        return real.sparkSession.createDataFrame([], "col_a string, col_b string, real_corr double, synth_corr double, delta double, severity string")
    out = correlations(real, synth, names).where(F.abs(F.col("rc") - F.col("sc")) > DELTA)
    out = out.select("col_a", "col_b", F.round("rc", 3).alias("real_corr"), F.round("sc", 3).alias("synth_corr"), F.round(F.abs(F.col("rc") - F.col("sc")), 3).alias("delta"))
    return out.withColumn("severity", pair_severity(F.col("real_corr"), F.col("synth_corr"), F.col("delta"))).orderBy(F.desc("delta"), "col_a", "col_b")


def correlation_risk(pairs: DataFrame) -> DataFrame:
    """The highest severity of all pairs; laag without one."""
    rank = F.max(F.when(F.col("severity") == "hoog", 2).when(F.col("severity") == "matig", 1).otherwise(0))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.when(rank == 2, "hoog").when(rank == 1, "matig").otherwise("laag").alias("risk"))


def column_shapes(real: DataFrame, synth: DataFrame, meta: dict | None = None) -> DataFrame:
    """(column, metric, score): KS complement of numbers and dates, TV complement of categories."""
    numbers, texts = value_frames(real, synth, column_kinds(real, synth, meta), meta)
    parts = []
    if numbers is not None:
        parts.append(numeric_distances(numbers).select("column", F.lit("KSComplement").alias("metric"), (1 - F.col("ks")).alias("score")))
    if texts is not None:
        parts.append(total_variation(texts).select("column", F.lit("TVComplement").alias("metric"), (1 - F.col("distance")).alias("score")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def correlation_similarity(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, score): 1 less half the difference of the correlations."""
    return correlations(real, synth, columns).where("rc is not null and sc is not null").select("col_a", "col_b", (1 - F.abs(F.col("rc") - F.col("sc")) / 2).alias("score"))


def contingency_similarity(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, score): 1 less the total variation of the joint categories."""
    names = list(combinations(columns, 2))
    joint = [(f"{a}\x1f{b}", F.to_json(F.array(column(a).cast("string"), column(b).cast("string")))) for a, b in names]
    parts = [long_values(joint, df.withColumn("src", F.lit(src)), "string") for src, df in (("r", real), ("s", synth))]
    tv = total_variation(counted(parts[0].unionByName(parts[1])))
    at = F.split("column", "\x1f")
    return tv.select(at[0].alias("col_a"), at[1].alias("col_b"), (1 - F.col("distance")).alias("score"))


def in_bins(real: DataFrame, synth: DataFrame, columns: list[str], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both tables with numbers as equal bins of the real range; what lies outside is in the first or last bin."""
    one = real.agg(*(f(column(c).cast("double")).alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("lo", F.min), ("hi", F.max)))).first()

    def cut(c: str, i: int) -> Column:
        low, high = one[f"lo{i}"], one[f"hi{i}"]
        if low is None or high <= low:
            return F.when(column(c).isNotNull(), F.lit("0"))
        return F.least(F.greatest(F.floor((column(c).cast("double") - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("string")

    return tuple(df.withColumns({c: cut(c, i) for i, c in enumerate(columns)}) for df in (real, synth))


def mixed_similarity(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(col_a, col_b, score): 1 less the total variation of a binned number and a category."""
    r, s = in_bins(real, synth, numeric)
    return contingency_similarity(r, s, [*numeric, *categorical]).where(F.col("col_a").isin(numeric) & F.col("col_b").isin(categorical))


def quality(real: DataFrame, synth: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None, meta: dict | None = None, mixed: bool = False) -> DataFrame:
    """(property, score): column shapes, column pair trends and their mean. ``mixed`` adds pairs of a number and a category."""
    if numeric is None and categorical is None:
        kinds = column_kinds(real, synth, meta)
        numeric, categorical = ([c for c, k in kinds.items() if k == want] for want in ("numeric", "categorical"))
    numeric, categorical = numeric or [], categorical or []
    shapes = column_shapes(real, synth, meta).select(F.lit("Column Shapes").alias("property"), "score")
    found = ([correlation_similarity(real, synth, numeric)] if len(numeric) > 1 else []) + ([contingency_similarity(real, synth, categorical)] if len(categorical) > 1 else []) + ([mixed_similarity(real, synth, numeric, categorical)] if mixed and numeric and categorical else [])
    for t in found:
        shapes = shapes.unionByName(t.select(F.lit("Column Pair Trends").alias("property"), "score"))
    own = shapes.groupBy("property").agg(F.avg("score").alias("score"))
    return own.unionByName(own.agg(F.lit("Overall").alias("property"), F.avg("score").alias("score")))
