"""Personal data by bootstrapped contextual extraction.

Base matches (e-mail, IP, card, phone) are the seeds. Every seed and every other
identifier-like span (an @, six digits in groups, a long mixed run) is an instance
of several patterns: the two and three tokens before it, the token before it with
its shape, and the tokens on both sides. Patterns and instances form a graph that
is scored in rounds: a pattern by the scores of its distinct instances, an
instance by the confident patterns it stands in. Confident instances are seeds of
the next round, until none is added. Nothing but a base match is a seed, so no span
confirms the pattern it is found by. What has a kind's form but fails its check is
known not to be of that kind, counts against its patterns and is never added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the kinds. The look-behinds and possessive repeats change no match: a
#: match can only begin where a run of its characters begins or the last match ended.
#: Cards are runs of 12 to 19 digits that are not part of a longer run.
REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"(?<!\S)[^\s@]++@[^\s@]++|(?<![A-Za-z0-9_+/-])(?=(?:[A-Za-z_+/-]*+[0-9]){6})(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+|(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){5,}+(?![A-Za-z0-9])",
}
#: A pattern needs so many distinct instances with a score, and so much confidence to add others.
SEEDS, CONFIDENT = 3, 0.7
_LEFT, _RIGHT = 64, 32
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: What tells a document: its id and a hash of its text, so that rows of one id stand for themselves.
ROW = ["id", "th"]


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
    small = F.forall(F.split(value, r"\."), lambda p: part(p) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return F.when(kind == "ip", small).when(kind == "card", _luhn(digits)).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, kind, from, to, value, left, right): valid base matches, and other identifier-like spans."""
    text = F.col("t")
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(digit | at)
    possible = {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")), "other": digit | at}
    none = F.array().cast("array<string>")
    both = {k: [F.when(possible[k], F.regexp_extract_all(text, F.lit(REGEX[k]), F.lit(0))).otherwise(none).alias(f"m_{k}"), F.when(possible[k], F.split(text, REGEX[k], -1)).otherwise(none).alias(f"s_{k}")] for k in REGEX}
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select(*ROW, "row", *(c for pair in both.values() for c in pair))

    def found(k: str) -> Column:
        after = F.slice(f"s_{k}", F.lit(2), F.size(f"m_{k}"))
        return F.transform(F.arrays_zip(F.col(f"m_{k}").alias("m"), F.col(f"s_{k}").alias("s"), after.alias("e")), lambda z, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(z["s"]).cast("long").alias("gap"), z["m"].alias("value"), F.right(z["s"], F.lit(_LEFT)).alias("left"), F.left(z["e"], F.lit(_RIGHT)).alias("right")))

    each = rows.select(*ROW, "row", F.inline(F.concat(*(found(k) for k in REGEX)))).where("value is not null")
    order = Window.partitionBy("row", "kind").orderBy("i")
    before = F.coalesce(F.sum(F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("from", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + before).where(_valid(F.col("kind"), F.col("value")))
    return placed.select(*ROW, "kind", "from", (F.col("from") + F.length("value")).alias("to"), "value", "left", F.coalesce("right", F.lit("")).alias("right"))


def _uncovered(found: DataFrame) -> DataFrame:
    """Spans that overlap no base match."""
    base = F.col("kind") != "other"
    order = Window.partitionBy(*ROW).orderBy("from", "to")
    left = F.max(F.when(base, F.col("to"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("from"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return found.select("*", left.alias("l"), right.alias("r")).where("kind = 'other' and coalesce(l <= `from`, true) and coalesce(r >= `to`, true)").drop("l", "r")


def _patterns(rows: DataFrame) -> DataFrame:
    """``rows`` with ``patterns``: the contexts of a span, digits as 0, in lower case."""
    tokens = lambda c: F.regexp_extract_all(F.regexp_replace(F.lower(c), "[0-9]", "0"), F.lit(_TOKEN), F.lit(0))
    mixed = r"[A-Za-z0-9]*(?:[A-Za-z][0-9]|[0-9][A-Za-z])[A-Za-z0-9]*"
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", mixed, "x"), "[0-9]+", "9"), r"\p{L}{2,}", "a")
    told = rows.withColumns({"before": tokens("left"), "after": tokens("right")})
    last = lambda n: F.when(F.size("before") >= n, F.array_join(F.slice("before", -n, n), " "))
    all_ = F.array(F.concat(F.lit("2 "), last(2)), F.concat(F.lit("3 "), last(3)), F.concat(F.lit("s "), last(1), F.lit(" "), shape), F.concat(F.lit("b "), last(1), F.lit(" _ "), F.get("after", F.lit(0))))
    return told.withColumn("patterns", F.array_compact(all_)).drop("before", "after")


def _refused(value: Column, kind: Column) -> Column:
    """Whether a span has the form of a kind but is none of its base matches."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    whole = lambda r: value.rlike(f"^(?:{r})$")
    return F.when(kind == "card", whole(r"[0-9](?:[\x20-]?[0-9])+") & (digits >= 12)).when(kind == "ip", whole(r"[0-9]+(?:\.[0-9]+){3,}")).when(kind == "phone", whole(r"\+[0-9][\x20().0-9-]+[0-9]")).otherwise(F.lit(False))


def bootstrap(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, patterns): (kind, v, score, round) and (pattern, kind, confidence) of rows (kind, value, patterns).

    ``v`` is a hash of the value in lower case, ``round`` the one in which it
    became confident, 0 for seeds. Confidence is the sum of the scores of a
    pattern's distinct instances over their number and one; the score of an
    instance is the chance that not all its confident patterns are wrong. Scores
    never fall, so the rounds end. Ties go to the kind that comes first.
    """
    own = found.select("kind", F.xxhash64(F.lower("value")).alias("v"), "value", F.explode("patterns").alias("pattern"))
    nodes = own.groupBy("pattern", "v").agg(F.max(F.when(F.col("kind") != "other", F.col("kind"))).alias("kind"), F.min("value").alias("value"))
    nodes = written(nodes, "pii-edges")
    size = nodes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEDS)
    edges = written(nodes.join(size, "pattern"), "pii-graph")
    scores = written(nodes.where("kind is not null").select("kind", "v", F.lit(1.0).alias("score"), F.lit(0).alias("round")).distinct(), "pii-scores")
    sure, round_ = -1, 0
    while True:
        known = edges.select("pattern", "v", "n").join(scores, "v")
        patterns = known.groupBy("pattern", "kind").agg((F.round(F.sum("score") / (F.max("n") + 1), 9)).alias("confidence"), F.count(F.lit(1)).alias("k"))
        patterns = written(patterns.where((F.col("k") >= SEEDS) & (F.col("confidence") >= CONFIDENT)).drop("k"), "pii-patterns")
        now = scores.where(F.col("score") >= CONFIDENT).count()
        if now == sure:
            return scores, patterns
        sure, round_ = now, round_ + 1
        reached = edges.select("pattern", "v", "value", F.col("kind").alias("own")).join(patterns, "pattern").where("own is null or own = kind").where(~_refused(F.col("value"), F.col("kind")) | F.col("own").isNotNull())
        new = reached.groupBy("kind", "v").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))), 9).alias("score"), F.lit(round_).alias("round"))
        scores = written(scores.unionByName(new).groupBy("kind", "v").agg(F.max("score").alias("score"), F.min("round").alias("round")), "pii-scores")


def discovered(found: DataFrame) -> DataFrame:
    """(id, th, kind, from, to, round): spans beside the base matches that confident patterns reach."""
    free = _patterns(_uncovered(found))
    seeds = _patterns(found.where("kind <> 'other'"))
    rows = written(free.unionByName(seeds).where("size(patterns) > 0").drop("left", "right"), "pii-contexts")
    scores, patterns = bootstrap(rows.select("kind", "value", "patterns"))
    place = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    best = scores.where(F.col("score") >= CONFIDENT).groupBy("v").agg(F.max_by(F.struct("kind", "round"), F.struct("score", -place)).alias("best"))
    # An instance is added where a confident pattern of its kind stands around it.
    spans = rows.where("kind = 'other'").select(*ROW, "from", "to", F.xxhash64(F.lower("value")).alias("v"), F.explode("patterns").alias("pattern"))
    return spans.join(best, "v").join(patterns.select("pattern", F.col("kind").alias("of")), "pattern").where("of = best.kind").select(*ROW, "best.kind", "from", "to", "best.round").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, base, all): the base spans and all spans of each document that has one.

    Spans are (from, rank, to, kind) in code points, end exclusive, sorted by
    start and then by kind as listed. ``th`` is the 64-bit xxHash of the text: rows
    are told by id and text, so rows that share an id (or have none) but not the
    text have results of their own, and repeated rows have one. Null and empty
    texts and empty tables have none. Long texts are read whole; the tokens of a
    pattern are looked for in the 64 characters before a span and the 32 after it.
    Where two kinds score alike the one listed first is taken. Other columns of
    ``docs`` are not read.
    """
    found = written(matches(docs, id_col, text_col), "pii-matches")
    base = found.where("kind <> 'other'").select(*ROW, "kind", "from", "to", F.lit(True).alias("is_base"))
    spans = base.unionByName(discovered(found).drop("round").withColumn("is_base", F.lit(False))).distinct()
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    span = F.struct("from", rank.alias("rank"), "to", "kind")
    return spans.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("all"))


def _same_row(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> Column:
    return docs[id_col].eqNullSafe(spans["__span_id"]) & (F.xxhash64(docs[text_col]) == spans["__th"])


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Where spans overlap, the one that begins first is replaced and the others go with it.
    """
    spans = personal_data(docs, id_col, text_col).select(F.col("id").alias("__span_id"), F.col("th").alias("__th"), F.col("all").alias("__all"))
    text = F.col(text_col)

    def add(a: Column, s: Column) -> Column:
        covered = s["from"] < a["at"]
        piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["from"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(covered, F.greatest(a["at"], s["to"])).otherwise(s["to"]).alias("at"), F.when(covered, a["done"]).otherwise(F.concat(a["done"], piece)).alias("done"))

    rest = F.aggregate(F.coalesce("__all", F.array().cast("array<struct<from:bigint,rank:bigint,to:bigint,kind:string>>")), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")), add, lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return docs.join(spans, _same_row(docs, spans, id_col, text_col), "left").withColumn(text_col, F.when(F.col("__all").isNull(), text).otherwise(rest)).drop("__span_id", "__th", "__all")


def op10_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    own = docs.select("doc_id", "text")
    spans = personal_data(own).withColumnsRenamed({"id": "__span_id", "th": "__th"})
    out = own.join(spans, _same_row(own, spans, "doc_id", "text"), "left")
    told = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ","), F.lit(""))
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("all").alias("spans"))
