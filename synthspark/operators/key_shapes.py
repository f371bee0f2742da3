"""Fresh keys of the shape of known ones: a template of positions, and a counter that skips known keys.

The template is learnt by one aggregate over all positions of the most frequent
length: a character that is always the same is fixed, at other positions stand the
classes seen there (digits, capital and small letters) or, where there are others,
the characters themselves. Read as digits of mixed radix, the positions number all
strings of the template from 0, one to one, the last position the fastest. Free
numbers are dealt in order: the r-th free number is r and as many as known numbers
lie before it, found by buckets of numbers with the sums of earlier buckets added.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of characters, in their order as digits.
CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Positions that a template may have, and characters of no class that a position may have.
MOST_POSITIONS, MOST_OTHERS = 64, 100
#: Numbers in a bucket.
BUCKET = 100_000


@dataclass(frozen=True)
class Template:
    """The characters of each position, and the length of what they make."""

    alphabets: tuple[str, ...]

    @property
    def size(self) -> int:
        return prod(len(a) for a in self.alphabets)

    def _radices(self) -> list[tuple[int, str, int]]:
        """(position, characters, value of one there) of the positions that are not fixed."""
        out, value = [], 1
        for i in range(len(self.alphabets) - 1, -1, -1):
            if len(self.alphabets[i]) > 1:
                out.append((i, self.alphabets[i], value))
                value *= len(self.alphabets[i])
        return out

    def text(self, number: Column) -> Column:
        """The string of a number."""
        cells: list[Column] = [F.lit(a) for a in self.alphabets]
        for i, a, value in self._radices():
            cells[i] = F.substring(F.lit(a), ((_div(number, value) % len(a)) + 1).cast("int"), F.lit(1))
        return F.concat(*cells)

    def number(self, text: Column) -> Column:
        """The number of a string; null if it is not of the template."""
        fits = F.length(text) == len(self.alphabets)
        total = F.lit(0).cast("long")
        places = {i: (a, value) for i, a, value in self._radices()}
        for i, a in enumerate(self.alphabets):
            at = F.position(F.substring(text, i + 1, 1), F.lit(a))
            fits = fits & (at > 0)
            if i in places:
                total = total + (at - 1).cast("long") * F.lit(places[i][1])
        return F.when(fits, total)


def _div(number: Column, value: int) -> Column:
    """Whole division, exact for all 64-bit numbers."""
    return (number - number % value) / F.lit(value) if value == 1 else F.call_function("div", number, F.lit(value).cast("long"))


def learn(df: DataFrame, column: str) -> Template | None:
    """The template of the most frequent length of a text column; None if its keys are empty, too long or too varied for 64-bit numbers."""
    c = F.col(f"`{column}`")
    texts = df.where(c.isNotNull()).select(c.alias("k"))
    lengths = texts.groupBy(F.length("k").alias("n")).agg(F.count(F.lit(1)).alias("m"))
    first = lengths.orderBy(F.desc("m"), F.desc("n")).first()
    if first is None or not 0 < first["n"] <= MOST_POSITIONS:
        return None
    n = first["n"]
    at = [F.substring("k", i + 1, 1) for i in range(n)]
    seen = []
    for i, x in enumerate(at):
        of_class = F.lit(False)
        for k, chars in enumerate(CLASSES):
            inside = x.between(chars[0], chars[-1])
            of_class = of_class | inside
            seen.append(F.max(inside).alias(f"c{i}_{k}"))
        other = F.when(~of_class, x)
        seen += [F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), F.approx_count_distinct(other).alias(f"n{i}")]
    one = texts.where(F.length("k") == n).agg(*seen).first()
    if any(one[f"n{i}"] > MOST_OTHERS for i in range(n)):
        return None
    mixed = [i for i in range(n) if one[f"low{i}"] != one[f"high{i}"] and one[f"n{i}"]]
    others: dict[int, list[str]] = {}
    if mixed:
        plain = lambda x: ~(x.rlike("^[0-9A-Za-z]$"))
        found = texts.where(F.length("k") == n).agg(*(F.collect_set(F.when(plain(at[i]), at[i])).alias(f"o{i}") for i in mixed)).first()
        others = {i: sorted(found[f"o{i}"]) for i in mixed}
    alphabets = []
    for i in range(n):
        if one[f"low{i}"] == one[f"high{i}"]:
            alphabets.append(one[f"low{i}"])
        else:
            alphabets.append("".join(chars for k, chars in enumerate(CLASSES) if one[f"c{i}_{k}"]) + "".join(others.get(i, [])))
    template = Template(tuple(alphabets))
    while template.size >= 1 << 62:
        # Beyond 64-bit numbers the first free position stays at its first character.
        i = next(k for k, a in enumerate(alphabets) if len(a) > 1)
        alphabets[i] = alphabets[i][0]
        template = Template(tuple(alphabets))
    return template


def free_numbers(numbers: DataFrame, known: DataFrame) -> DataFrame:
    """(row, number): each of the rows 0, 1, 2, ... of ``numbers`` (row) with its own number that is none of ``known`` (number).

    Of the sorted known numbers the i-th has ``number - i`` free ones before it; the
    r-th free number is r plus the known ones with at most r before them.
    """
    by_number = _ranked(known.where("number is not null").select("number").distinct(), "number")
    jumps = by_number.groupBy((F.col("number") - F.col("rank")).alias("row")).agg((F.max("rank") + 1).alias("skip"))
    events = numbers.select("row", F.lit(None).cast("long").alias("skip"), F.lit(True).alias("real")).unionByName(jumps.withColumn("real", F.lit(False)))
    events = events.withColumn("bucket", F.floor(F.col("row") / BUCKET).cast("long"))
    carry = jumps.groupBy(F.floor(F.col("row") / BUCKET).cast("long").alias("bucket")).agg(F.max("skip").alias("most"))
    buckets = events.select("bucket").distinct().join(carry, "bucket", "left")
    buckets = _carried(buckets)
    within = Window.partitionBy("bucket").orderBy("row", F.col("real").asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("own", F.max("skip").over(within)).where("real").join(buckets, "bucket")
    return out.select("row", (F.col("row") + F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("before", F.lit(0)))).alias("number"))


def _carried(buckets: DataFrame) -> DataFrame:
    """(bucket, before): the greatest ``most`` of earlier buckets, by buckets of buckets."""
    wide = buckets.withColumn("group", F.floor(F.col("bucket") / 1000))
    groups = wide.groupBy("group").agg(F.max("most").alias("group_most"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    # One row for a hundred million numbers.
    groups = groups.select("group", F.max("group_most").over(earlier).alias("group_before"))
    own = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return wide.withColumn("here", F.max("most").over(own)).join(groups, "group").select("bucket", F.greatest("here", "group_before").alias("before"))


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of distinct whole numbers, by buckets of close numbers."""
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if not bounds["n"]:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    parts = max(1, bounds["n"] // BUCKET)
    cuts = rows.stat.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda x: x < F.col(column))) if cuts else F.lit(0)
    own = rows.withColumn("part", bucket)
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return own.withColumn("at", rank).join(before, "part").select(column, (F.col("at") + F.col("ahead")).alias("rank"))


def widened(template: Template) -> Template:
    """The template with its last free position once more; digits where all are fixed."""
    last = next((a for a in reversed(template.alphabets) if len(a) > 1), CLASSES[0])
    return Template((*template.alphabets, last))


def fresh_keys(rows: DataFrame, template: Template, known: DataFrame, n: int) -> DataFrame:
    """(row, key): a key of the template for each of ``n`` rows 0 to n - 1, none of the column ``key`` of ``known``.

    A template with too few strings left gets further positions.
    """
    while True:
        numbers = known.select(template.number(F.col("key")).alias("number"))
        taken = numbers.where("number is not null").distinct().count()
        if template.size - taken >= n:
            break
        template = widened(template)
    free = free_numbers(rows.select("row"), numbers)
    return free.select("row", template.text(F.col("number")).alias("key"))
