"""Line dedup by winnowing over line hashes.

Lines with a word, in order, are the sequence of a document. Of every window of
``RUN`` lines the least line hash is its fingerprint, the first of equal ones; about
half of the lines are one, and places that share ``RUN`` lines share a fingerprint
at the same place among them. Fingerprints of one line are joined. Each is extended
both ways over all the windows that it stands for, ``RUN`` to ``2 RUN - 1`` lines:
where an earlier place has the same lines all along, the whole extension is a
match. Where the fingerprint is shared but not all of these lines, it is extended
window by window, by as many lines to the left as the run leaves to the right, and
compared with those of the first places of the other extensions. Matches that
overlap make up whole runs, whichever earlier documents they are from. Later runs
of ``RUN`` lines or more are deleted, shorter ones never.

Extensions are compared by a hash of their raw lines beside the fingerprint, 124
bits in all. No step brings the holders of a line together: the first place of each
extension is an aggregate with partial results, written and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, with_lists, written

RUN = 3


def _number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def worded(lines: Column) -> Column:
    """Numbers, from 0, of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, first, n, line, span, windows): the windows from ``first`` on, n of them, whose fingerprint is one line; hashes of their lines, together and each."""
    lines = F.filter(F.split(F.coalesce(column(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    seq = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("th"), lines.alias("x"), F.transform(lines, _number).alias("h")).where(F.size("h") >= RUN)
    least = lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(RUN - 1)), lambda k: F.struct(F.get("h", i + k).alias("h"), (i + k).alias("p"))))
    seq = seq.withColumn("m", F.transform(F.sequence(F.lit(0), F.size("h") - RUN), least))
    place = lambda i: F.get("m", i)["p"]
    same = lambda i, k: F.coalesce(place(i + k) == place(i), F.lit(False))
    # A line is the least of RUN windows in a row at most.
    count = lambda i: sum((same(i, k).cast("int") for k in range(1, RUN)), F.lit(1))
    text = lambda first, n: F.xxhash64(F.array_join(F.slice("x", first + 1, n), "\n"))
    new = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: (i == 0) | (place(i - 1) != place(i)))
    each = seq.select("id", "th", "h", "x", "m", F.explode(new).alias("first")).withColumn("n", count(F.col("first")))
    own = each.select("id", "th", "first", "n", F.get("m", F.col("first"))["h"].alias("line"), text(F.col("first"), F.col("n") + (RUN - 1)).alias("span"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: text(F.col("first") + j, F.lit(RUN))).alias("windows"))
    return own


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``later``: whether an earlier place (id, th, first) has the same key."""
    least = written(rows.groupBy(*keys).agg(F.min(F.struct("id", "th", "first")).alias("least")), "line-places")
    return rows.join(least, keys).withColumn("later", F.struct("id", "th", "first") > F.col("least")).drop("least")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, removed): places, from 0 among lines with a word, of the lines to delete in each document that has any."""
    own = written(fingerprints(docs.where(column(id_col).isNotNull()), id_col, text_col), "fingerprints")
    held = own.groupBy("line").agg(F.count(F.lit(1)).alias("k"), (F.min("span") < F.max("span")).alias("mixed")).where("k > 1").select("line", "mixed")
    shared = written(own.join(written(held, "line-held"), "line"), "line-shared")
    spans = written(_later(shared, ["line", "span"]), "line-spans")
    edges = spans.where("mixed and not later").select("id", "th", "line", "first", F.posexplode("windows").alias("j", "window")).select("id", "th", "line", "window", (F.col("first") + F.col("j")).alias("first"))
    found = spans.where("later").select("id", "th", "first", (F.col("n") + (RUN - 1)).alias("lines"))
    found = found.unionByName(_later(written(edges, "line-edges"), ["line", "window"]).where("later").select("id", "th", "first", F.lit(RUN).alias("lines")))
    lines = found.select("id", "th", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("lines") - 1)).alias("at")).distinct()
    return lines.groupBy("id", "th").agg(F.array_sort(F.collect_list("at")).alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs of lines deleted, then ``__n_lines`` and ``__removed``, the deleted line numbers.

    Lines without a word are kept and stand in no run. Null texts stay null and
    count as one empty line; a text whose lines all go becomes empty. Documents
    stand in order of id; rows of one id are told by a hash of their text and stand
    in its order, equal rows are one document and do not repeat each other. Rows
    with a null id are kept whole. Texts of any length are read whole. An empty
    table gives an empty result; other columns pass through, whatever their names, but
    for two of the names of the result, which are replaced.
    """
    lists = written(repeated_lines(docs, id_col, text_col), "repeated-lines")
    # The other columns of the documents travel as one, so no name of theirs meets one of these.
    others = [column(c) for c in docs.columns if c != text_col]
    own = docs.select((F.struct(*others) if others else F.lit(None)).alias("row"), F.xxhash64(column(text_col)).alias("th"), column(id_col).alias("id"), column(text_col).alias("text"))
    hit, rest = with_lists(own, lists, ["id", "th"])
    cut = hit.withColumn("lines", F.split("text", "\n")).withColumn("worded", worded(F.col("lines")))
    cut = cut.withColumn("gone", F.transform("removed", lambda i: F.get("worded", i)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    cut = cut.select("row", F.array_join(kept, "\n").alias("text"), F.size("lines").alias("n_lines"), "gone")
    whole = rest.select("row", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"), F.array().cast("array<int>").alias("gone"))
    out = cut.unionByName(whole)
    cells = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("__n_lines", "__removed")]
    return out.select(*cells, F.col("n_lines").alias("__n_lines"), F.col("gone").alias("__removed"))


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """Lines, deleted lines and a hash of what is kept of every document."""
    out = without_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: By brute force: all runs of three lines, whole, and whether an earlier place has the same.
OP4_SQL = r"""
with a as (select doc_id, generate_subscripts(s, 1) - 1 as ln, unnest(s) as x from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
t as (select doc_id, ln as l1, x as x1, lead(ln) over w as l2, lead(x) over w as x2, lead(ln, 2) over w as l3, lead(x, 2) over w as x3 from a where regexp_matches(x, '[^\x20\x09-\x0D]') window w as (partition by doc_id order by ln)),
k as (select *, row_number() over (partition by x1, x2, x3 order by doc_id, l1) as place from t where l3 is not null),
r as (select distinct doc_id, unnest([l1, l2, l3]) as ln from k where place > 1)
select a.doc_id, count(*)::bigint as n_lines, count(r.ln)::bigint as n_removed, sha256(coalesce(string_agg(x, chr(10) order by a.ln) filter (where r.ln is null), '')) as kept_sha256 from a left join r using (doc_id, ln) group by 1
"""
