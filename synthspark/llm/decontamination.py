"""Benchmark decontamination by winnowing.

Texts are words of digits, lower-case ASCII letters and everything beyond ASCII.
Of each window of ``WINDOW`` consecutive ``GRAM``-word grams the one of the least
hash is a fingerprint (the last one on ties). Two texts that share
``GRAM + WINDOW - 1`` words (10) share the fingerprint of that span. Fingerprints
of documents and items are joined and each hit is extended word by word, as far
as the next fingerprint can be; a hit counts from 10 words on. Items below 10
words are one window each and are looked for at every position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark are broadcast up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_between(text: Column, separators: str) -> Column:
    """What stands between separators; only the first and last piece of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.transform(F.array(parts), lambda p: F.slice(p, F.when(p[0] == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(p) - (p[0] == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int"))))[0]


def row_key(id_col: str, text_col: str) -> Column:
    """What tells a document: its id and a hash of its text, so that rows of one id stand for themselves."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))


def hashed_words(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    """(__id, __h): a key and a hash of each word, in order."""
    cut = docs.select(key.alias("__id"), words_between(ascii_lower(F.col(text_col)), _SEPARATORS).alias("__w"))
    return cut.select("__id", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))


def _grams(h: Column) -> Column:
    at = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(GRAM)))
    return F.when(F.size(h) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), at)).otherwise(F.array().cast("array<long>"))


def _is_minimum(g: Column, p: Column) -> Column:
    """Whether gram ``p`` is the least of a window of ``WINDOW`` grams that holds it."""
    own = F.get(g, p)

    def run(step: int) -> Column:
        n = F.lit(WINDOW - 1)
        for k in range(WINDOW - 1, 0, -1):
            other = F.get(g, p + step * k)
            beaten = (own <= other) if step < 0 else (own < other)
            n = F.when(~F.coalesce(beaten, F.lit(False)), k - 1).otherwise(n)
        return n

    return run(-1) + run(1) >= WINDOW - 1


def _around(h: Column, p: Column) -> list[Column]:
    """The words before and after the gram at ``p``: as many as the next fingerprint can be away."""
    before = [F.get(h, p - k).alias(f"l{k}") for k in range(1, WINDOW)]
    return before + [F.get(h, p + (GRAM - 1 + k)).alias(f"r{k}") for k in range(1, WINDOW)]


def fingerprints(hashed: DataFrame) -> DataFrame:
    """(__id, __h, __p, __g): each text's fingerprints with their positions.

    The outer form of posexplode keeps Spark from computing the grams once more
    in a filter on their number.
    """
    grams = hashed.select("__id", "__h", _grams(F.col("__h")).alias("__gs"))
    each = grams.select("__id", "__h", "__gs", F.posexplode_outer("__gs").alias("__p", "__g"))
    return each.where(_is_minimum(F.col("__gs"), F.col("__p"))).select("__id", "__h", "__p", "__g")


def _run(side: str) -> Column:
    n = F.lit(WINDOW - 1)
    for k in range(WINDOW - 1, 0, -1):
        n = F.when(~F.coalesce(F.col(f"{side}{k}") == F.col(f"i_{side}{k}"), F.lit(False)), k - 1).otherwise(n)
    return n


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(__id, __item, __from, __to): word spans of documents that an item's windows cover, end exclusive."""
    d, b = hashed_words(docs, row_key(id_col, text_col), text_col), written(hashed_words(items, F.col(item_col), item_text), "bench-words")
    i = fingerprints(b)
    keys = written(i.select("__g", F.col("__id").alias("__item"), *(c.alias(f"i_{n}") for c, n in zip(_around(F.col("__h"), F.col("__p")), [f"{s}{k}" for s in "lr" for k in range(1, WINDOW)], strict=True))).distinct(), "bench-keys")
    own = fingerprints(d)
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    else:  # hashes alone meet first; only documents with a hit come again, with their words
        met = own.select("__id", "__p", "__g").join(keys.select("__g").distinct(), "__g", "left_semi")
        own = d.join(met.groupBy("__id").agg(F.collect_list(F.struct("__p", "__g")).alias("__hits")), "__id").select("__id", "__h", F.inline("__hits"))
    found = own.select("__id", "__p", "__g", *_around(F.col("__h"), F.col("__p"))).join(keys, "__g")
    spans = found.select("__id", "__item", "__p", _run("l").alias("l"), _run("r").alias("r")).where(F.col("l") + F.col("r") + GRAM >= SPAN)
    out = spans.select("__id", "__item", (F.col("__p") - F.col("l")).alias("__from"), (F.col("__p") + GRAM + F.col("r")).alias("__to"))
    short = b.where(F.size("__h").between(1, SPAN - 1))
    return out if short.isEmpty() else out.unionByName(_short_hits(d, short))


def _short_hits(d: DataFrame, short: DataFrame) -> DataFrame:
    """Occurrences of whole items below 10 words: a hash of all words is looked for, at each length that an item has.

    A frequent word that items begin with is no key of its own.
    """
    items = short.select(F.xxhash64("__h").alias("__g"), F.size("__h").alias("__n"), F.col("__id").alias("__item"))
    lengths = [r[0] for r in items.select("__n").distinct().orderBy("__n").collect()]  # nine at most

    def runs_of(n: int) -> Column:
        one = lambda p: F.struct(F.xxhash64(F.slice("__h", p + 1, n)).alias("__g"), F.lit(n).alias("__n"), p.alias("__p"))
        return F.when(F.size("__h") >= n, F.transform(F.sequence(F.lit(0), F.size("__h") - n), one)).otherwise(F.array().cast("array<struct<__g:bigint,__n:int,__p:int>>"))

    runs = F.flatten(F.array(*(runs_of(n) for n in lengths)))
    return d.select("__id", F.inline(runs)).join(items, ["__g", "__n"]).select("__id", "__item", F.col("__p").alias("__from"), (F.col("__p") + F.col("__n")).alias("__to"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each contaminated document: ``__id``, ``n_hit``, ``item_ids``, ``spans``.

    ``__id`` is the ``row_key``: rows that share an id (or have none) but not the
    text have results of their own, repeated rows have one. ``spans`` are the hit
    word ranges, merged and in order; ``item_ids`` are sorted as strings, without
    a null one; items of one id are one item. Documents and items without words
    (null, empty, or without a word character) hit nothing; empty tables give an
    empty result. Texts are read whole; other columns are not read.
    """
    found = hits(docs, items, id_col, text_col, item_col, item_text)
    per_doc = found.groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("__from", "__to"))).alias("raw"), F.array_sort(F.collect_set(F.col("__item").cast("string"))).alias("item_ids"))
    empty = F.array().cast("array<struct<__from:int,__to:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["__from"].alias("__from"), F.greatest(last["__to"], s["__to"]).alias("__to"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["__to"] >= s["__from"]), joined).otherwise(F.concat(done, F.array(s)))

    merged = per_doc.select("__id", "item_ids", F.aggregate("raw", empty, add).alias("spans"))
    return merged.select("__id", F.aggregate("spans", F.lit(0), lambda n, s: n + s["__to"] - s["__from"]).cast("long").alias("n_hit"), "item_ids", "spans")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found."""
    found = contamination(docs, items, id_col, **columns).select(F.col("__id.id").alias("__hit_id"), F.col("__id.th").alias("__hit_th"))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(columns.get("text_col", "text")) == F.col("__hit_th")), "left_anti")


def op5_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Words, hit words and items of every document."""
    docs = docs.select("doc_id", "text")
    n = F.size(words_between(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    found = contamination(docs, items)
    none = F.sha2(F.lit(""), 256)
    own = docs.select("doc_id", n.alias("n_words"), F.xxhash64("text").alias("__th"))
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("__id.id")) & (F.col("__th") == F.col("__id.th")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.sha2(F.array_join("item_ids", ","), 256), none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


OP5_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select doc_id, item_id, i, n from dw join bw using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from h) group by 1),
it as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct doc_id, item_id::varchar as item from h) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
