"""Substring dedup over words: documents are joined on winnowed seeds, seeds are extended both ways, maximal repeats go.

Seeds: of every window of ``LENGTH`` words the least hash of its grams of ``GRAM``
words, so about one word in eighteen starts one, and two equal windows have the
same seed at the same place. Seeds of grams that only one document has end there.
All windows that a seed stands for make up its span. Where an earlier document has
the seed with the same span, the whole span is a match. Where the seed is shared
but the words around it are not the same all along, the seed is extended: by every
number of words to the left with what the length leaves to the right, and each
extension is looked up among those of the other distinct spans of that seed. What
lies under a match is one maximal run and is removed if it has ``LENGTH`` words.

No step brings the holders of a seed, a span or a window together: the least and
the greatest document of each are aggregates with partial sums, joined back by an
equi-join that adaptive execution may split. A seed in every document costs one
row a distinct span. Grams have 64 bits, spans 64 beside their gram, windows 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_lists, word_array, word_count, written
from .repeated_bytes import _binary, _eights, _mix

LENGTH, GRAM = 50, 16
_WINDOW = LENGTH - GRAM + 1
#: Words that are hashed at a time.
_PIECE = 100_000
_M = np.uint64(0x9E3779B97F4A7C15)
#: Two odd bases of polynomial hashes and what turns a word's hash into that of the second.
_BASES, _TURN = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)), np.uint64(0xE7037ED1A0B428DB)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of a batch of texts laid end to end."""
    low = int(offsets[0])
    gap = _SEPARATOR[data[low : int(offsets[-1])]]
    edge = np.zeros(len(gap) + 1, bool)
    edge[offsets - low] = True
    begin, stop = ~gap, ~gap
    begin[1:] &= gap[:-1] | edge[1:-1]
    stop[:-1] &= gap[1:] | edge[1:-1]
    start = np.flatnonzero(begin) + low
    return start, np.flatnonzero(stop) + 1 + low, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of any length."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), _PIECE):
        low = int(start[i])
        at, to = start[i : i + _PIECE] - low, end[i : i + _PIECE] - low
        v = _eights(data[low : low + int(to[-1])])
        x = (to - at).astype(np.uint64)
        open_ = np.arange(len(at))
        while len(open_):
            left = to[open_] - at[open_]
            x[open_] = _mix(x[open_] * _M + (v[at[open_]] & _TAIL[np.minimum(left, 8)]))
            open_ = open_[left > 8]
            at = at + 8
        out[i : i + _PIECE] = x
    return out


class _Rolling:
    """Hashes of any stretch of a sequence of words, twice 64 bits."""

    def __init__(self, h: np.ndarray):
        self.sums, self.backs = [], []
        for base, words in zip(_BASES, (h, _mix(h ^ _TURN)), strict=True):
            inverse = pow(int(base), -1, 1 << 64)
            up, back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), b, np.uint64)))) for b in (base, np.uint64(inverse)))
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64))))
            self.backs.append(back)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[end] - s[start]) * self.backs[which][start] + (end - start).astype(np.uint64) * _M)


def least_of_windows(value: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the first of equal ones."""
    index, reach = np.arange(len(value)), 1
    while reach < width and len(value) > min(reach, width - reach):
        step = min(reach, width - reach)
        m = len(value) - step
        index = np.where(value[step:] < value[:m], index[step:], index[:m])
        value = np.minimum(value[:m], value[step:])
        reach += step
    return index if reach == width else index[:0]


def seeds_of(roll: _Rolling, doc: np.ndarray) -> dict[str, np.ndarray]:
    """doc: row; first: word of the document with which the first window begins; n: windows; gram and span: hashes."""
    windows = len(doc) - LENGTH + 1
    if windows < 1:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "span") else np.int64) for k in ("doc", "first", "n", "gram", "span")}
    at = np.arange(len(doc) - GRAM + 1)
    grams = roll.of(0, at, at + GRAM)
    index = least_of_windows(grams, _WINDOW)
    whole = doc[:windows] == doc[LENGTH - 1 :]
    new = np.ones(windows, bool)
    new[1:] = (index[1:] != index[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), windows)
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    own = doc[first]
    return {"doc": own, "first": first - np.searchsorted(doc, own), "n": last - first + 1, "gram": grams[index[first]], "span": roll.of(1, first, last + LENGTH)}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _read(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, _Rolling]:
    data, offsets = _binary(pc.fill_null(part.column(column), b""))
    start, end, doc = word_places(data, offsets)
    return doc, _Rolling(word_hashes(data, start, end))


_SEEDS = "doc long, th long, gram long, span long, at long"
_STARTS = "doc long, th long, w1 long, w2 long, start long"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text) to its seeds; ``at`` is the first word times 64 and the number of windows."""
    for part in (p for batch in batches for p in text_slices(batch, 2)):
        doc, roll = _read(part, 2)
        s = seeds_of(roll, doc)
        ids, th = (np.asarray(part.column(k)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[s["doc"]]), pa.array(th[s["doc"]]), _signed(s["gram"]), _signed(s["span"]), pa.array(s["first"] * 64 + s["n"])], ["doc", "th", "gram", "span", "at"])


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, seeds) to all windows of the seeds."""
    for part in (p for batch in batches for p in text_slices(batch, 2)):
        doc, roll = _read(part, 2)
        lists = part.column(3)
        row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
        at = np.asarray(lists.flatten())
        first, n = at >> 6, at & 63
        entry = np.repeat(np.arange(len(at)), n)
        start = first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        place = np.searchsorted(doc, row)[entry] + start
        ids, th = (np.asarray(part.column(k))[row[entry]] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(th), *(_signed(roll.of(k, place, place + LENGTH)) for k in (0, 1)), pa.array(start)], ["doc", "th", "w1", "w2", "start"])


_REST = "n_words long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, matches) to (id, words, removed runs and a hash of the rest)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            words, own = (batch.column(1)[i].as_py() or b"").split(), batch.column(2)[i].values
            depth = np.zeros(len(words) + 1, np.int64)
            first = np.asarray(own.field("first"))
            np.add.at(depth, first, 1)
            np.add.at(depth, first + np.asarray(own.field("n")) + LENGTH - 1, -1)
            gone = np.cumsum(depth) > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
            kept = b" ".join(w for w, x in zip(words, gone[:-1].tolist(), strict=True) if not x)
            runs = [{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()]
            for column, x in zip(out, (len(words), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest(), runs), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "spans"])


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key more than one document has, with ``least``, the least of these."""
    held = rows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    return rows.join(written(held, "run-held"), keys)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    ``spans`` are the removed runs of words [a, b), in order. The id is an integer;
    rows with a null id take no part and keep all. Null, empty and blank texts have
    no words; texts below 50 words lose nothing. Rows of one id never remove each
    other's words; they are told by a hash of their text and each has its own
    result, equal rows the same. Texts of any length are read whole. An empty table
    gives an empty result. Other columns are not read, whatever their names.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    known = own.where("doc is not null").select("doc", "th", F.col("text").cast("binary").alias("t"))
    seeds = written(known.mapInArrow(_seeds, _SEEDS), "run-seeds")
    held = seeds.groupBy("gram").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), (F.min("span") < F.max("span")).alias("mixed")).where("least < most").select("gram", "mixed")
    # Aggregates are written before they are joined: adaptive execution splits a join's large parts only where both sides come right from a shuffle.
    held = written(held, "run-held")
    shared = written(seeds.join(held, "gram"), "run-shared")
    spans = written(shared.groupBy("gram", "span").agg(F.min("doc").alias("least")), "run-spans")
    found = written(shared.join(spans, ["gram", "span"]).select("doc", "th", "at", "mixed", (F.col("doc") > F.col("least")).alias("later")), "run-found")
    open_ = written(found.where("mixed and not later").groupBy("doc", "th").agg(F.collect_list("at").alias("seeds")), "run-open")
    rows, _ = with_lists(known, open_, ["doc", "th"])
    starts = written(rows.select("doc", "th", "t", "seeds").mapInArrow(_extensions, _STARTS), "run-starts")
    whole = found.where("later").select("doc", "th", F.shiftright("at", 6).alias("first"), F.col("at").bitwiseAND(63).alias("n"))
    edges = _shared(starts, ["w1", "w2"]).where("doc > least").select("doc", "th", F.col("start").alias("first"), F.lit(1).cast("long").alias("n"))
    lists = written(whole.unionByName(edges).groupBy("doc", "th").agg(F.collect_list(F.struct("first", "n")).alias("found")), "run-matches")
    hit, rest = with_lists(own, lists, ["doc", "th"])
    cut = hit.select("doc", F.col("text").cast("binary").alias("t"), "found").mapInArrow(_cut, f"doc_id long, {_REST}")
    kept = F.sha2(F.array_join(word_array(F.col("text")), " "), 256)
    zero = F.lit(0).cast("long")
    none = rest.select(F.col("doc").alias("doc_id"), word_count(F.col("text")).alias("n_words"), zero.alias("n_removed"), zero.alias("n_spans"), kept.alias("kept_sha256"), F.array().cast("array<struct<a:long,b:long>>").alias("spans"))
    return cut.unionByName(none)


def op11_substring_dedup(docs: DataFrame) -> DataFrame:
    """Words of every document, what is removed, and a hash of what is kept."""
    return repeated_runs(docs).drop("spans")


#: By brute force: all windows of 50 words, whole, and the least document that has the same.
OP11_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(s) as x, generate_subscripts(s, 1) as i from (select doc_id, list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' ')) as s from d where len(w) >= 50)),
m as (select *, min(doc_id) over (partition by x) as least from g),
r as (select distinct doc_id, unnest(range(i, i + 50)) as i from m where least < doc_id),
a as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
k as (select doc_id, count(r.i) as n_removed, sum(case when r.i is not null and q.i is null then 1 else 0 end) as n_spans, string_agg(x, ' ' order by a.i) filter (where r.i is null) as kept from a left join r using (doc_id, i) left join (select doc_id, i + 1 as i from r) q on q.doc_id = a.doc_id and q.i = a.i group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
