"""Removal of 50-byte strings that an earlier document has too, by sorted sampled suffixes.

A byte goes if a 50-byte window that covers it also starts in a document of a
smaller id. Not every suffix is sorted: each window is represented by its anchor,
the start of the least 16-byte gram inside it, so equal windows have equal
anchors. One tuple stands for all windows of an anchor: a hash of their span, and
of the two contexts that its windows have in common. Tuples are dealt into
buckets by their gram and sorted there. Equal spans settle all their windows at
once. Windows of anchors that share a context but not the span, where matches
begin and end, are hashed one by one and sorted in a second round.

Within a batch of documents only the first holder of a span goes to the bucket of
its gram, so a passage that very many documents share costs that bucket one tuple
for each batch; the later ones are settled and dealt anywhere. Spans are compared
by 128 bits of hashes, single windows by 96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_lists, written

LENGTH, GRAM = 50, 16
_WINDOW = LENGTH - GRAM + 1
#: Windows with fewer bytes than this before the anchor share the right context, the others the left one.
_HALF = (_WINDOW + 1) // 2 - 1
#: Bytes that are hashed at a time.
_PIECE = 250_000
#: Bytes of text for each bucket, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 4_000_000, 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number, zeros after the end."""
    v = np.zeros(len(b) + 8, np.uint64)
    v[: len(b)] = b
    for k in (1, 2, 4):
        v[:-k] |= v[k:] << np.uint64(8 * k)
    return v


def _hash(v: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) of each pair, 8 bytes or more."""
    x = (end - start).astype(np.uint64)
    for k in range(0, int((end - start).max(initial=0)) - 7, 8):
        more = start + k + 8 <= end
        x = np.where(more, _mix(x * _M + v[np.where(more, start + k, 0)]), x)
    return _mix(x * _M + v[end - 8])


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end) of stretches that together hold each window once, about ``_PIECE`` bytes at a time."""
    rows, starts, ends, n = [], [], [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for s in range(a, b - LENGTH + 1, _PIECE):
            rows.append(i)
            starts.append(s)
            ends.append(min(b, s + _PIECE + LENGTH - 1))
            n += ends[-1] - s
            if n >= _PIECE:
                yield np.array(rows), np.array(starts), np.array(ends)
                rows, starts, ends, n = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), np.array(ends)


def anchor_tuples(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all documents of a batch.

    doc: row; first: offset of the first window in the document; n: number of
    windows; back: bytes from the first window to the anchor; gram, span, right
    and left: hashes.
    """
    out: list[dict] = []
    for rows, starts, ends in _pieces(offsets):
        size = ends - starts
        at = np.concatenate(([0], np.cumsum(size)))
        b = np.concatenate([data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        v, n = _eights(b), len(b)
        value = _mix(v[: n - GRAM + 1] * _M + v[8 : n - GRAM + 9])
        grams, index, reach = value, np.arange(len(value), dtype=np.int32), 1
        for step in (1, 2, 4, 8, 16, _WINDOW - 32):
            if reach + step > _WINDOW:
                break
            m = len(value) - step
            take = value[step:] < value[:m]
            index, value = np.where(take, index[step:], index[:m]), np.minimum(value[:m], value[step:])
            reach += step
        piece = np.repeat(np.arange(len(rows)), size)
        windows = n - LENGTH + 1
        whole = piece[:windows] == piece[LENGTH - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (index[1:] != index[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        stop = np.append(np.flatnonzero(new | ~whole), windows)
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        p, own = index[first].astype(np.int64), piece[first]
        none = np.zeros(len(p), np.uint64)
        has_right, has_left = p - last <= _HALF, p - first > _HALF
        right, left = none.copy(), none.copy()
        right[has_right] = _hash(v, p[has_right], p[has_right] + LENGTH - _HALF)
        left[has_left] = _hash(v, p[has_left] - _HALF - 1, p[has_left] + GRAM)
        out.append({"doc": rows[own], "first": first - at[own] + starts[own] - offsets[rows[own]], "n": last - first + 1, "back": p - first, "gram": grams[p], "span": _hash(v, first, last + LENGTH), "right": right, "left": left})
    if not out:
        return {k: np.zeros(0, np.int64 if k in ("doc", "first", "n", "back") else np.uint64) for k in ("doc", "first", "n", "back", "gram", "span", "right", "left")}
    return {k: np.concatenate([x[k] for x in out]) for k in out[0]}


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, byte by byte, so that the shuffle compresses the high ones away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(b: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class _Layout:
    """Tuples as binary: each column with its width in bytes."""

    def __init__(self, **widths: int):
        self.widths = widths

    def pack(self, columns: dict[str, np.ndarray]) -> bytes:
        return b"".join(_planes(columns[k], w) for k, w in self.widths.items())

    def unpack(self, blobs: list[bytes]) -> dict[str, np.ndarray]:
        size, parts = sum(self.widths.values()), {k: [] for k in self.widths}
        for b in blobs:
            n, at = len(b) // size, 0
            for k, w in self.widths.items():
                parts[k].append(_unplanes(b, at, n, w))
                at += n * w
        return {k: np.concatenate(x) if x else np.zeros(0, np.uint64) for k, x in parts.items()}


#: Documents are 64-bit ids with the sign bit turned, so that they sort as numbers.
_SIGN = np.uint64(1 << 63)
_SPANS = _Layout(span=8, right=4, left=4, doc=8, first=5, n=1, back=1)
_STARTS = _Layout(key=8, more=4, doc=8, first=5)
_FOUND = "doc_id long, first long, n long, back long, sides long"


def _first_holders(keys: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, held): a sort by both keys and document, the group of each, and the least document of its group."""
    order = np.lexsort((doc, keys[1], keys[0]))
    k, more, d = keys[0][order], keys[1][order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (more[1:] != more[:-1])
    group = np.cumsum(new) - 1
    return order, group, d[np.flatnonzero(new)][group] if len(k) else d


def _span_keys(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of a span and those of its contexts, which equal spans have in common: 128 bits."""
    low = np.uint64(0xFFFFFFFF)
    return t["span"], ((t["right"] & low) << np.uint64(32)) | (t["left"] & low)


def _rows(doc: np.ndarray, first: np.ndarray, n: np.ndarray, back: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((doc ^ _SIGN).view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (first, n, back, sides))], ["doc_id", "first", "n", "back", "sides"])


def _dealt(t: dict[str, np.ndarray], keys: tuple[np.ndarray, np.ndarray], bucket: np.ndarray, layout: _Layout, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, tuples) of a batch: kind 0 first holders of a key, kind 1 later ones.

    Later holders are settled, so they go to no bucket of their key but, all of a
    batch together, to any: a passage that every document has crowds none.
    """
    order, _, held = _first_holders(keys, t["doc"])
    later = np.zeros(len(bucket), bool)
    later[order] = held != t["doc"][order]
    done = np.flatnonzero(later)
    if len(done):
        any_ = int(_mix(t["doc"][done[:1]])[0] >> np.uint64(1)) % buckets
        yield any_, 1, layout.pack({k: t[k][done] for k in layout.widths})
    open_ = np.flatnonzero(~later)
    sort = open_[np.lexsort((t["doc"][open_], bucket[open_]))]
    cut = np.flatnonzero(np.diff(bucket[sort])) + 1
    for part in np.split(sort, cut) if len(sort) else []:
        yield int(bucket[part[0]]), 0, layout.pack({k: t[k][part] for k in layout.widths})


_BLOBS = "bucket int, kind int, tuples binary"


def _blobs(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], ["bucket", "kind", "tuples"])


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64) ^ _SIGN


def _spans_by_bucket(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            ids = _ids(batch.column(0))
            t = anchor_tuples(*_binary(batch.column(1)))
            t["doc"] = ids[t["doc"]]
            bucket = (t["gram"] >> np.uint64(40)).astype(np.int64) % buckets
            yield _blobs(list(_dealt(t, _span_keys(t), bucket, _SPANS, buckets)))

    return deal


def _settle_spans(table: pa.Table) -> pa.Table:
    """Spans that an earlier document has (sides 0), and anchors to look at window by window.

    sides: 1 if windows of the right context may match another span's, 2 for the
    left one, 3 for both.
    """
    kinds, blobs = table.column("kind").to_pylist(), table.column("tuples").to_pylist()
    done = _SPANS.unpack([b for b, k in zip(blobs, kinds, strict=True) if k])
    out = [_rows(done["doc"], done["first"], done["n"], done["back"], np.zeros(len(done["doc"])))]
    t = _SPANS.unpack([b for b, k in zip(blobs, kinds, strict=True) if not k])
    order, group, held = _first_holders(_span_keys(t), t["doc"])
    t = {k: x[order] for k, x in t.items()}
    dup = held != t["doc"]
    sides = np.zeros(len(group), np.int64)
    for side, key in ((1, t["right"]), (2, t["left"])):
        by = np.lexsort((group, key))
        k, g = key[by], group[by]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        run = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new), len(k))
        mixed = g[ends[:-1]] != g[ends[1:] - 1] if len(k) else np.zeros(0, bool)
        sides[by] |= np.where(mixed[run] & (k != 0), side, 0) if len(k) else 0
    sides[dup] = 0
    keep = dup | (sides > 0)
    out.append(_rows(*(t[x][keep] for x in ("doc", "first", "n", "back")), sides[keep]))
    return pa.Table.from_batches(out)


def _windows_by_bucket(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            data, offsets = _binary(batch.column(1))
            lists = batch.column(2)
            count = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            first, n, back, sides = (np.asarray(flat.field(k)) for k in ("first", "n", "back", "sides"))
            row = np.repeat(np.arange(len(count)), count)
            entry = np.repeat(np.arange(len(first)), n)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            left = back[entry] - at > _HALF
            keep = (sides[entry] & np.where(left, 2, 1)) > 0
            entry, at = entry[keep], at[keep]
            start = first[entry] + at
            place = offsets[row[entry]] + start
            key, more = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
            for i in range(0, len(place), _PIECE):
                w = place[i : i + _PIECE]
                low = int(w.min()) if len(w) else 0
                high = int(w.max()) + LENGTH if len(w) else 0
                v, at = _gathered(data, w) if high - low > 8 * _PIECE else (_eights(data[low:high]), w - low)
                key[i : i + _PIECE] = _hash(v, at, at + LENGTH)
                more[i : i + _PIECE] = _hash(v ^ _M, at, at + LENGTH) & np.uint64(0xFFFFFFFF)
            t = {"key": key, "more": more, "doc": _ids(batch.column(0))[row[entry]], "first": start}
            yield _blobs(list(_dealt(t, (key, more), (key >> np.uint64(40)).astype(np.int64) % buckets, _STARTS, buckets)))

    return deal


def _gathered(data: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows at ``w`` one after the other, where they lie far apart: their eights and where each begins."""
    flat = np.ascontiguousarray(data[w[:, None] + np.arange(LENGTH)]).reshape(-1)
    return _eights(flat), np.arange(len(w)) * LENGTH


def _settle_windows(table: pa.Table) -> pa.Table:
    kinds, blobs = table.column("kind").to_pylist(), table.column("tuples").to_pylist()
    done = _STARTS.unpack([b for b, k in zip(blobs, kinds, strict=True) if k])
    t = _STARTS.unpack([b for b, k in zip(blobs, kinds, strict=True) if not k])
    order, _, held = _first_holders((t["key"], t["more"]), t["doc"])
    dup = held != t["doc"][order]
    doc, first = (np.concatenate((done[k], t[k][order][dup])) for k in ("doc", "first"))
    # Neighbouring windows of a document are one row.
    by = np.lexsort((first, doc))
    doc, first = doc[by], first[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin, len(doc))[1:] - 1
    zero = np.zeros(len(begin))
    return pa.Table.from_batches([_rows(doc[begin], first[begin], (first[end] - first[begin] + 1 if len(begin) else zero), zero, zero)])


_REST = "n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes, found rows) to (id, bytes, removed spans and a hash of the rest)."""
    for batch in batches:
        texts, found = batch.column(1), batch.column(2)
        removed, n_spans, shas, spans = [], [], [], []
        for i in range(len(texts)):
            raw, own = texts[i].as_py() or b"", found[i].values
            first = np.asarray(own.field("first"))
            order = np.argsort(first, kind="stable")
            first, end = first[order], (first + np.asarray(own.field("n")) + LENGTH - 1)[order]
            reach = np.maximum.accumulate(end)
            new = np.ones(len(first), bool)
            new[1:] = first[1:] > reach[:-1]
            a = first[new]
            b = reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]
            kept, at = hashlib.sha256(), 0
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            removed.append(int((b - a).sum()))
            n_spans.append(len(a))
            shas.append(kept.hexdigest())
            spans.append([{"a": s, "b": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(texts[i].as_py() or b"") for i in range(len(texts))], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    ``spans`` are the removed byte ranges [a, b), merged, in order. The id is an
    integer; rows with a null id take no part and keep all. Null and empty texts,
    and texts below 50 bytes, lose nothing. Repeated rows of one id are one
    document with one result each. Texts of any length are read whole, in
    overlapping stretches. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(64, 1 << (int(total) // BUCKET_BYTES).bit_length()))
    known = own.where("doc_id is not null")
    spans = written(known.mapInArrow(_spans_by_bucket(buckets), _BLOBS).groupBy("bucket").applyInArrow(_settle_spans, _FOUND), "repeat-spans")
    pack = F.collect_list(F.struct("first", "n", "back", "sides")).alias("found")
    open_ = written(spans.where("sides > 0").groupBy("doc_id").agg(pack), "repeat-open")
    rows, _ = with_lists(known, open_, ["doc_id"])
    more = rows.select("doc_id", "t", "found").mapInArrow(_windows_by_bucket(buckets), _BLOBS).groupBy("bucket").applyInArrow(_settle_windows, _FOUND)
    lists = written(spans.where("sides = 0").unionByName(more).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("found")), "repeat-found")
    rows, rest = with_lists(own, lists, ["doc_id"])
    cut = rows.select("doc_id", "t", "found").mapInArrow(_cut, f"doc_id long, n_bytes long, {_REST}")
    none = rest.select("doc_id", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("t", F.lit(b"")), 256).alias("kept_sha256"), F.array().cast("array<struct<a:long,b:long>>").alias("spans"))
    return cut.unionByName(none)


def op9_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Bytes of every document, what is removed, and a hash of what is kept."""
    return repeated_spans(docs).drop("spans")
