"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves.

A single edit leaves one of a word's two halves as it is: the first one at the start
of the other word, or the second one at its end. Automata hold both halves of all
words. Every word is scanned with them; a half found counts if it stands at that
offset and the lengths differ by one at most, and then the edit itself is checked.

Words and automata meet in shards. A half begins (or, the second one, ends) with the
same few characters as the word it is found in, so these characters are dealt to
shards, and a word is scanned where halves that it may hold are, not everywhere.
Characters that very many words share are dealt to a grid of shards, parts of the
words as automata times parts of the words to scan. A pair is reported by one shard:
where both halves are found, by that of the first one. What a shard finds for a word
is added up before it is sent on, so pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words shorter or rarer than this are left out; a form has at least ``RATIO`` times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Characters of a half by which it is dealt, words of one such key in a shard, and rows of all keys in one.
EDGE, KEY_WORDS, SHARD_ROWS = 3, 20_000, 40_000
#: Candidates that are checked at a time, and the longest words that are checked as arrays.
_PIECE, _LONG = 200_000, 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def damaged(doc_id: Column, word: Column) -> Column:
    """The word, one in 97 without a character: the place and whether come from a CRC of id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, lower-cased in A-Z, of ``LEAST_LENGTH`` characters that occur ``LEAST_COUNT`` times."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run"))
    words = each.select(damaged(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keys(length: Column) -> Column:
    """For each half that a word may hold: its side, the characters it is dealt by, and whether it is the word's own.

    The words that may hold a half of ``h`` characters have ``2 h - 1`` to ``2 h + 2``
    (first half) and one less (second half), so two keys of different length occur
    near twice ``EDGE`` only.
    """
    half = lambda n, side: F.least(F.lit(EDGE), F.floor((n + side) / 2).cast("int"))

    def of(side: int) -> Column:
        sizes = F.array_distinct(F.array(*(half(length + d, side) for d in (-1, 0, 1))))
        return F.transform(sizes, lambda k: F.struct(F.lit(side).alias("side"), k.alias("size"), (k == half(length, side)).alias("own")))

    return F.concat(of(0), of(1))


def shards(words: DataFrame) -> DataFrame:
    """(shard, side, word, n, held, scanned): where each word's halves are held and where it is scanned."""
    length = F.length("word")
    each = words.select("word", "n", F.explode(_keys(length)).alias("k")).select("word", "n", "k.side", "k.own", F.when(F.col("k.side") == 0, F.left("word", F.col("k.size"))).otherwise(F.right("word", F.col("k.size"))).alias("key"))
    each = written(each, "word-keys")
    sizes = each.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, total // SHARD_ROWS)
    rest = F.lit(n_shards)
    large = sizes.where(F.col("size") > KEY_WORDS).withColumn("parts", F.ceil(F.col("size") / KEY_WORDS).cast("int"))
    # As many large keys as fit into all rows at most, a row each.
    dealt = each.join(large.select("side", "key", "parts"), ["side", "key"], "left")
    plain = dealt.where("parts is null").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("side", "key"), rest).cast("string")).alias("shard"), "side", "word", "n", F.col("own").alias("held"), F.lit(True).alias("scanned"))
    part = F.pmod(F.xxhash64("word", "side"), F.col("parts"))
    cells = dealt.where("parts is not null").withColumn("part", part).withColumn("to", F.explode(F.expr("sequence(0, parts - 1)")))
    name = lambda a, b: F.concat_ws(":", F.lit("k"), "side", "key", a, b)
    held = cells.where("own").select(name(F.col("part"), F.col("to")).alias("shard"), "side", "word", "n", F.lit(True).alias("held"), F.lit(False).alias("scanned"))
    scanned = cells.select(name(F.col("to"), F.col("part")).alias("shard"), "side", "word", "n", F.lit(False).alias("held"), F.lit(True).alias("scanned"))
    # A number of partitions of its own: shards are small in bytes and dear in time, so they are not to be united by their bytes.
    return plain.unionByName(held).unionByName(scanned).repartition(max(8, n_shards), "shard")


def _codes(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of words as rows, zeros before or after them; of long words only so many."""
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        c = np.frombuffer((w[-width:] if right else w[:width]).encode("utf-32-le"), np.uint32)
        if right:
            out[i, width - len(c) :] = c
        else:
            out[i, : len(c)] = c
    return out


def one_edit(u: str, w: str) -> bool:
    """Whether one inserted, deleted or replaced code point tells the words apart."""
    if u == w or abs(len(u) - len(w)) > 1:
        return False
    n, p, s = min(len(u), len(w)), 0, 0
    while p < n and u[p] == w[p]:
        p += 1
    while s < n and u[-1 - s] == w[-1 - s]:
        s += 1
    return p + s >= max(len(u), len(w)) - 1


class _Words:
    """Words with their code points from either end."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        self.ends = [_codes(words, _LONG, right) for right in (False, True)]


def _checked(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i of a, j of b) are one edit apart."""
    ok = np.zeros(len(i), bool)
    most = np.maximum(a.size[i], b.size[j])
    for k in range(0, len(i), _PIECE):
        x, y, longest = i[k : k + _PIECE], j[k : k + _PIECE], most[k : k + _PIECE]
        wide = min(_LONG, int(longest.max()))
        head, tail = a.ends[0][x, :wide] != b.ends[0][y, :wide], (a.ends[1][x, _LONG - wide :] != b.ends[1][y, _LONG - wide :])[:, ::-1]
        least = np.minimum(a.size[x], b.size[y])
        p, s = (np.where(m.any(axis=1), m.argmax(axis=1), wide) for m in (head, tail))
        ok[k : k + _PIECE] = head.any(axis=1) & (np.minimum(p, least) + np.minimum(s, least) >= longest - 1)
    for k in np.flatnonzero(most > _LONG).tolist():
        ok[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return ok


def _found(side: int, held: list[str], scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(scanned, held) places of the pairs one edit apart of which the half of this side is intact, but for side 1 where that of side 0 is not."""
    lists: dict[str, list[int]] = {}
    for k, w in enumerate(held):
        lists.setdefault(w[: len(w) // 2] if side == 0 else w[len(w) // 2 :], []).append(k)
    halves = list(lists)
    automaton = ahocorasick.Automaton()
    for k, half in enumerate(halves):
        automaton.add_word(half, (k, len(half)))
    automaton.make_automaton()
    who, which = [], []
    for i, u in enumerate(scanned):
        low, high = (len(u) - 1 + side) // 2, (len(u) + 1 + side) // 2
        for end, (k, size) in automaton.iter(u):
            if low <= size <= high and end == (size if side == 0 else len(u)) - 1:
                who.append(i)
                which.append(k)
    who_, which_ = np.array(who, np.int64), np.array(which, np.int64)
    flat = np.array([k for half in halves for k in lists[half]], np.int64)
    count = np.array([len(lists[half]) for half in halves], np.int64)
    begin = np.cumsum(count) - count
    a, b = _Words(scanned), _Words(held)
    pairs = []
    # Candidates are expanded some at a time.
    cuts = np.flatnonzero(np.diff(np.cumsum(count[which_]) // (4 * _PIECE), prepend=-1)) if len(which_) else []
    for x, y in zip(cuts, [*cuts[1:], len(which_)], strict=True) if len(cuts) else []:
        k = which_[x:y]
        i = np.repeat(who_[x:y], count[k])
        at = np.arange(len(i)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
        j = flat[np.repeat(begin[k], count[k]) + at]
        near = np.abs(a.size[i] - b.size[j]) <= 1
        i, j = i[near], j[near]
        ok = _checked(a, i, b, j)
        i, j = i[ok], j[ok]
        if side == 1:
            own = np.array([not scanned[p].startswith(held[q][: len(held[q]) // 2]) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[own], j[own]
        pairs.append((i, j))
    return tuple(np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))


_NEAR = "word string, n_near long, form string, form_n long"


def _near(shard: pa.Table) -> pa.Table:
    """Near words of the words that a shard scans: how many, and the one of most occurrences, the least of these."""
    out: list[list] = [[], [], [], []]
    sides, words, counts, held, scanned = (shard.column(k).to_pylist() for k in ("side", "word", "n", "held", "scanned"))
    for side in (0, 1):
        n = dict(zip(words, counts, strict=True))
        dictionary = sorted({w for w, s, h in zip(words, sides, held, strict=True) if s == side and h})
        text = sorted({w for w, s, x in zip(words, sides, scanned, strict=True) if s == side and x})
        if not dictionary or not text:
            continue
        best: dict[str, list] = {}
        for i, j in zip(*(x.tolist() for x in _found(side, dictionary, text)), strict=True):
            u, w = text[i], dictionary[j]
            b = best.setdefault(u, [0, w])
            b[0] += 1
            if (-n[w], w) < (-n[b[1]], b[1]):
                b[1] = w
        for u, (k, w) in best.items():
            for column, x in zip(out, (u, k, w, n[w]), strict=True):
                column.append(x)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for words that have near ones how many, and of these (-n, word) the least."""
    found = shards(words.where(F.length("word") > 1)).groupBy("shard").applyInArrow(_near, _NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by doubling of steps.

    A form occurs at least ``RATIO`` times as often as its variant, so the way is no
    longer than the logarithm of the largest count and each round halves it.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    Two words are near if one code point is inserted, deleted or replaced. The form of
    a word is its near word of most occurrences, the least one in code-point order of
    equal ones, if it has ``RATIO`` times the word's own; else null. ``root`` follows
    forms to the last, and is the word itself where there is none. Words are distinct
    and not null, of any length, but those of one code point have no near words; an
    empty table gives an empty result.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words)
    kept = F.when(-F.col("best.n") >= RATIO * F.col("n"), F.col("best"))
    out = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), kept["form"].alias("form"), (-kept["n"]).alias("form_n")), "near-words")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    """Groups of the words of all documents, one in 97 of which loses a character.

    Null texts have no words, a null id stands for an empty one, repeated rows count
    each; texts of any length are read whole; other columns are not read.
    """
    return spelling_groups(words_of(docs))


#: The CRC bit by bit; near words by equal rests after one deletion, whole words compared.
OP13_SQL = """
with recursive o as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents),
c as (select doc_id, w, count(*) as n, encode(doc_id::varchar || ':' || w) as b from o group by doc_id, w),
h as (select w, n, 4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(b)), lambda i: ('0x' || hex(b[i + 1:i + 1]))::bigint)), lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) as h from c),
d as (select case when h % 97 = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as w, n from h),
v as (select w as word, sum(n)::bigint as n from d where length(w) >= 5 group by w having sum(n) >= 3),
x as (select word, n, length(word) as len, unnest(range(length(word))) as i from v),
y as (select word, n, len, i, word[:i] || word[i + 2:] as rest from x),
e as (select a.word, b.word as near, b.n from y a join y b on a.len = b.len and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from y a join v b on a.rest = b.word
  union select b.word, a.word, a.n from y a join v b on a.rest = b.word),
k as (select word, count(*) as n_near, max(n) as most from e group by word),
f as (select k.word, k.n_near, k.most, min(e.near) as near from k join e on e.word = k.word and e.n = k.most group by k.word, k.n_near, k.most),
g as (select v.word, v.n, coalesce(f.n_near, 0) as n_near, case when f.most >= 2 * v.n then f.near end as form, case when f.most >= 2 * v.n then f.most end as form_n from v left join f using (word)),
r as (select word, word as at from g union all select r.word, g.form from r join g on g.word = r.at where g.form is not null)
select g.word, g.form, r.at as root, g.n, g.n_near::bigint as n_near, g.form_n::bigint as form_n from g join r using (word) join g l on l.word = r.at and l.form is null
"""
