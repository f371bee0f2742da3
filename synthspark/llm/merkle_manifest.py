"""Merkle manifest of a dataset: a sparse forest that is reduced associatively.

A fragment is a set of nodes (tree, level, index) with their digests, none of which
has all its siblings beside it. ``merged`` unites fragments: whenever a run of
siblings is complete they become their parent, and so on upwards. A run has two
nodes, or one at the end of an odd level, which follows from the known number of
leaves; so fragments can be merged in any order and grouping with the same result,
and a fragment of consecutive leaves has about twice as many nodes as levels.

Leaves are numbered within their tree by one sort. Each Arrow batch of them becomes
a fragment, and the fragments are reduced as a tree: a round unites the nodes under
each block of leaves, the next one blocks ``1 << FAN_BITS`` times as large, until
one node is left of each tree. A task sees one block's fragments; the driver gets
one number, the size of the largest tree. ``RDD.treeReduce`` would do the same in
memory, but deals parts by their number modulo, so that its inner fragments hardly
shrink, and ends with all of them on the driver.

Every node that came up outside a batch is kept as a table. A leaf's proof is what
its own batch knows of its siblings and, above that, a lookup in this table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Leaves of a block in the first round, and blocks that a later round unites, as powers of two.
BLOCK_BITS, FAN_BITS = 18, 10

Node = tuple[str, int, int]


def parent(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def siblings(index: int, level: int, leaves: int) -> range:
    """The run that a node stands in."""
    return range(index & ~1, min((index | 1) + 1, -(-leaves >> level)))


def merged(nodes: dict[Node, str], leaves: dict[str, int], seen: Callable[[Node, str], None] = lambda node, digest: None) -> dict[Node, str]:
    """The fragment of these nodes: complete runs are replaced by their parents; ``seen`` hears of each node made."""
    out, todo = dict(nodes), list(nodes)
    while todo:
        tree, level, index = todo.pop()
        if (tree, level, index) not in out or -(-leaves[tree] >> level) == 1:
            continue
        run = [(tree, level, i) for i in siblings(index, level, leaves[tree])]
        if all(x in out for x in run):
            up = (tree, level + 1, index >> 1)
            out[up] = parent([out.pop(x) for x in run])
            seen(up, out[up])
            todo.append(up)
    return out


_NODE = "tree string, level int, idx long, leaves long, digest string"


def _batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (tree, idx, leaves, digest, row) to the node that each ends below in its batch, and its siblings up to there, null where there is none."""
    for batch in batches:
        trees, index, counts, digests, rows = (batch.column(k).to_pylist() for k in range(5))
        leaves, made = dict(zip(trees, counts, strict=True)), {(t, 0, i): d for t, i, d in zip(trees, index, digests, strict=True)}
        roots = merged(dict(made), leaves, made.__setitem__)
        out: list[list] = [[], [], [], []]
        for t, i, n in zip(trees, index, counts, strict=True):
            level, way = 0, []
            while (t, level, i) not in roots:
                way.append(made[t, level, i ^ 1] if len(siblings(i, level, n)) == 2 else None)
                i, level = i >> 1, level + 1
            for column, x in zip(out, (level, i, roots[t, level, i], way), strict=True):
                column.append(x)
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))
        level, at, digest, way = (pa.array(x, t) for x, t in zip(out, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), level, at, batch.column(2), digest, pa.array(rows, pa.int64()), way], ["tree", "level", "idx", "leaves", "digest", "row", "way"])


def _unite(block: pa.Table) -> pa.Table:
    """Fragments of a block to all nodes made of them and those left; ``open`` are the ones without a parent yet."""
    trees, levels, index, counts, digests = (block.column(k).to_pylist() for k in ("tree", "level", "idx", "leaves", "digest"))
    leaves, made = dict(zip(trees, counts, strict=True)), {}
    left = merged({(t, v, i): d for t, v, i, d in zip(trees, levels, index, digests, strict=True)}, leaves, made.__setitem__)
    rows = [(*x, leaves[x[0]], d, x in left) for x, d in (left | made).items()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["tree", "level", "idx", "leaves", "digest", "open"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row``, a number of each, ``place`` within its ``tree`` by ``order``, and ``leaves``, the size of the tree.

    One range sort; the rows of each tree in each sorted part are counted, and places
    follow from the counts of the parts before.
    """
    parts = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("row", 33))
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(Window.partitionBy("tree")).alias("leaves"))
    return parts.join(starts, ["tree", "part"]).withColumn("place", F.col("row") - F.col("low") + F.col("at")).drop("part", "low", "at")


def ways(leaves: DataFrame) -> DataFrame:
    """(tree, place, leaves, digest, row) to (row, way, root): the siblings of a leaf and of its ancestors, level by level, null where a node has none."""
    given = leaves.select("tree", "place", "leaves", "digest", "row").sortWithinPartitions("tree", "place")
    local = written(given.mapInArrow(_batch, f"{_NODE}, row long, way array<string>"), "local-ways")
    open_ = written(local.groupBy("tree", "level", "idx").agg(F.first("leaves").alias("leaves"), F.first("digest").alias("digest")), "fragments")
    tops, rounds, bits = open_, [open_], BLOCK_BITS
    most = open_.agg(F.max("leaves")).first()[0] or 0
    while most > 1:
        block = F.shiftright(F.expr("shiftleft(idx, level)"), bits)
        united = written(open_.withColumn("block", block).groupBy("tree", "block").applyInArrow(_unite, f"{_NODE}, open boolean"), "fragments")
        rounds.append(united)
        open_ = united.where("open").drop("open")
        if most <= 1 << bits:
            break
        bits += FAN_BITS
    nodes = rounds[0].select("tree", "level", "idx", "digest")
    for x in rounds[1:]:
        nodes = nodes.union(x.select(*nodes.columns))
    nodes = nodes.distinct()
    # Leaves that end below the same node share the way from there.
    height = F.expr("case when leaves > 1 then length(bin(leaves - 1)) else 0 end")
    steps = tops.withColumn("height", height).where("level < height").select("tree", F.col("level").alias("from"), F.col("idx").alias("at"), F.explode(F.expr("sequence(level, height - 1)")).alias("level"))
    steps = steps.withColumn("idx", F.expr("shiftright(at, level - from)").bitwiseXOR(F.lit(1).cast("long"))).join(nodes, ["tree", "level", "idx"], "left")
    up = steps.groupBy("tree", "from", "at").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("up"))
    out = local.select("tree", F.col("level").alias("from"), F.col("idx").alias("at"), "row", "way").join(up, ["tree", "from", "at"], "left")
    more = F.coalesce(F.transform("up", lambda x: x["digest"]), F.array().cast("array<string>"))
    return out.join(open_.select("tree", F.col("digest").alias("root")), "tree").select("row", F.concat("way", more).alias("way"), "root")


def folded(digest: Column, way: Column, place: Column) -> Column:
    """The root that a leaf at this place comes to with these siblings."""
    steps = F.transform(way, lambda s, i: F.struct(F.coalesce(s, F.lit("")).alias("s"), (F.getbit(place, i) == 1).alias("left")))
    return F.aggregate(steps, digest, lambda d, x: F.sha2(F.when(x["left"], F.concat(x["s"], d)).otherwise(F.concat(d, x["s"])), 256))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    own = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in own)), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "lang", claims: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, claimed, subroot, root, way, place, top_way, top_place) for every row of ``docs``.

    A row's leaf is the digest of its ``fields``; ``claimed`` is that with the columns
    of ``claims`` in their place. The leaves of one ``tree_col`` make a tree, in order
    of the id (null first; rows of one id in order of their leaf), and the roots of
    these, in order of ``tree_col`` (null first), the tree on top. ``way`` and
    ``top_way`` are the siblings in both. Null fields have a mark of their own, so
    they differ from empty ones; repeated rows are leaves of their own; texts of any
    length are read whole. An empty table gives an empty result. Other columns are
    not read, whatever their names.
    """
    col = lambda c: F.col(f"`{c}`")
    claimed = [(claims or {}).get(c, col(c)) for c in fields]
    tree = F.coalesce(F.concat(F.lit("v"), col(tree_col).cast("string")), F.lit("n"))
    rows = docs.select(col(id_col).alias("id"), tree.alias("tree"), leaf_digest([col(c) for c in fields]).alias("digest"), (leaf_digest(claimed) if claims else F.lit(None).cast("string")).alias("claimed"))
    leaves = numbered(written(rows, "digests"), ["id", "digest"])
    low = ways(leaves)
    trees = written(leaves.where("place = 0").join(low, "row").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest")), "subroots")
    tops = numbered(trees, ["key"])
    high = tops.join(ways(tops), "row").select(F.col("key").alias("tree"), F.col("root"), F.col("way").alias("top_way"), F.col("place").alias("top_place"))
    own = leaves.select("row", "id", "tree", F.col("digest").alias("leaf"), F.coalesce("claimed", "digest").alias("claimed"), "place")
    return own.join(low.withColumnRenamed("root", "subroot"), "row").join(high, "tree").select(F.col("id").alias(id_col), "leaf", "claimed", "subroot", "root", "way", "place", "top_way", "top_place")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, what the claimed leaf comes to with the siblings on record, and whether it is the root."""
    fold = folded(folded(F.col("claimed"), F.col("way"), F.col("place")), F.col("top_way"), F.col("top_place"))
    return rows.withColumn("folded_root", fold).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, digest of the proof and its check, with ``n_chars`` tampered with where 7 divides the CRC of the id."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = verified(manifest(docs, claims={"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))
    proof = F.sha2(F.array_join(F.concat("way", "top_way"), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(n_chars: str) -> str:
    fields = ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + ")"


#: Both trees level by level; the CRC bit by bit.
OP12_SQL = f"""
with recursive crc as (select doc_id, 4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) as v from documents),
l as (select doc_id, lang, {_sql_leaf("n_chars")} as leaf, {_sql_leaf("case when v % 7 = 0 then n_chars + 1 else n_chars end")} as claimed, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from documents join crc using (doc_id)),
t as (select lang, 0 as level, i, n, leaf as h from l
  union all select lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from t where n > 1 group by lang, level, i // 2),
s as (select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t where n = 1),
u as (select 0 as level, i, n, h from s
  union all select level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from u where n > 1 group by level, i // 2),
p as (select doc_id, lang, 0 as level, i, n, claimed as f, '' as proof from l
  union all select p.doc_id, p.lang, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(case when p.i % 2 = 1 then t.h || p.f else p.f || coalesce(t.h, '') end), p.proof || coalesce(t.h, '')
  from p left join t on t.lang is not distinct from p.lang and t.level = p.level and t.i = xor(p.i, 1) where p.n > 1),
q as (select p.doc_id, 0 as level, s.i, s.n, p.f, p.proof from p join s on s.lang is not distinct from p.lang where p.n = 1
  union all select q.doc_id, q.level + 1, q.i // 2, (q.n + 1) // 2, sha256(case when q.i % 2 = 1 then u.h || q.f else q.f || coalesce(u.h, '') end), q.proof || coalesce(u.h, '')
  from q left join u on u.level = q.level and u.i = xor(q.i, 1) where q.n > 1)
select l.doc_id, l.leaf, s.h as subroot, u.h as root, sha256(q.proof) as proof_sha256, q.f as folded_root, q.f = u.h as verified
from l join s on s.lang is not distinct from l.lang join q on q.doc_id = l.doc_id and q.n = 1 join u on u.n = 1
"""
