"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by a hash. A source's target words
become an exact quota of blocks in a random order (whole copies of the source,
then whole blocks that fit, then documents that fit until none is left that does). A binary tree over
the output shards splits the quotas: at each node a multivariate-hypergeometric
draw decides how many of the left half's places each source takes. Every shard
then takes the next blocks of each source's order, so that shards are disjoint,
and shuffles locally by a hash.

The driver holds one row for each source and block, about sqrt(rows) blocks a
source; documents never go through it but for those of one block of a source at a
time, where a quota ends inside the block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, root_bits, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words that each source is to give.

    Sources by code point, null last, get the weights in turn. A target stops at
    ``most`` times its source's words; what is cut off is shared again by weight
    among the others until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each source in each shard: rows are shards, columns sources.

    Each node gives its left half a share of the places by its number of shards
    and draws which sources fill them; both halves are then split in turn.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(own: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = own
            return
        half = n // 2
        places = int(own.sum()) * half // n
        drawn = np.random.default_rng([seed, first, n]).multivariate_hypergeometric(own, places, method="marginals")
        split(drawn, first, half)
        split(own - drawn, first + half, n - half)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


@dataclass
class MixPlan:
    blocks: DataFrame
    fillers: DataFrame
    per_source: DataFrame
    bits: int
    seed: int


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, bits: int, seed: int) -> DataFrame:
    u = F.xxhash64(F.lit(seed), F.col(id_col))
    return docs.withColumns({"__src": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")), "__u": u, "__block": F.shiftrightunsigned(u, 64 - bits).cast("int"), "__size": word_count(F.col(text_col))})


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 8, seed: int = 17, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> MixPlan:
    """Decide how often each block of each source is drawn, and for which shards.

    Documents without a word have size 0; they go with their block. Sources stand
    in order of code points, null last; blocks and documents in the order of a hash
    of the id, ties as one. What the driver holds is a number for each block of each
    source, 65,536 a source at most: it is made for sources in thousands, not for
    one a host.
    """
    spark = docs.sparkSession
    keyed = _keys(docs, id_col, source_col, text_col, 16, seed)
    sized = written(keyed.groupBy("__src", "__u").agg(F.sum("__size").alias("__size")), "mix-sizes")
    bits = min(16, root_bits(max(1, sized.count() // 16), 2))
    block = F.shiftrightunsigned("__u", 64 - bits).cast("int").alias("__block")
    grouped: dict = {}
    for r in sized.groupBy("__src", block).agg(F.sum("__size").alias("s")).collect():
        grouped.setdefault(r["__src"], {})[r["__block"]] = r["s"]
    name = lambda src: None if src == "null" else src[1:]
    sources = sorted(grouped)
    size = {s: sum(grouped[s].values()) for s in sources}
    goal = {f"s{k}" if k is not None else "null": v for k, v in targets({name(s): size[s] for s in sources}, weights, share, most).items()}
    plan, wanted = {}, {}
    for i, s in enumerate(sources):
        order = [int(b) for b in np.random.default_rng([seed, i]).permutation(sorted(grouped[s]))]
        base = int(goal[s] // size[s]) if size[s] else 0
        rest, extra = goal[s] - base * size[s], []
        for b in order:
            if grouped[s][b] <= rest:
                extra.append(b)
                rest -= grouped[s][b]
        plan[s] = {"base": base, "extra": set(extra), "rest": rest}
        wanted[s] = [b for b in order if b not in plan[s]["extra"]]
    fillers, fill = _fillers(sized, block, wanted, {s: p["rest"] for s, p in plan.items()})
    # One unit of a quota is a block's copy, or what a block gives to fill a quota's rest.
    units = [[(b, c) for c in range(plan[s]["base"]) for b in sorted(grouped[s])] + [(b, plan[s]["base"]) for b in sorted(plan[s]["extra"])] + [(-1 - b, 0) for b in sorted(fill[s])] for s in sources]
    tree = split_tree(np.array([len(u) for u in units]), shards, seed) if sources else np.zeros((shards, 0), dtype=np.int64)
    rows = []
    for i, s in enumerate(sources):
        shard_of = np.repeat(np.arange(shards), tree[:, i])
        at: dict = {b: [] for b in grouped[s]} | {-1 - b: [] for b in fill[s]}
        for k, j in enumerate(np.random.default_rng([seed, i, 1]).permutation(len(units[i]))):
            at[units[i][j][0]].append((units[i][j][1], int(shard_of[k])))
        rows += [(s, b, [x for _, x in sorted(at[b])], at[-1 - b][0][1] if b in fill[s] else None) for b in grouped[s]]
    return MixPlan(
        spark.createDataFrame(rows, T.StructType([T.StructField("__src", T.StringType()), T.StructField("__block", T.IntegerType()), T.StructField("__shards", T.ArrayType(T.IntegerType())), T.StructField("__fill", T.IntegerType())])),
        fillers,
        spark.createDataFrame([(s, size[s], float(goal[s])) for s in sources], T.StructType([T.StructField("__src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])),
        bits,
        seed,
    )


def _fillers(sized: DataFrame, block, order: dict, rest: dict) -> tuple[DataFrame, dict]:
    """(documents that fill what is left of the quotas, blocks of each source that they stand in).

    Blocks are gone through in ``order``, documents in a block by their hash, and each
    that still fits is taken. A round takes blocks whose fitting documents go whole, up
    to the first block of each source where they do not; that one is looked at document
    by document. A document that did not fit is too large for all later rounds.
    """
    spark = sized.sparkSession
    order, rest = {s: list(x) for s, x in order.items()}, dict(rest)
    whole: list = []
    single: list = []
    found: dict = {s: set() for s in order}
    placed = sized.withColumn("__block", block)
    keys = T.StructType([T.StructField("__src", T.StringType()), T.StructField("__block", T.IntegerType()), T.StructField("__most", T.LongType())])
    fitting = lambda rows: placed.join(F.broadcast(spark.createDataFrame(rows, keys)), ["__src", "__block"]).where("__size between 1 and __most")
    while near := [(s, b, int(rest[s])) for s, x in order.items() if rest[s] >= 1 for b in x]:
        sums = {(r["__src"], r["__block"]): r["s"] for r in fitting(near).groupBy("__src", "__block").agg(F.sum("__size").alias("s")).collect()}
        split = []
        for s in {s for s, _, _ in near}:
            most, left = int(rest[s]), [b for b in order[s] if (s, b) in sums]
            while left and sums[s, left[0]] <= rest[s]:
                whole.append((s, left[0], most))
                found[s].add(left[0])
                rest[s] -= sums[s, left.pop(0)]
            if left:
                split.append((s, left.pop(0), int(rest[s])))
            order[s] = left
        for r in fitting(split).orderBy("__src", "__u").collect() if split else []:
            if r["__size"] <= rest[r["__src"]]:
                rest[r["__src"]] -= r["__size"]
                single.append((r["__src"], r["__u"]))
                found[r["__src"]].add(r["__block"])
    one = spark.createDataFrame(single, "__src string, __u long")
    both = one.unionByName(fitting(whole).select("__src", "__u")) if whole else one
    return written(both.withColumn("__filled", F.lit(True)), "mix-fillers"), found


def _planned(docs: DataFrame, plan: MixPlan, id_col: str, source_col: str, text_col: str) -> DataFrame:
    keyed = _keys(docs, id_col, source_col, text_col, plan.bits, plan.seed)
    # Up to a number blocks and fillers are broadcast, so that texts are not shuffled for them.
    blocks, fillers = (F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (plan.blocks, plan.fillers))
    joined = keyed.join(blocks, ["__src", "__block"]).join(fillers, ["__src", "__u"], "left")
    return joined.withColumn("__shards", F.when(F.col("__filled").isNull(), F.col("__shards")).otherwise(F.concat("__shards", F.array("__fill"))))


def draw_mix(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each drawn copy of a document: its columns, then ``__copy``, ``__shard``, ``__rank``.

    ``__rank`` orders a shard's rows at random. Repeated rows are drawn alike, as
    are rows of one id in a source. A null source is a source of its own, the last
    one; null and blank texts have no words and go with their block. An empty table
    gives an empty result. Columns called as the three added ones are replaced.
    """
    drawn = _planned(docs, plan, id_col, source_col, text_col).select("*", F.posexplode("__shards").alias("__copy", "__shard"))
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns), "__copy", "__shard", F.xxhash64(F.lit(plan.seed + 1), F.col("__u"), F.col("__copy")).alias("__rank"))


def op6_mixing(docs: DataFrame) -> DataFrame:
    """Words taken from every document, with its source's words and target."""
    docs = docs.select("doc_id", "source", "text")
    plan = plan_mix(docs)
    out = _planned(docs, plan, "doc_id", "source", "text").join(plan.per_source, "__src")
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.size("__shards")).alias("taken"), F.array_join(F.col("__shards").cast("array<string>"), ",").alias("shards"))
