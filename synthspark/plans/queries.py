"""The catalogue of queries over the sample tables, each with its SQL.

By convention the rows of even keys are the real table and those of odd keys the
synthetic one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import context_trees, copula, distances, key_shapes, marginals, privacy, profile, sequence_models, sequences
from ..sources import tables
from . import benchmarks, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)


# ---- SQL pieces ----

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "customer": "c_custkey", "part": "p_partkey"}


def long_sql(table: str, numbers: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> str:
    """(is_r, col, x) or (is_r, col, v) for the given expressions."""
    key, out = KEYS[table], []
    for kind, cells in (("x", numbers), ("v", texts)):
        out += [f"select ({key} % 2 = 0)::int as is_r, '{c}' as col, ({e}){'::double' if kind == 'x' else '::varchar'} as {kind} from {table}" for c, e in (cells or {}).items()]
    return " union all ".join(out)


def ecdf_sql(long: str) -> str:
    """ctes: l, g, t, e (gaps) and s (spread) by column."""
    return f"""l as (select * from ({long}) where x is not null and not isnan(x)),
g as (select col, x, sum(is_r) as nr, sum(1 - is_r) as ns from l group by 1, 2),
t as (select col, sum(nr)::double as tr, sum(ns)::double as ts from g group by 1),
c as (select g.*, tr, ts, sum(nr) over w as cr, sum(ns) over w as cs, lead(x) over w - x as dx from g join t using (col) window w as (partition by col order by x)),
e as (select col, sum(abs(cr / tr - cs / ts) * coalesce(dx, 0)) as distance, max(abs(cr / tr - cs / ts)) as ks from c where tr > 0 and ts > 0 group by 1),
q as (select col, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.75) as q75, stddev_samp(x) as sd, min(x) as lo, max(x) as hi from l where is_r = 1 group by 1),
s as (select col, case when lo = hi then 1.0 when q75 > q25 then q75 - q25 when sd > 0 then sd when hi > lo then hi - lo else 1.0 end as spread from q)"""


TV = """p as (select col, v, sum(is_r) as nr, sum(1 - is_r) as ns from k where v is not null group by 1, 2),
pt as (select col, sum(nr)::double as tr, sum(ns)::double as ts from p group by 1),
tv as (select col, 0.5 * sum(abs(nr / tr - ns / ts)) as distance from p join pt using (col) where tr > 0 and ts > 0 group by 1)"""

MODES = """b0 as (select col, is_r, min(x) as lo, max(x) as hi, least(30, count(distinct x)) as nb from l group by 1, 2),
b1 as (select l.col, l.is_r, case when hi > lo then least(floor((x - lo) * nb / (hi - lo)), nb - 1) else 0 end::int as bin, count(*) as n from l join b0 using (col, is_r) group by 1, 2, 3),
b2 as (select col, is_r, unnest(range(0, nb))::int as bin from b0),
b3 as (select b2.*, coalesce(n, 0) as n, max(coalesce(n, 0)) over (partition by col, is_r) as top from b2 left join b1 using (col, is_r, bin)),
b4 as (select *, case when n = lag(n) over (partition by col, is_r order by bin) then 0 else 1 end as new from b3),
b5 as (select *, sum(new) over (partition by col, is_r order by bin) as run from b4),
b6 as (select col, is_r, run, any_value(n) as n, any_value(top) as top from b5 group by 1, 2, 3),
b7 as (select *, lag(n) over w as pn, lead(n) over w as nn from b6 window w as (partition by col, is_r order by run)),
m0 as (select col, is_r, greatest(1, count(*) filter (where n > pn and n > nn and n >= 0.15 * top))::int as modes from b7 group by 1, 2),
m as (select col, max(modes) filter (where is_r = 1) as real_modes, max(modes) filter (where is_r = 0) as synth_modes from m0 group by 1)"""

#: Columns of the tables that the comparison queries use: numbers, dates (microseconds) and categories.
ORDERS = ({"o_totalprice": "o_totalprice"}, {"o_orderdate": "epoch_us(o_orderdate)"}, {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"})
LINEITEM = ({c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}, {"l_shipdate": "epoch_us(l_shipdate)"}, {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"})


def evaluate_sql(table: str, spec: tuple) -> str:
    numbers, dates, texts = spec
    names = ", ".join(f"'{c}'" for c in dates) or "''"
    return f"""with {ecdf_sql(long_sql(table, numbers | dates))}, {MODES},
k as ({long_sql(table, texts=texts)}), {TV}
select e.col as "column", case when e.col in ({names}) then 'datetime' else 'numeric' end as dtype, 'wasserstein' as metric, round(distance / case when e.col in ({names}) then 86400000000 else 1 end, 4) as distance, round(distance / spread, 4) as score, distance / spread < 0.2 as ok,
  case when e.col not in ({names}) then real_modes end as real_modes, case when e.col not in ({names}) then synth_modes end as synth_modes, case when e.col not in ({names}) and real_modes >= 2 and synth_modes < real_modes then real_modes || ' → ' || synth_modes end as modal_warning
from e join s using (col) left join m using (col)
union all select col, 'categorical', 'tv', round(distance, 4), round(distance, 4), distance < 0.2, null, null, null from tv"""


def pick(df: DataFrame, key: str, spec: tuple) -> tuple[DataFrame, DataFrame]:
    return halves(df.select(key, *(c for part in spec for c in part)), key)


def no_key(pair: tuple[DataFrame, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    return pair[0].drop(key), pair[1].drop(key)


# ---- comparison of columns ----


@query("evaluate_orders", evaluate_sql("orders", ORDERS))
def evaluate_orders(spark, d):
    return distances.evaluate(*no_key(pick(load(spark, d, "orders"), "o_orderkey", ORDERS), "o_orderkey"))


@query("evaluate_lineitem", evaluate_sql("lineitem", LINEITEM))
def evaluate_lineitem(spark, d):
    return distances.evaluate(*no_key(pick(load(spark, d, "lineitem"), "l_orderkey", LINEITEM), "l_orderkey"))


@query("tv_distance_priority", f"with k as ({long_sql('orders', texts={'o_orderpriority': 'o_orderpriority'})}), {TV} select round(distance, 6) as tv_distance from tv")
def tv_distance_priority(spark, d):
    r, s = halves(load(spark, d, "orders"), "o_orderkey")
    _, texts = distances.value_frames(r.select("o_orderpriority"), s.select("o_orderpriority"), {"o_orderpriority": "categorical"})
    return distances.total_variation(texts).select(F.round("distance", 6).alias("tv_distance"))


def _numeric(spark, d, table, kinds):
    r, s = halves(load(spark, d, table), KEYS[table])
    return distances.value_frames(r.select(*kinds), s.select(*kinds), kinds)[0]


@query("wasserstein_price", f"with {ecdf_sql(long_sql('orders', {'o_totalprice': 'o_totalprice'}))} select round(distance, 4) as distance, round(distance / spread, 4) as score from e join s using (col)")
def wasserstein_price(spark, d):
    return distances.numeric_distances(_numeric(spark, d, "orders", {"o_totalprice": "numeric"})).select(F.round("distance", 4).alias("distance"), F.round(F.col("distance") / F.col("spread"), 4).alias("score"))


@query("wasserstein_date", f"with {ecdf_sql(long_sql('orders', {'o_orderdate': 'epoch_us(o_orderdate)'}))} select round(distance / 86400000000, 4) as days, round(distance / spread, 4) as score from e join s using (col)")
def wasserstein_date(spark, d):
    return distances.numeric_distances(_numeric(spark, d, "orders", {"o_orderdate": "datetime"})).select(F.round(F.col("distance") / distances.DAY, 4).alias("days"), F.round(F.col("distance") / F.col("spread"), 4).alias("score"))


_LINE_NUMBERS = {c: "numeric" for c in LINEITEM[0]}


@query("spread_all_numeric", f"with {ecdf_sql(long_sql('lineitem', LINEITEM[0]))} select col as \"column\", round(spread, 6) as spread from s")
def spread_all_numeric(spark, d):
    return distances.numeric_distances(_numeric(spark, d, "lineitem", _LINE_NUMBERS)).select("column", F.round("spread", 6).alias("spread"))


def _modes_sql(table, numbers):
    return f"with {ecdf_sql(long_sql(table, numbers))}, {MODES} select col as \"column\", real_modes, synth_modes, real_modes >= 2 and synth_modes < real_modes as lost from m"


def _modes(spark, d, table, kinds):
    counts = _numeric(spark, d, table, kinds)
    out = distances.mode_counts(counts)
    return out.withColumn("lost", (F.col("real_modes") >= 2) & (F.col("synth_modes") < F.col("real_modes")))


@query("count_modes_value", _modes_sql("events", {"value": "value"}))
def count_modes_value(spark, d):
    return _modes(spark, d, "events", {"value": "numeric"})


@query("modal_loss_flags", _modes_sql("lineitem", LINEITEM[0]))
def modal_loss_flags(spark, d):
    return _modes(spark, d, "lineitem", _LINE_NUMBERS)


@query("ks_complement", f"with {ecdf_sql(long_sql('lineitem', LINEITEM[0] | LINEITEM[1]))} select col as \"column\", round(1 - ks, 6) as score from e")
def ks_complement(spark, d):
    return distances.numeric_distances(_numeric(spark, d, "lineitem", _LINE_NUMBERS | {"l_shipdate": "datetime"})).select("column", F.round(1 - F.col("ks"), 6).alias("score"))


def _pairs_sql(table, names):
    key = KEYS[table]
    return " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) filter (where {key} % 2 = 0) as rc, corr({a}, {b}) filter (where {key} % 2 = 1) as sc from {table}" for i, a in enumerate(names) for b in names[i + 1 :])


_PAIR_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_similarity", f"select col_a, col_b, round(1 - abs(rc - sc) / 2, 6) as score from ({_pairs_sql('lineitem', _PAIR_NAMES)}) where rc is not null and sc is not null")
def correlation_similarity(spark, d):
    r, s = halves(load(spark, d, "lineitem"), "l_orderkey")
    return distances.correlation_similarity(r, s, _PAIR_NAMES).withColumn("score", F.round("score", 6))


@query("contingency_similarity", "with k as (select (l_orderkey % 2 = 0)::int as is_r, 'x' as col, l_returnflag || '|' || l_linestatus as v from lineitem), " + TV + " select 'l_returnflag' as col_a, 'l_linestatus' as col_b, round(1 - distance, 6) as score from tv")
def contingency_similarity(spark, d):
    r, s = halves(load(spark, d, "lineitem"), "l_orderkey")
    return distances.contingency_similarity(r, s, ["l_returnflag", "l_linestatus"]).withColumn("score", F.round("score", 6))


@query("quality_overall", f"""with {ecdf_sql(long_sql('lineitem', LINEITEM[0] | LINEITEM[1]))}, k as ({long_sql('lineitem', texts=LINEITEM[2])} union all select (l_orderkey % 2 = 0)::int, 'joint', l_returnflag || '|' || l_linestatus from lineitem), {TV},
a as (select 'Column Shapes' as property, 1 - ks as score from e union all select 'Column Shapes', 1 - distance from tv where col <> 'joint' union all select 'Column Pair Trends', 1 - distance from tv where col = 'joint' union all select 'Column Pair Trends', 1 - abs(rc - sc) / 2 from ({_pairs_sql('lineitem', _PAIR_NAMES)}) where rc is not null and sc is not null),
o as (select property, avg(score) as score from a group by 1)
select property, round(score, 4) as score from o union all select 'Overall', round(avg(score), 4) from o""")
def quality_overall(spark, d):
    r, s = no_key(pick(load(spark, d, "lineitem"), "l_orderkey", LINEITEM), "l_orderkey")
    return distances.quality(r, s, _PAIR_NAMES, ["l_returnflag", "l_linestatus"]).withColumn("score", F.round("score", 4))


#: Orders against prices with a turned relation: gives the pair rules something to flag.
_TURNED = "select l_orderkey, l_quantity, l_discount, l_tax, l_extendedprice + case when l_orderkey % 2 = 0 then 1000 else -1000 end * l_quantity as price from lineitem"


def _turned(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 2 == 0, 1000).otherwise(-1000) * F.col("l_quantity")).alias("price"))
    r, s = halves(df, "l_orderkey")
    return distances.evaluate_pairs(r, s, ["l_quantity", "l_discount", "l_tax", "price"])


_FLAGGED = f"with x as ({_TURNED}), p as ({_pairs_sql('lineitem', ['l_quantity', 'l_discount', 'l_tax', 'price']).replace('from lineitem', 'from x')}), f as (select col_a, col_b, round(rc, 3) as real_corr, round(sc, 3) as synth_corr, round(abs(rc - sc), 3) as delta from p where abs(rc - sc) > 0.1), v as (select *, case when (real_corr * synth_corr < 0 and abs(real_corr) >= 0.4) or delta > 0.5 then 'hoog' when abs(real_corr) >= 0.2 then 'matig' else 'laag' end as severity from f)"


@query("pairs_delta", _FLAGGED + " select * from v")
def pairs_delta(spark, d):
    return _turned(spark, d)


@query("correlation_risk", _FLAGGED + " select count(*) as n_pairs, case when count(*) filter (where severity = 'hoog') > 0 then 'hoog' when count(*) filter (where severity = 'matig') > 0 then 'matig' else 'laag' end as risk from v")
def correlation_risk(spark, d):
    return distances.correlation_risk(_turned(spark, d))


# ---- profiles ----

_PROFILE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _profile_sql(table, names, numeric):
    return " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_unique, {f'min({c})::double' if c in numeric else 'null::double'} as low, {f'max({c})::double' if c in numeric else 'null::double'} as high, round(1 - count({c}) / count(*), 6) as null_fraction from {table}" for c in names)


@query("column_profile", _profile_sql("orders", _PROFILE, {"o_orderkey", "o_custkey", "o_totalprice"}))
def column_profile(spark, d):
    return profile.column_profile(load(spark, d, "orders"), _PROFILE).select("column", "n_rows", "n_null", "n_unique", "low", "high", F.round("null_fraction", 6).alias("null_fraction"))


@query("null_fraction", " union all ".join(f"select '{c}' as \"column\", round(count(*) filter (where {c} is null) / count(*), 6) as null_fraction, count(*) filter (where {c} is null) / count(*) > 0.3 as warn from (select case when event_id % 5 < 2 then null else value end as value, event_type from events)" for c in ("value", "event_type")))
def null_fraction(spark, d):
    df = load(spark, d, "events").select(F.when(F.col("event_id") % 5 >= 2, F.col("value")).alias("value"), "event_type")
    return profile.column_profile(df).select("column", F.round("null_fraction", 6).alias("null_fraction"), (F.col("null_fraction") > 0.3).alias("warn"))


@query("value_counts", "select event_type as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events where event_type is not null group by 1")
def value_counts(spark, d):
    return profile.value_counts(load(spark, d, "events"), "event_type").withColumn("share", F.round("share", 6))


_SKEW = "with l as (select 'value' as col, value as x from events union all select 'zeros', case when event_id % 10 < 9 then 0 else value end from events union all select 'kind', length(event_type)::double from events), c as (select col, x, count(*) as n from l where x is not null group by 1, 2), s as (select col, count(distinct x) as n_unique, skewness(x) as g1 from l group by 1), m as (select col, max(n) / sum(n) as mode_share from c group by 1)"


def _skew_table(spark, d):
    return load(spark, d, "events").select("value", F.when(F.col("event_id") % 10 < 9, 0.0).otherwise(F.col("value")).alias("zeros"), F.length("event_type").cast("double").alias("kind"))


_SKEWED = "n_unique >= 20 and (abs(coalesce(g1, 0)) >= 2.0 or mode_share >= 0.5)"


@query("is_skewed", _SKEW + f" select col as \"column\", n_unique, round(g1, 6) as g1, round(mode_share, 6) as mode_share, {_SKEWED} as skewed from s join m using (col)")
def is_skewed(spark, d):
    return profile.skewness(_skew_table(spark, d), ["value", "zeros", "kind"]).withColumns({"g1": F.round("g1", 6), "mode_share": F.round("mode_share", 6)})


@query("recommend_distributions", _SKEW + f" select col as \"column\", 'gaussian_kde' as distribution from s join m using (col) where {_SKEWED}")
def recommend_distributions(spark, d):
    return profile.recommend_distributions(_skew_table(spark, d), ["value", "zeros", "kind"])


@query("quantiles", " union all ".join(f"select '{c}' as \"column\", {p}::double as p, round(quantile_cont({c}, {p}), 6) as value from lineitem" for c in _PAIR_NAMES for p in (0.25, 0.5, 0.75)))
def quantiles(spark, d):
    return profile.quantiles(load(spark, d, "lineitem"), _PAIR_NAMES, [0.25, 0.5, 0.75]).withColumn("value", F.round("value", 6))


_HINTED = "select o_orderkey, (o_orderkey % 4)::bigint as small_code, 1000 + (o_orderkey % 900)::bigint as four_digits, strftime(o_orderdate, '%d-%m-%Y') as day, case when o_orderkey % 3 > 0 then null else o_totalprice end as gaps, o_totalprice as price from orders"


@query("column_hints", f"""with x as ({_HINTED}), n as (select count(*) as n from x),
p as (select 'small_code' as c, count(distinct small_code) as u, max(small_code) as hi, min(small_code) as lo from x union all select 'four_digits', count(distinct four_digits), max(four_digits), min(four_digits) from x)
select 'four_digits' as "column", 'numerical' as detected_sdtype, 'categorical' as suggested_sdtype, 0.7::double as confidence, 'four_digits' as rule from p where c = 'four_digits' and lo >= 1000 and hi <= 9999
union all select 'day', 'categorical', 'datetime', 0.8, 'date' union all select 'gaps', 'numerical', 'numerical', 0.0, 'missing' from n where (select count(*) from x where gaps is null) > 0.3 * n""")
def column_hints(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("small_code"), (1000 + F.col("o_orderkey") % 900).alias("four_digits"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("gaps"), F.col("o_totalprice").alias("price"))
    return profile.column_hints(df, ["small_code", "four_digits", "day", "gaps", "price"], order="o_orderkey")


@query("detect_date_format", "select * from (values ('compact', '%Y%m%d'), ('iso', '%Y-%m-%d'), ('dutch', '%d-%m-%Y'), ('o_orderstatus', null)) t(\"column\", format)")
def detect_date_format(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("dutch"), "o_orderstatus")
    return profile.date_formats(df, ["compact", "iso", "dutch", "o_orderstatus"], "o_orderkey")


def _sequence_sql(table, numeric, texts, key_hint):
    cols = " union all ".join(f"select '{c}' as c, {i} as pos, {str(c in numeric).lower()} as num, count(distinct {c}) as u, count(*) as n from {table}" for i, c in enumerate([*numeric, *texts]))
    hint = lambda names: "case when " + " or ".join(f"contains(lower(c), '{h}')" for h in names) + " then 0 else 1 end"
    return f"with p as ({cols}), i as (select c as seq_index from p where num order by {hint(profile.INDEX_NAMES)}, u, pos limit 1), k as (select c as seq_key from p, i where u > 1 and u < n and n / u >= 2 and c <> seq_index order by {hint(profile.KEY_NAMES)}, -u, pos limit 1) select true as is_longitudinal, seq_key, seq_index from i, k"


@query("infer_sequence_columns", _sequence_sql("conversations", ["conv_id", "turn"], ["role"], 0))
def infer_sequence_columns(spark, d):
    return profile.sequence_columns(load(spark, d, "conversations"), ["conv_id", "turn", "role"])


@query("high_cardinality_columns", " union all ".join(f"select '{c}' as \"column\", round(count(distinct {c}) / count(*), 6) as ratio, count(distinct {c}) / count(*) > 0.5 as excluded from customer" for c in ("c_name", "c_mktsegment", "c_nationkey")))
def high_cardinality_columns(spark, d):
    return profile.high_cardinality(load(spark, d, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]).withColumn("ratio", F.round("ratio", 6))


@query("mode_value", "select 'event_type' as \"column\", event_type as value from (select event_type, count(*) as n from events group by 1) order by n desc, event_type limit 1")
def mode_value(spark, d):
    return profile.mode_value(load(spark, d, "events"), ["event_type"])


# ---- sequences ----

_PAIRS = "p as (select (user_id % 2 = 0)::int as is_r, event_type as f, lead(event_type) over w as t, lead(1) over w as more from events where user_id is not null window w as (partition by user_id order by ts nulls last, event_id))"


@query("transition_pairs", f"with {_PAIRS} select f, t, count(*) as n from p where more is not null group by 1, 2")
def transition_pairs(spark, d):
    return sequences.transition_pairs(load(spark, d, "events"), "user_id", "ts", "event_type", "event_id").groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))


@query("transition_matrix", f"with {_PAIRS} select f, t, count(*) as n, round(count(*) / sum(count(*)) over (partition by f), 6) as p from p where more is not null and f is not null and t is not null group by 1, 2")
def transition_matrix(spark, d):
    return sequences.transition_matrix(load(spark, d, "events"), "user_id", "ts", "event_type", "event_id").withColumn("p", F.round("p", 6))


_MATRIX = _PAIRS + ", n as (select is_r, f, t, count(*) as n from p where more is not null and f is not null and t is not null group by 1, 2, 3), m as (select *, n / sum(n) over (partition by is_r, f) as pr from n)"


@query("transition_matrices_aligned", f"with {_MATRIX}, st as (select f as x from m union select t from m) select a.x as f, b.x as t, round(coalesce(r.pr, 0), 6) as real_p, round(coalesce(s.pr, 0), 6) as synth_p from st a cross join st b left join m r on r.is_r = 1 and r.f = a.x and r.t = b.x left join m s on s.is_r = 0 and s.f = a.x and s.t = b.x")
def transition_matrices_aligned(spark, d):
    r, s = halves(load(spark, d, "events"), "user_id")
    return sequences.aligned_matrices(r, s, "user_id", "ts", "event_type", "event_id").withColumns({"real_p": F.round("real_p", 6), "synth_p": F.round("synth_p", 6)})


_DISTANCE = _MATRIX + ", j as (select coalesce(r.f, s.f) as f, 0.5 * sum(abs(coalesce(r.pr, 0) - coalesce(s.pr, 0))) as tv, sum(coalesce(r.pr, 0)) as own from (select * from m where is_r = 1) r full join (select * from m where is_r = 0) s on r.f = s.f and r.t = s.t group by 1), w as (select f, count(*) as k from p where is_r = 1 and more is not null and f is not null group by 1), ww as (select f, k / sum(k) over () as share from w), td as (select sum(tv * share) as distance from j join ww using (f) where own > 0)"


@query("transition_distance", f"with {_DISTANCE} select round(distance, 6) as distance from td")
def transition_distance(spark, d):
    r, s = halves(load(spark, d, "events"), "user_id")
    return sequences.transition_distance(r, s, "user_id", "ts", "event_type", "event_id").select(F.round("distance", 6).alias("distance"))


_AUTO = "al as (select (user_id % 2 = 0)::int as is_r, user_id as k, value as y, lag(value) over (partition by user_id order by ts nulls last, event_id) as x from events where user_id is not null), ap as (select is_r, k, stddev_samp(y) as sd, count(*) as n, stddev_pop(case when y is not null then x end) as sx, stddev_pop(case when x is not null then y end) as sy, covar_pop(y, x) as c from al group by 1, 2), ac as (select is_r, avg(case when sx > 0 and sy > 0 then c / (sx * sy) end) as r from ap where n >= 2 and sd > 0 group by 1)"


@query("mean_autocorr", f"with {_AUTO} select case when is_r = 1 then 'r' else 's' end as src, round(r, 6) as r from ac")
def mean_autocorr(spark, d):
    r, s = halves(load(spark, d, "events"), "user_id")
    return sequences.mean_autocorrelation(distances.both(r, s), "user_id", "ts", "value", "event_id").withColumn("r", F.round("r", 6))


@query("sequence_lengths", "select n, count(*) as sequences from (select user_id, count(*) as n from events where user_id is not null group by 1) group by 1")
def sequence_lengths(spark, d):
    return sequences.lengths(load(spark, d, "events"), "user_id").groupBy("n").agg(F.count(F.lit(1)).alias("sequences"))


_LENGTH = ecdf_sql("select (user_id % 2 = 0)::int as is_r, 'length' as col, count(*)::double as x from events where user_id is not null group by user_id")


@query("length_distance", f"with {_LENGTH} select round(distance / spread, 6) as distance from e join s using (col)")
def length_distance(spark, d):
    r, s = halves(load(spark, d, "events"), "user_id")
    return sequences.length_distance(r, s, "user_id").select(F.round("distance", 6).alias("distance"))


_SEQ_EVAL = f"with {_LENGTH}, {_DISTANCE.replace(' m as', ' tm as').replace('from m ', 'from tm ')}, {_AUTO}, ev as (select 'event_type' as \"column\", 'transition' as kind, distance as sc from td union all select 'value', 'autocorrelation', abs(max(r) filter (where is_r = 1) - max(r) filter (where is_r = 0)) from ac union all select null, 'length', distance / spread from e join s using (col)), fi as (select \"column\", kind, round(sc, 4) as score, sc < 0.2 as ok from ev where sc is not null)"


def _sequential(spark, d):
    r, s = halves(load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), "user_id")
    return sequences.evaluate_sequential(r, s, "user_id", "ts", ["event_type", "value"], "event_id")


@query("evaluate_sequential", _SEQ_EVAL + " select * from fi")
def evaluate_sequential(spark, d):
    return _sequential(spark, d)


def _ladder_sql(source: str) -> str:
    return f"select count(*) as n, count(*) filter (where not ok) as n_failed, coalesce(max(score), 0) as max_score, case when count(*) filter (where not ok) = 0 and coalesce(max(score), 0) < 0.1 then 'Uitstekend' when count(*) filter (where not ok) = 0 then 'Goed' when count(*) filter (where not ok) <= greatest(1, count(*) // 3) then 'Matig' else 'Let op' end as label, case when count(*) filter (where not ok) = 0 then 'laag' when count(*) filter (where not ok) <= greatest(1, count(*) // 3) then 'matig' else 'hoog' end as risk from {source}"


@query("sequential_verdict", _SEQ_EVAL + " " + _ladder_sql("fi"))
def sequential_verdict(spark, d):
    return verdicts.rollup(_sequential(spark, d)).select("n", "n_failed", "max_score", "label", "risk")


_SHIFTED = "select o_orderstatus, o_orderkey, o_totalprice * case when o_orderkey % 2 = 1 then 3 else 1 end as o_totalprice, case when o_orderkey % 2 = 1 then '1-URGENT' else o_orderpriority end as o_orderpriority from orders"
_SHIFT_SPEC = ({"o_totalprice": "o_totalprice"}, {}, {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"})


def _shifted(spark, d):
    odd = F.col("o_orderkey") % 2 == 1
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(odd, 3 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(odd, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return no_key(halves(df, "o_orderkey"), "o_orderkey")


_SHIFT_EVAL = "with sh as (" + _SHIFTED + "), fi as (" + evaluate_sql("orders", _SHIFT_SPEC).replace("from orders", "from sh") + ")"


@query("worst_component", _SHIFT_EVAL + " select metric as kind, \"column\", score, 0.2::double as threshold from fi where not ok order by score desc, metric desc, \"column\" desc limit 1")
def worst_component(spark, d):
    return verdicts.worst_component(distances.evaluate(*_shifted(spark, d)).withColumnRenamed("metric", "kind"))


@query("score_verdict", _SHIFT_EVAL + " " + _ladder_sql("fi"))
def score_verdict(spark, d):
    return verdicts.rollup(distances.evaluate(*_shifted(spark, d))).select("n", "n_failed", "max_score", "label", "risk")


@query("top8_deviating", evaluate_sql("lineitem", LINEITEM).replace("with ", "with fi as (with ", 1) + ") select \"column\", coalesce(score, 0) as score from fi order by 2 desc, 1 limit 8")
def top8_deviating(spark, d):
    return verdicts.top_deviating(distances.evaluate(*no_key(pick(load(spark, d, "lineitem"), "l_orderkey", LINEITEM), "l_orderkey")))


_RISKS = ["laag", "matig", "hoog", "onbekend"]


@query("usability_verdict", "with r as (select unnest(['laag', 'matig', 'hoog', 'onbekend']) as x) select a.x as distribution, b.x as privacy, c.x as correlation, case when b.x = 'hoog' or (a.x = 'hoog' and c.x = 'hoog') then 'hoog' when a.x <> 'laag' or b.x <> 'laag' or c.x <> 'laag' then 'matig' else 'laag' end as verdict from r a, r b, r c")
def usability_verdict(spark, d):
    one = spark.createDataFrame([(a, b, c) for a in _RISKS for b in _RISKS for c in _RISKS], "distribution string, privacy string, correlation string")
    return one.withColumn("verdict", verdicts.usability(F.col("distribution"), F.col("privacy"), F.col("correlation")))


@query("mean_trajectory", "select l_linenumber as step, round(avg(l_extendedprice), 4) as mean from lineitem where l_linenumber is not null group by 1")
def mean_trajectory(spark, d):
    return sequences.mean_trajectory(load(spark, d, "lineitem"), "l_linenumber", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("state_distribution", "select turn as step, role as state, round(count(*) / sum(count(*)) over (partition by turn), 6) as share from conversations where turn is not null and role is not null group by 1, 2")
def state_distribution(spark, d):
    return sequences.state_distribution(load(spark, d, "conversations"), "turn", "role").withColumn("share", F.round("share", 6))


@query("terminal_states", "with p as (select case when last then 'end' else role end as role, lead(1) over (partition by conv_id order by turn) as more from (select *, turn = max(turn) over (partition by conv_id) as last from conversations)) select role as state from p where role is not null group by 1 having max(more) is null")
def terminal_states(spark, d):
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    df = load(spark, d, "conversations").withColumn("last", last).select("conv_id", "turn", F.when(F.col("last"), "end").otherwise(F.col("role")).alias("role"))
    return sequences.terminal_states(df, "conv_id", "turn", "role")


_LEVELS = [1, 2, 3, 4, 5, 6, 7]


@query("to_wide", "select l_orderkey, " + ", ".join(f"max(l_quantity) filter (where l_linenumber = {i}) as l_quantity__t{i}, max(l_returnflag) filter (where l_linenumber = {i}) as l_returnflag__t{i}" for i in _LEVELS) + ", count(*) as __seq_len__ from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_returnflag) as l_returnflag from lineitem group by 1, 2) group by 1")
def to_wide(spark, d):
    df = sequences.dealt(load(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    return sequences.to_wide(df, "l_orderkey", "l_linenumber", ["l_quantity", "l_returnflag"], _LEVELS)


_STEPS = "with g as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2), k as (select l_orderkey, count(*) as n from g group by 1)"


@query("wide_to_long", _STEPS + " select l_orderkey, i::int as pos, q as l_quantity from (select l_orderkey, unnest(range(1, least(n, 7) + 1)) as i from k) left join g using (l_orderkey) where l_linenumber = i or l_linenumber is null union all select x.l_orderkey, x.i::int, null from (select l_orderkey, unnest(range(1, least(n, 7) + 1)) as i from k) x where not exists (select 1 from g where g.l_orderkey = x.l_orderkey and g.l_linenumber = x.i)")
def wide_to_long(spark, d):
    df = sequences.dealt(load(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    wide = sequences.to_wide(df, "l_orderkey", "l_linenumber", ["l_quantity"], _LEVELS)
    return sequences.to_long(wide, "l_orderkey", ["l_quantity"], len(_LEVELS), F.col("__seq_len__"))


@query("forward_fill", "select event_id, coalesce(last_value(v ignore nulls) over (partition by user_id order by ts nulls last, event_id rows between unbounded preceding and current row), -1) as value from (select event_id, user_id, ts, case when event_id % 3 = 0 then value end as v from events)")
def forward_fill(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return sequences.forward_fill(df, "user_id", "ts", {"value": F.lit(-1.0)}, "event_id").select("event_id", "value")


@query("seq_truncate", "with p as (select conv_id, turn, case when role = 'user' and turn >= 2 then 'stop' else role end as role from conversations), e as (select *, min(case when role = 'stop' then turn end) over (partition by conv_id) as stop from p) select conv_id, turn, role from e where stop is null or turn <= stop")
def seq_truncate(spark, d):
    df = load(spark, d, "conversations").select("conv_id", "turn", F.when((F.col("role") == "user") & (F.col("turn") >= 2), "stop").otherwise(F.col("role")).alias("role"))
    return sequences.until_terminal(df, "conv_id", "turn", "role", ["stop"])


# ---- privacy, samples, constraints ----


@query("minmax_scale", "select c_custkey, round((c_acctbal - lo) / w, 6) as c_acctbal, round((c_nationkey - lo2) / w2, 6) as c_nationkey from customer, (select min(c_acctbal) as lo, case when max(c_acctbal) = min(c_acctbal) then 1 else max(c_acctbal) - min(c_acctbal) end as w, min(c_nationkey) as lo2, case when max(c_nationkey) = min(c_nationkey) then 1 else max(c_nationkey) - min(c_nationkey) end as w2 from customer where c_custkey % 2 = 0)")
def minmax_scale(spark, d):
    df = load(spark, d, "customer")
    limits = privacy.minmax(df.where("c_custkey % 2 = 0"), ["c_acctbal", "c_nationkey"])
    return privacy.scaled(df, limits, ["c_acctbal", "c_nationkey"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_nationkey", 6).alias("c_nationkey"))


@query("onehot_distance", "with kn as (select list(distinct p_brand) as b, list(distinct p_type) as t from part where p_partkey % 2 = 0) select a.p_partkey as id, o.p_partkey as other_id, (2 * ((a.p_brand <> o.p_brand)::int + (a.p_type <> o.p_type)::int) - (not list_contains(b, a.p_brand))::int - (not list_contains(t, a.p_type))::int)::double as square from part a, part o, kn where a.p_partkey % 20 = 0 and o.p_partkey % 2 = 1")
def onehot_distance(spark, d):
    """A stated query set, the ids divisible by 20, against all odd parts."""
    df = load(spark, d, "part")
    return privacy.one_hot_distances(df.where("p_partkey % 20 = 0"), df.where("p_partkey % 2 = 1"), ["p_brand", "p_type"], df.where("p_partkey % 2 = 0"), "p_partkey")


def _split_sql(points: str, real: str, synth: str, square: str) -> str:
    """Privacy figures: caps and splits by md5 order."""
    return f"""with rr as (select *, md5(id || '|42') as o from ({real})), ss as (select *, md5(id || '|42') as o from ({synth})),
r as (select * from rr order by o, id limit 2000), sy as (select * from ss order by o, id limit 2000),
sp as (select *, row_number() over (order by o, id) <= greatest(10, (select count(*) from r) // 5) as holdout from r),
{points}
dd as (select 's' as src, a.id, sqrt({square}) as d from sy a, sp b where not b.holdout union all select 'h', a.id, sqrt({re.sub(r' - .not list_contains.*', '', square)}) from sp a, sp b where a.holdout and not b.holdout),
rk as (select src, id, d, row_number() over (partition by src, id order by d) as k from dd),
n2 as (select src, id, max(d) filter (where k = 1) as d1, max(d) filter (where k = 2) as d2 from rk where k <= 2 group by 1, 2),
f as (select median(d1) filter (where src = 's') as ms, median(d1) filter (where src = 'h') as mh, median(case when d2 is null then 1 when d2 > 0 then d1 / d2 else 1 end) filter (where src = 's') as nndr from n2),
z as (select *, case when mh > 0 then ms / mh else 1 end as dcr from f)
select true as available, round(ms, 4) as dcr_synth_median, round(mh, 4) as dcr_holdout_median, round(dcr, 3) as dcr_ratio, round(nndr, 3) as nndr_median, case when dcr >= 0.9 then 'laag' when dcr >= 0.7 then 'matig' else 'hoog' end as risk_level,"""


@query("privacy_customer", _split_sql("kn as (select list(distinct c_mktsegment) as known from rr),", "select c_custkey as id, (c_acctbal - lo) / w as x, (c_nationkey - lo2) / w2 as y, c_mktsegment from customer, lim where c_custkey % 2 = 0", "select c_custkey as id, (c_acctbal - lo) / w as x, (c_nationkey - lo2) / w2 as y, c_mktsegment from customer, lim where c_custkey % 2 = 1", "power(a.x - b.x, 2) + power(a.y - b.y, 2) + 2 * (a.c_mktsegment <> b.c_mktsegment)::int - (not list_contains((select known from kn), a.c_mktsegment))::int").replace("with rr", "with lim as (select min(c_acctbal) as lo, max(c_acctbal) - min(c_acctbal) as w, min(c_nationkey) as lo2, max(c_nationkey) - min(c_nationkey) as w2 from customer where c_custkey % 2 = 0), rr", 1) + " 3 as n_cols from z")
def privacy_customer(spark, d):
    r, s = halves(load(spark, d, "customer"), "c_custkey")
    return privacy.evaluate_privacy(r, s, "c_custkey", ["c_acctbal", "c_nationkey"], ["c_mktsegment"]).drop("excluded_cols", "reason")


@query("privacy_columns", """with s as (select *, c_custkey % 2 = 0 as is_r from customer), u as (select unnest(['c_name', 'c_mktsegment']) as "column", unnest([count(distinct c_name), count(distinct c_mktsegment)]) / count(*) as ratio from s where is_r)
select "column", case when ratio > 0.5 then 'excluded' else 'categorical' end as use from u union all select column_name, 'numeric' from (describe customer) where column_type in ('BIGINT', 'INTEGER', 'DOUBLE') and column_name <> 'c_custkey'""")
def privacy_columns(spark, d):
    r, s = halves(load(spark, d, "customer"), "c_custkey")
    found = dict(zip(("numeric", "categorical", "excluded"), privacy.privacy_columns(r, s, "c_custkey"), strict=True))
    return spark.createDataFrame([(c, use) for use, names in found.items() for c in names], "column string, use string")


_DIMS = 64
_EMB = ", ".join(f"(embedding[{i}]::double - lo[{i}]) / w[{i}]" for i in range(1, _DIMS + 1))
_EMB_LIMITS = "em as (select [" + ", ".join(f"min(embedding[{i}]::double)" for i in range(1, _DIMS + 1)) + "] as lo, [" + ", ".join(f"max(embedding[{i}]::double) - min(embedding[{i}]::double)" for i in range(1, _DIMS + 1)) + "] as w from embeddings where vec_id % 2 = 0)"


@query("dcr_nndr_embeddings", _split_sql("", f"select vec_id as id, [{_EMB}] as e from embeddings, em where vec_id % 2 = 0", f"select vec_id as id, [{_EMB}] as e from embeddings, em where vec_id % 2 = 1", "power(list_distance(a.e, b.e), 2)").replace("with rr", f"with {_EMB_LIMITS}, rr", 1) + f" {_DIMS} as n_cols from z")
def dcr_nndr_embeddings(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(_DIMS)))
    r, s = halves(df, "vec_id")
    return privacy.evaluate_privacy(r, s, "vec_id", [f"e{i}" for i in range(_DIMS)], []).drop("excluded_cols", "reason")


@query("nearest_orders", """with lim as (select min(o_totalprice) as lo, max(o_totalprice) - min(o_totalprice) as w from orders where o_orderkey % 2 = 0),
p as (select o_orderkey, (o_totalprice - lo) / w as x, o_orderpriority as c, o_orderstatus as e from orders, lim),
d as (select a.o_orderkey as id, sqrt(power(a.x - b.x, 2) + 2 * (a.c <> b.c)::int + 2 * (a.e <> b.e)::int) as d from p a, p b where a.o_orderkey % 2 = 1 and b.o_orderkey % 2 = 0)
select id, round(list_min(m), 6) as d1, round(m[2], 6) as d2 from (select id, min(d, 2) as m from d group by 1)""")
def nearest_orders(spark, d):
    """Every odd order's two nearest even ones, over the whole table."""
    r, s = halves(load(spark, d, "orders"), "o_orderkey")
    return privacy.nearest_records(r, s, "o_orderkey", ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]).select("id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("subsample_cap", "select o_orderkey from (select o_orderkey, md5(o_orderkey || '|42') as o from orders order by 2, 1 limit 5000)")
def subsample_cap(spark, d):
    return privacy.capped(load(spark, d, "orders"), "o_orderkey", 5000).select("o_orderkey")


@query("train_holdout_split", "with r as (select c_custkey, md5(c_custkey || '|42') as o from customer order by 2, 1 limit 2000) select c_custkey, row_number() over (order by o, c_custkey) <= greatest(10, (select count(*) from r) // 5) as holdout from r")
def train_holdout_split(spark, d):
    return privacy.holdout_split(privacy.capped(load(spark, d, "customer"), "c_custkey"), "c_custkey").select("c_custkey", "holdout")


@query("fixed_combinations", "select p_partkey from part a where p_partkey % 2 = 1 and not exists (select 1 from part b where b.p_partkey % 2 = 0 and b.p_brand = a.p_brand and b.p_size = a.p_size)")
def fixed_combinations(spark, d):
    r, s = halves(load(spark, d, "part"), "p_partkey")
    return privacy.unseen_combinations(r, s, ["p_brand", "p_size"]).select("p_partkey")


@query("inequality_violations", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 1000 * l_discount")
def inequality_violations(spark, d):
    df = load(spark, d, "lineitem").withColumn("most", 1000 * F.col("l_discount"))
    return privacy.inequality_violations(df, "l_quantity", "most").select("l_orderkey", "l_linenumber", "l_quantity")


# ---- plot data ----


@query("plot_histogram", f"with {ecdf_sql(long_sql('orders', {'o_totalprice': 'o_totalprice'}))}, {MODES} select case when is_r = 1 then 'real' else 'synth' end as src, bin, n from b3")
def plot_histogram(spark, d):
    counts = _numeric(spark, d, "orders", {"o_totalprice": "numeric"})
    h = distances.histograms(counts)
    return h.select(F.when(F.col("src") == "r", "real").otherwise("synth").alias("src"), F.posexplode("histogram").alias("bin", "n"))


@query("plot_category_bars", "with a as (select o_orderpriority as category, count(*) filter (where o_orderkey % 2 = 0) as r, count(*) filter (where o_orderkey % 2 = 1) as s from orders where o_orderpriority is not null group by 1) select category, round(r / sum(r) over (), 6) as real_share, round(s / sum(s) over (), 6) as synth_share from a")
def plot_category_bars(spark, d):
    r, s = (profile.value_counts(df, "o_orderpriority") for df in halves(load(spark, d, "orders"), "o_orderkey"))
    out = r.select(F.col("value").cast("string").alias("category"), F.col("share").alias("a")).join(s.select(F.col("value").cast("string").alias("category"), F.col("share").alias("b")), "category", "full_outer")
    return out.select("category", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("real_share"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("synth_share"))


@query("plot_trajectory", "select l_linenumber as step, 'real' as src, round(avg(l_quantity), 4) as mean from lineitem where l_orderkey % 2 = 0 group by 1 union all select l_linenumber, 'synth', round(avg(l_quantity), 4) from lineitem where l_orderkey % 2 = 1 group by 1")
def plot_trajectory(spark, d):
    r, s = (sequences.mean_trajectory(df, "l_linenumber", "l_quantity") for df in halves(load(spark, d, "lineitem"), "l_orderkey"))
    wide = r.withColumnRenamed("mean", "real").join(s.withColumnRenamed("mean", "synth"), "step", "full_outer")
    return wide.unpivot("step", ["real", "synth"], "src", "mean").where("mean is not null").withColumn("mean", F.round("mean", 4))


@query("plot_states", "select turn as step, role as state, case when conv_id % 2 = 0 then 'real' else 'synth' end as src, round(count(*) / sum(count(*)) over (partition by turn, conv_id % 2), 6) as share from conversations group by turn, role, conv_id % 2")
def plot_states(spark, d):
    r, s = (sequences.state_distribution(df, "turn", "role") for df in halves(load(spark, d, "conversations"), "conv_id"))
    return r.withColumn("src", F.lit("real")).unionByName(s.withColumn("src", F.lit("synth"))).withColumn("share", F.round("share", 6))


# ---- verdicts and gates ----

_BASE = [("a", 0.10, 0.30, 1, 0.80), ("b", 0.05, 0.20, 0, 0.90), ("gone", 0.1, 0.1, 0, 0.9), ("failed", 0.1, 0.1, 0, 0.9)]
_NOW = [("a", 0.13, 0.30, 1, 0.60), ("b", 0.05, 0.22, 0, 0.90), ("new", 9.0, 9.0, 9, 0.1), ("failed", None, None, None, None)]
_GATE = "dataset string, mean_score double, worst_score double, cols_failed long, sdmetrics_overall double"


@query("regression_check", "select * from (values ('a', 'mean_score', 0.10::double, 0.13::double), ('a', 'sdmetrics_overall', 0.80, 0.60), ('failed', 'run failed', null, null)) t(dataset, metric, baseline, \"current\")")
def regression_check(spark, d):
    return verdicts.regressions(spark.createDataFrame(_BASE, _GATE), spark.createDataFrame(_NOW, _GATE))


@query("usage_recommendation", _SHIFT_EVAL + ", v as (" + _ladder_sql("fi") + ") select max_score, n_failed, n, 'laag' as privacy_risk, 'matig' as correlation_risk, case when n_failed = 0 and max_score < 0.1 then 'any' when risk = 'laag' then 'careful' when risk = 'matig' then 'explore' else 'test' end as use, 'correlations_matig' as check from v")
def usage_recommendation(spark, d):
    found = verdicts.rollup(distances.evaluate(*_shifted(spark, d)))
    return verdicts.usage_recommendation(found.select("max_score", "n_failed", "n", F.lit("laag").alias("privacy_risk"), F.lit("matig").alias("correlation_risk")))


@query("temporal_advice", _SEQ_EVAL + ", v as (" + _ladder_sql("fi") + ") select risk, case risk when 'laag' then 'longitudinal' when 'matig' then 'check_transitions_and_lengths' else 'no_longitudinal' end as use, null::varchar as reason from v")
def temporal_advice(spark, d):
    return verdicts.temporal_advice(_sequential(spark, d))


@query("scorecard", _SHIFT_EVAL + ", lv as (" + _ladder_sql("fi") + "), " + _FLAGGED.removeprefix("with ") + ", cr as (select case when count(*) filter (where severity = 'hoog') > 0 then 'hoog' when count(*) filter (where severity = 'matig') > 0 then 'matig' else 'laag' end as risk from v) select 'distribution' as part, label, risk from lv union all select 'coherence', case risk when 'laag' then 'Goed' when 'matig' then 'Afwijkingen' else 'Omgeklapt' end, risk from cr")
def scorecard(spark, d):
    return verdicts.distribution_verdict(distances.evaluate(*_shifted(spark, d))).unionByName(verdicts.coherence_verdict(distances.correlation_risk(_turned(spark, d))))


_MIXED = "with lim as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_orderkey % 2 = 0), k as (select (l_orderkey % 2 = 0)::int as is_r, c as col, least(greatest(floor((l_extendedprice - lo) * 10 / (hi - lo)), 0), 9)::int || '|' || case c when 'l_returnflag' then l_returnflag else l_linestatus end as v from lineitem, lim, (select unnest(['l_returnflag', 'l_linestatus']) as c)), "


@query("mixed_similarity", _MIXED + TV + " select 'l_extendedprice' as col_a, col as col_b, round(1 - distance, 6) as score from tv")
def mixed_similarity(spark, d):
    r, s = halves(load(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus"), "l_orderkey")
    return distances.mixed_similarity(r, s, ["l_extendedprice"], ["l_returnflag", "l_linestatus"]).withColumn("score", F.round("score", 6))


@query("preview", "select * from orders order by o_orderkey limit 10")
def preview(spark, d):
    return tables.preview(load(spark, d, "orders"), "o_orderkey")


@query("shown_as", "select case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end as status, o_orderkey, o_totalprice as price from orders")
def shown_as(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.shown_as(df, {"o_orderstatus": "status", "o_totalprice": "price"}, {"o_orderstatus": {"F": "finished", "O": "open"}}, ["o_orderstatus"])


def _bench_tables(spark, d):
    return {"orders": no_key(pick(load(spark, d, "orders"), "o_orderkey", ORDERS), "o_orderkey"), "lineitem": no_key(pick(load(spark, d, "lineitem"), "l_orderkey", LINEITEM), "l_orderkey")}


@query("benchmark_details", " union all ".join(f"select '{t}' as dataset, * from ({evaluate_sql(t, spec)})" for t, spec in (("orders", ORDERS), ("lineitem", LINEITEM))))
def benchmark_details(spark, d):
    return benchmarks.details(_bench_tables(spark, d))


def _summary_sql(t, spec, pairs):
    flagged = f"select round(abs(rc - sc), 3) as delta, rc, sc from ({pairs}) where abs(rc - sc) > 0.1" if pairs else "select 0.0 as delta, 0.0 as rc, 0.0 as sc where false"
    return f"select '{t}' as dataset, round(avg(score), 4) as mean_score, max(score) as worst_score, arg_max(\"column\", score) as worst_column, count(*) filter (where not ok) as cols_failed, count(*) as n_cols, (select count(*) from ({flagged})) as corr_flagged, coalesce((select max(delta) from ({flagged})), 0) as corr_max_delta, 'laag' as corr_risk from ({evaluate_sql(t, spec)})"


@query("benchmark_summary", " union all ".join(_summary_sql(*x) for x in (("orders", ORDERS, None), ("lineitem", LINEITEM, _pairs_sql("lineitem", _PAIR_NAMES)))))
def benchmark_summary(spark, d):
    return benchmarks.summary(_bench_tables(spark, d))


@query("improvement_advice")
def improvement_advice(spark, d):
    r, s = _shifted(spark, d)
    return verdicts.improvement_advice(distances.evaluate(r, s), profile.column_hints(r), profile.column_profile(r), r.count(), correlation="matig", temporal_kind="length", synthesizer="sequential_copula")


# ---- models ----


@query("copula_fit_params", " union all ".join(f"select '{c}' as \"column\", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(quantile_cont({c}, 0.05), 4) as q05, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.95), 4) as q95 from lineitem" for c in _PAIR_NAMES))
def copula_fit_params(spark, d):
    out = copula.fit_parameters(load(spark, d, "lineitem"), _PAIR_NAMES)
    return out.select("column", *(F.round(c, 4).alias(c) for c in ("mean", "std", "q05", "q50", "q95")))


@query("copula_sample")
def copula_sample(spark, d):
    df = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return copula.sample(spark, copula.fit(df, [{"type": "fixed_combinations", "columns": ["l_returnflag", "l_linestatus"]}]), 1000)


def _turns(spark, d):
    """Turns with the number of their words."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n_words")
    return load(spark, d, "conversations").select("conv_id", "turn", "role", words)


def _students(spark, d):
    # A small file is one task, but each of its rows becomes a sequence.
    return tables.ground_truth_of(sequences.dealt(load(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id")), "id"))


@query("sequential_sample")
def sequential_sample(spark, d):
    return sequence_models.sample_sequences(spark, sequence_models.fit_sequences(_students(spark, d), "student_id", "jaar"), 200)


@query("markov_sample")
def markov_sample(spark, d):
    return sequence_models.sample_markov(spark, sequence_models.fit_markov(_turns(spark, d), "conv_id", "turn", "role"), 200)


@query("context_tree_sample")
def context_tree_sample(spark, d):
    return context_trees.sample_contexts(spark, context_trees.fit_contexts(_turns(spark, d), "conv_id", "turn"), 500)


_CONTEXTS = """with o as (select *, row_number() over (partition by user_id order by ts nulls last, event_id) as pos, count(*) over (partition by user_id) as k from events),
b as (select user_id, pos, k, event_type as s, lag(event_type, 1) over w as p1, lag(event_type, 2) over w as p2 from o window w as (partition by user_id order by pos)),
r as (select s as next, p1, p2, pos from b union all select '$', s, p1, pos + 1 from b where pos = k),
f as (select next, case when pos = 1 then '^' else p1 end as c1, case when pos = 1 then null when pos = 2 then '^' else p2 end as c2 from r),
e as (select '' as context, 0 as depth, next from f union all select c1, 1, next from f union all select c1 || chr(30) || c2, 2, next from f where c2 is not null),
n as (select context, depth, next, count(*)::double as n from e group by 1, 2, 3),
t as (select *, sum(n) over (partition by context) as total from n),
c as (select *, case when depth = 1 then '' else split_part(context, chr(30), 1) end as parent from t where depth > 0),
g as (select c.context, c.parent, c.depth, max(c.total) as n, sum(c.n * ln(c.n / c.total / (u.n / u.total))) as gain, greatest(1, count(*) - 1) * ln((select sum(n) from n where depth = 0)) / 2 as price from c join t u on u.context = c.parent and u.next = c.next group by 1, 2, 3)
select replace(context, chr(30), '|') as context, depth, n::bigint as n, round(gain, 4) as gain, gain > price or context in (select parent from g where depth = 2 and gain > price) as kept from g"""


@query("context_tree", _CONTEXTS)
def context_tree(spark, d):
    rows, texts, numbers = context_trees._features(load(spark, d, "events").select("user_id", "ts", "event_type", "event_id"), "user_id", "ts", "event_id", False)
    counts = context_trees.contexts(context_trees.states(rows, ["event_type"], [], {}, 1), 2)
    out = context_trees.kept_contexts(counts, 2)
    return out.select(F.translate("context", context_trees.STEP, "|").alias("context"), "depth", "n", F.round("gain", 4).alias("gain"), "kept")


# ---- marginals and keys ----

_NARROW = {"near": "1e9 + (l_linenumber = 1)::int", "l_tax": "l_tax"}


@query("spread_of_large_numbers", f"with {ecdf_sql(long_sql('lineitem', _NARROW))} select col as \"column\", round(spread, 6) as spread, round(distance / spread, 6) as score from e join s using (col)")
def spread_of_large_numbers(spark, d):
    """A column whose quartiles are one value, with a mean of a thousand millions."""
    df = load(spark, d, "lineitem").select("l_orderkey", (F.lit(1e9) + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("near"), "l_tax")
    r, s = no_key(halves(df, "l_orderkey"), "l_orderkey")
    out = distances.numeric_distances(distances.value_frames(r, s, {"near": "numeric", "l_tax": "numeric"})[0])
    return out.select("column", F.round("spread", 6).alias("spread"), F.round(F.col("distance") / F.col("spread"), 6).alias("score"))


@query("kernel_density", """with v as (select value as x from events where value is not null and not isnan(value)),
s as (select count(*) as n, min(x) as lo, (max(x) - min(x)) / 511 as step, stddev_samp(x) as sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from v),
h as (select *, 0.9 * case when iqr > 0 then least(sd, iqr / 1.34) else sd end * pow(n, -0.2) as h from s),
p as (select (x - lo) / step as a, least(floor((x - lo) / step), 510)::int as k from v, h),
w as (select k, sum(w) as w from (select k, 1 - (a - k) as w from p union all select k + 1, a - k from p) group by 1),
d as (select unnest(range(-least(511, ceil(4 * h / step)::int), least(511, ceil(4 * h / step)::int) + 1))::int as d, step, h from h),
e as (select d, exp(-0.5 * pow(d * step / h, 2)) as e from d),
q as (select k, w, k + d as t, e / (select sum(e) from e) as p from w, e),
m as (select case when t < 0 then -t - 1 when t > 511 then 1023 - t else t end as k, sum(w * p) as w from q group by 1)
select 'value' as "column", k::int as k, round(lo + k * step, 6) as x, round(h, 6) as bandwidth, round(w / n, 8) as share from m, h""")
def kernel_density(spark, d):
    counts = profile.number_counts(load(spark, d, "events").select("value"), ["value"]).persist()
    low, high = (r["value"] for r in profile.quantiles_of(counts, [0.25, 0.75]).orderBy("p").collect())
    out = marginals.kernel_densities(counts, {"value": high - low}, marginals.facts(counts))
    return out.select("column", "k", F.round("x", 6).alias("x"), F.round("bandwidth", 6).alias("bandwidth"), F.round("share", 8).alias("share"))


@query("likelihood_statistics", " union all ".join(f"select '{c}' as \"column\", count(*) as n, round(avg({c}), 5) as mean, round(var_pop({c}), 5) as m2, round(avg(ln({c} - (lo - (hi - lo) * 0.1))), 5) as log_low, round(avg(ln(hi + (hi - lo) * 0.1 - {c})), 5) as log_high from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem)" for c in LINEITEM[0]))
def likelihood_statistics(spark, d):
    """What the families' likelihoods need: moments, and mean logarithms of the distances to bounds a tenth beyond the values."""
    known = marginals.facts(profile.number_counts(load(spark, d, "lineitem"), list(LINEITEM[0])))
    near = lambda bounds, x: min(bounds, key=lambda b: abs(b[0] - x))[2]
    rows = [(c, f.n, round(f.mean, 5), round(f.m2, 5), round(near(f.lows, f.low - (f.high - f.low) / 10), 5), round(near(f.highs, f.high + (f.high - f.low) / 10), 5)) for c, f in known.items()]
    return spark.createDataFrame(rows, "column string, n long, mean double, m2 double, log_low double, log_high double")


@query("fresh_keys", """with k as (select (substr(c_name, 10))::bigint as v from customer where c_custkey % 3 <> 0),
f as (select range as v from range(0, (select 2 * count(*) + 2 from customer)) where range not in (select v from k)),
r as (select v, row_number() over (order by v) - 1 as row from f)
select row::bigint as "row", 'Customer#' || lpad(v::varchar, 9, '0') as key from r where row < (select count(*) from customer)""")
def fresh_keys(spark, d):
    """As many keys of the shape of customers' names as there are customers; two thirds of the names are taken."""
    names = load(spark, d, "customer")
    known = names.where(F.col("c_custkey") % 3 != 0).select(F.col("c_name").alias("key"))
    learnt = key_shapes.learn(known, "key")
    # Digits that no name has yet are part of the shape: nine of them.
    template = key_shapes.Template(tuple("Customer#") + (key_shapes.CLASSES[0],) * 9) if learnt and len(learnt.alphabets) == 18 else learnt
    n = names.count()
    return key_shapes.fresh_keys(spark.range(n).select(F.col("id").alias("row")), template, known, n)


_U = "('0x' || substr(md5(id || '|42/' || {y} || '/{k}'), 1, 8))::bigint / 4294967296.0"


@query("ground_truth_doorstroom", f"""with recursive c as (select i as y, 0.05 + 0.13 * (i - 1) as g, greatest(0.0, 0.85 - 0.12 * (i - 1)) as k from range(1, 6) t(i)),
ch as (select y, k / (g + k + greatest(0.0, 1 - k - g)) as keep, (k + g) / (g + k + greatest(0.0, 1 - k - g)) as leave from c),
d as (select id, y, {_U.format(y='y', k='s')} as u, 20 + 40 * {_U.format(y='y', k='e')} as gain, keep, leave from (select c_custkey + 1 as id from customer) t, ch),
s as (select id, y, case when u < keep then 'ingeschreven' when u < leave then 'gediplomeerd' else 'uitgestroomd' end as status, round(gain, 1) as ec from d where y = 1
  union all select d.id, d.y, case when d.u < d.keep then 'ingeschreven' when d.u < d.leave then 'gediplomeerd' else 'uitgestroomd' end, round(s.ec + d.gain, 1) from s join d on d.id = s.id and d.y = s.y + 1 where s.status = 'ingeschreven')
select id as student_id, y as jaar, status, round(ec, 1) as ec from s""")
def ground_truth_doorstroom(spark, d):
    return _students(spark, d)


@query("random_uniform", "select o_orderkey, round(('0x' || substr(md5(o_orderkey || '|42'), 1, 8))::bigint / 4294967296.0, 9) as u from orders")
def random_uniform(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.round(scalars.uniform(F.col("o_orderkey")), 9).alias("u"))
