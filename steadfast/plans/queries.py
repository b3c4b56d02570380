"""The registered queries of the statistics operators over the test tables, each with its DuckDB SQL where it has one.

Doubles are rounded on both sides, and a query gives null where a value would not be finite.
"""

from __future__ import annotations

import statistics
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfast.functions.expressions import cles_from_delta, d_from_eta, delta_from_cles, eta_from_d, interval_contains, interval_margin, interval_width, normal_cdf, normal_ppf
from steadfast.functions.special import normal_ppf as z_of
from steadfast.functions.weights import HD, SIMPLE, THD_LINEAR, THD_SQRT, thd_constant
from steadfast.operators import changepoint, compare, confidence, effect, histogram, modality, quantiles, samples, shape, signal, spread, stability
from steadfast.plans import oracle as o
from steadfast.plans.frame import QuantileCache, Robust
from steadfast.sources.tables import load_table
from steadfast.streaming import detectors
from steadfast.streaming.run import available_now, read_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, digits: int = DIGITS):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(expression: str, digits: int = DIGITS) -> str:
    return f"round(({expression})::double, {digits}) + 0.0"


def events(spark, folder, *more):
    return load_table(spark, folder, "events", "event_type", "value", *more)


def orders(spark, folder):
    return load_table(spark, folder, "orders", "o_orderpriority", "o_totalprice")


E, P, S = ["event_type"], ["o_orderpriority"], ["ts", "event_id"]

# ------------------------------------------------------------------ quantiles


@query(f"""with s as (select l_returnflag as g, l_extendedprice::double as x from lineitem), {o.hd("s", [0.25, 0.5, 0.75])}
select g as l_returnflag, {", ".join(f'{_r(f"max(case when p = {p} then q end)", 3)} as "l_extendedprice_q{p:.2f}"' for p in (0.25, 0.5, 0.75))} from h group by g""", 3)
def hd_quartiles_by_flag(spark, folder):
    return quantiles.quantiles(load_table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", quantiles.QUARTILES, HD, ["l_returnflag"])


@query(f"""with {o.EVENTS}, {o.hd("s", list(quantiles.DECILES))} select g as event_type, n, p, {_r("q")} as value, {_r("m2", 3)} as second_moment from h""")
def hd_deciles_by_event(spark, folder):
    return quantiles.quantile_table(events(spark, folder), "value", quantiles.DECILES, HD, E).withColumn("second_moment", F.round("second_moment", 3))


@query("""with s as (select 0 as g, c_acctbal::double as x from customer), """ + o.hd("s", [0.25, 0.5]) + f""" select {_r("max(case when p = 0.25 then q end)")} as "c_acctbal_q0.25", {_r("max(case when p = 0.5 then q end)")} as "c_acctbal_q0.50" from h""")
def hd_whole_column(spark, folder):
    return quantiles.quantiles(load_table(spark, folder, "customer", "c_acctbal"), "c_acctbal", [0.25, 0.5])


def _thd(name, table, group, column, method, width, digits=DIGITS):
    sql = f"with s as (select {group} as g, {column}::double as x from {table}), {o.thd_median('s', width)} select g as {group}, {_r('q', digits)} as \"{column}_q0.50\" from t"

    def f(spark, folder):
        return quantiles.quantiles(load_table(spark, folder, table, group, column), column, [0.5], method, [group])

    f.__name__ = name
    query(sql, digits)(f)


_thd("thd_sqrt_median_by_segment", "customer", "c_mktsegment", "c_acctbal", THD_SQRT, "(1 / sqrt(n))")
_thd("thd_linear_median", "orders", "o_orderpriority", "o_totalprice", THD_LINEAR, "(1 / n)", 3)
_thd("thd_constant_median", "orders", "o_orderpriority", "o_totalprice", thd_constant(0.2), "0.2", 3)


@query(f"""select o_orderpriority, {", ".join(f'{_r(f"quantile_cont(o_totalprice, {p})", 3)} as "o_totalprice_q{p:.2f}"' for p in (0.0, 0.1, 0.5, 0.9, 1.0))} from orders group by 1""", 3)
def linear_quantiles(spark, folder):
    return quantiles.quantiles(orders(spark, folder), "o_totalprice", [0.0, 0.1, 0.5, 0.9, 1.0], SIMPLE, P)


# ------------------------------------------------------------------ spread and shape


def _spread(kind, p, factor, k=None):
    k_sql = "1.0" if k is None else f"case when d.n < 100 then ([{', '.join(map(repr, k[0]))}])[(d.n + 1)::int] else {k[1]} end"
    sql = f"with {o.EVENTS}, {o.deviation('s', p)} select g as event_type, {_r(f'q * {factor} * {k_sql}')} as value_{kind} from d"

    def f(spark, folder):
        return spread.spread(events(spark, folder), "value", kind, E)

    f.__name__ = f"{kind}_by_event"
    query(sql)(f)


_spread("mad", 0.5, 1.0)
_spread("smad", 0.5, spread.MAD_FACTOR)
_spread("qad", 0.9, 1.0)
_spread("sqad", spread.P_STANDARD, 1.0, (spread.K_STANDARD, "(1.0 + 0.762 / d.n + 0.967 / (d.n::double * d.n))"))
_spread("oqad", spread.P_OPTIMAL, 1.0, (spread.K_OPTIMAL, "(0.6747309 * (1.0 + 1.047 / d.n + 1.193 / (d.n::double * d.n)))"))

_Q = lambda p: f"max(case when p = {p} then q end)"


def _from_quantiles(name, ps, expression, column, f):
    f.__name__ = name
    query(f"with {o.EVENTS}, {o.hd('s', ps)} select g as event_type, {_r(expression)} as {column} from h group by g")(f)


_from_quantiles("iqr_by_event", [0.25, 0.75], f"{_Q(0.75)} - {_Q(0.25)}", "value_iqr", lambda s, d: spread.spread(events(s, d), "value", "iqr", E))
_from_quantiles("siqr_by_event", [0.25, 0.75], f"({_Q(0.75)} - {_Q(0.25)}) * 0.7413", "value_siqr", lambda s, d: spread.spread(events(s, d), "value", "siqr", E))
_from_quantiles("bowley_skewness", [0.25, 0.5, 0.75], f"({_Q(0.75)} + {_Q(0.25)} - 2 * {_Q(0.5)}) / ({_Q(0.75)} - {_Q(0.25)})", "value_skewness", lambda s, d: shape.bowley_skewness(events(s, d), "value", E))
_from_quantiles("moors_kurtosis", [k / 8 for k in range(1, 8)], f"(({_Q(0.875)} - {_Q(0.625)}) + ({_Q(0.375)} - {_Q(0.125)})) / ({_Q(0.75)} - {_Q(0.25)})", "value_kurtosis", lambda s, d: shape.moors_kurtosis(events(s, d), "value", E))
_from_quantiles("crow_siddiqui_kurtosis", [0.025, 0.25, 0.75, 0.975], f"({_Q(0.975)} - {_Q(0.025)}) / ({_Q(0.75)} - {_Q(0.25)}) - 2.91", "value_kurtosis", lambda s, d: shape.crow_siddiqui_kurtosis(events(s, d), "value", E))

_FLAG = "r as (select l_returnflag as g, l_quantity::double as x, row_number() over (partition by l_returnflag order by l_quantity) as r, count(*) over (partition by l_returnflag) as n from lineitem)"


@query(f"with {_FLAG} select g as l_returnflag, {_r('stddev_samp(x)')} as l_quantity_trimmed_std from r where r > floor(n * 0.1) and r <= n - floor(n * 0.1) group by g")
def trimmed_std_by_flag(spark, folder):
    return spread.spread(load_table(spark, folder, "lineitem", "l_returnflag", "l_quantity"), "l_quantity", "trimmed_std", ["l_returnflag"])


@query(f"""with {_FLAG}, e as (select g, max(case when r = floor(n * 0.1) + 1 then x end) as lo, max(case when r = n - floor(n * 0.1) then x end) as hi from r group by g)
select r.g as l_returnflag, {_r('stddev_samp(least(greatest(x, lo), hi))')} as l_quantity_winsorized_std from r join e on r.g = e.g group by r.g""")
def winsorized_std_by_flag(spark, folder):
    return spread.spread(load_table(spark, folder, "lineitem", "l_returnflag", "l_quantity"), "l_quantity", "winsorized_std", ["l_returnflag"])


@query(f"""with s as (select event_type as g, event_id, value::double as x from events), {o.deviation("s", 0.5)}
select s.g as event_type, event_id, {_r(f"(s.x - center) / (q * {spread.MAD_FACTOR})")} as value_z from s join d on s.g = d.g""")
def robust_zscore(spark, folder):
    return spread.standardize(events(spark, folder, "event_id"), "value", E).select("event_type", "event_id", "value_z")


@query(f"""with m as (select event_type, median(value) as m from events group by 1) select e.event_type, {_r("sum(abs(value - m))", 3)} as total, {_r("max(abs(value - m))")} as largest from events e join m on e.event_type = m.event_type group by 1""")
def plain_deviations(spark, folder):
    return spread.plain_deviations(events(spark, folder), "value", E).groupBy(*E).agg(F.round(F.sum("deviation"), 3).alias("total"), F.max("deviation").alias("largest"))


@query(f"""with m as (select event_type, count(*) as n, avg(value::double) as a from events group by 1),
c as (select e.event_type, any_value(n) as n, avg(pow(value - a, 2)) as m2, avg(pow(value - a, 3)) as m3, avg(pow(value - a, 4)) as m4 from events e join m on e.event_type = m.event_type group by 1)
select event_type, {_r("m3 / pow(m2, 1.5)")} as value_skewness, {_r("m4 / (m2 * m2) - 3")} as value_kurtosis from c""")
def classical_moments(spark, folder):
    return shape.moments(events(spark, folder), "value", E)


@query(f"""select event_type, count(*) as n, {_r("sum(value)", 3)} as total, {_r("sum(value * value)", 2)} as sum_of_squares, {_r("avg(value)")} as mean, {_r("var_samp(value)")} as variance,
{_r("stddev_samp(value)")} as std_dev, {_r("min(value)")} as min, {_r("max(value)")} as max, {_r("stddev_samp(value) / sqrt(count(*))")} as standard_error, {_r("stddev_pop(value) / abs(avg(value))")} as cv from events group by 1""")
def summary_statistics(spark, folder):
    found = shape.summary(events(spark, folder), "value", E)
    return found.withColumn("total", F.round("total", 3)).withColumn("sum_of_squares", F.round("sum_of_squares", 2))


@query("""select event_type, arg_min(event_id, struct_pack(v := value, e := event_id)) as argmin, arg_max(event_id, struct_pack(v := value, e := -event_id)) as argmax from events group by 1""")
def extremes(spark, folder):
    return shape.extremes(events(spark, folder, "event_id"), "value", "event_id", E)


@query(f"select l_returnflag, {_r('sum(l_extendedprice * l_discount)', 2)} as dot_product from lineitem group by 1", 2)
def dot_product(spark, folder):
    return shape.dot_product(load_table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount", ["l_returnflag"])


@query(f"""with s as (select s_nationkey as g, s_acctbal::double as x from supplier), {o.hd("s", [0.5])}, c as (select s.g, any_value(n) as n, any_value(q) as m from s join h on s.g = h.g group by s.g),
k as (select a.g, ((b.x - m) - (m - a.x)) / (b.x - a.x) as x from s a join c on a.g = c.g join s b on a.g = b.g where a.x < m and b.x > m and n >= 3),
kn as (select g, count(*) as kn, any_value(x) as one from k group by g), ks as (select k.* from k join kn on k.g = kn.g where kn > 1), {o.hd("ks", [0.5], alias="kh")}
select c.g as s_nationkey, case when c.n >= 3 then {_r("case when kn is null then 0 when kn = 1 then one else kh.q end")} end as s_acctbal_medcouple from c left join kn on c.g = kn.g left join kh on c.g = kh.g""")
def medcouple(spark, folder):
    return shape.medcouple(load_table(spark, folder, "supplier", "s_nationkey", "s_acctbal"), "s_acctbal", ["s_nationkey"])


# ------------------------------------------------------------------ comparisons and effect sizes


@query(f"""with {o.ORDERS}, {o.hd("s", [0.1, 0.5, 0.9])} select a.g as group1, b.g as group2, a.p, {_r("a.q", 3)} as value1, {_r("b.q", 3)} as value2, {_r("a.q - b.q", 3)} as shift, {_r("a.q / b.q")} as ratio, {_r("ln(a.q) - ln(b.q)")} as log_ratio
from h a join h b on a.g < b.g and a.p = b.p""")
def quantile_comparison(spark, folder):
    q = compare.quantile_comparison(orders(spark, folder), "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9])
    return q.withColumns({c: F.round(c, 3) for c in ("value1", "value2", "shift")})


def _label(x: str, kind: str) -> str:
    from steadfast.functions.expressions import THRESHOLDS

    a, b, c = THRESHOLDS[kind]
    size = f"abs(({x}) - 0.5)" if kind == "probability" else f"abs({x})"
    return f"case when {size} < {a} then 'Negligible' when {size} < {b} then 'Small' when {size} < {c} then 'Medium' else 'Large' end"


def _effect(name, kind, magnitude, stats, scale_kind, more="", **options):
    sql = f"with {o.ORDERS}, {stats} select group1, group2, n1, n2, {_r('magnitude')} as magnitude, {_label('magnitude', scale_kind)} as interpretation{more} from (select *, {magnitude} as magnitude from duo)"

    def f(spark, folder):
        return effect.effect_size(orders(spark, folder), "o_orderpriority", "o_totalprice", kind, **options)

    f.__name__ = name
    query(sql)(f)


_PAIR = "duo as (select a.g as group1, b.g as group2, a.n as n1, b.n as n2, a.l as l1, b.l as l2, a.s as s1, b.s as s2 from st a join st b on a.g < b.g)"
_PLAIN = "st as (select g, count(*) as n, avg(x) as l, stddev_samp(x) as s from s group by g), " + _PAIR
_ROBUST = o.deviation("s", 0.5) + ", st as (select g, n, center as l, q as s from d), " + _PAIR
_POOL = "sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))"
_effect("cohen_d", "cohen_d", f"(l1 - l2) / {_POOL}", _PLAIN, "difference")
_effect("cohen_d_welch", "cohen_d", "(l1 - l2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2)", _PLAIN, "difference", welch=True)
_effect("cohen_d_robust", "cohen_d", f"(l1 - l2) / {_POOL}", _ROBUST, "difference", robust=True)
_effect("hedges_g", "hedges_g", f"(l1 - l2) / {_POOL} * (1 - 3 / (4.0::double * (n1 + n2) - 9))", _PLAIN, "difference")
_effect("glass_delta", "glass_delta", "(l2 - l1) / s1", _PLAIN, "difference")
_effect("glass_delta_robust", "glass_delta", "(l2 - l1) / s1", _ROBUST, "difference", robust=True)
_WINS = """pr as (select a.g as group1, b.g as group2 from (select distinct g from s) a join (select distinct g from s) b on a.g < b.g),
v as (select group1, group2, x, count(*) filter (where g = group1) as c1, count(*) filter (where g = group2) as c2 from pr join s on g = group1 or g = group2 group by all),
k as (select *, coalesce(sum(c1) over (partition by group1, group2 order by x rows between unbounded preceding and 1 preceding), 0) as b1,
             coalesce(sum(c2) over (partition by group1, group2 order by x rows between unbounded preceding and 1 preceding), 0) as b2 from v),
duo as (select group1, group2, sum(c1)::bigint as n1, sum(c2)::bigint as n2, sum(c2::double * b1) as more, sum(c1::double * b2) as less, sum(c1::double * c2) as same from k group by group1, group2)"""
_Z95 = repr(z_of(0.975))
_effect("cliff_delta", "cliff_delta", "(more - less) / (n1::double * n2)", _WINS, "dominance", f", {_r(f'greatest(-1, magnitude - {_Z95} * sqrt((n1 + n2 + 1) / (3.0::double * n1 * n2)))')} as lower, {_r(f'least(1, magnitude + {_Z95} * sqrt((n1 + n2 + 1) / (3.0::double * n1 * n2)))')} as upper")
_effect("cles", "cles", "(more + same / 2) / (n1::double * n2)", _WINS, "probability", f", {_r(f'greatest(0, magnitude - {_Z95} * sqrt((n1 + n2 + 1) / (12.0::double * n1 * n2)))')} as lower, {_r(f'least(1, magnitude + {_Z95} * sqrt((n1 + n2 + 1) / (12.0::double * n1 * n2)))')} as upper")
_effect("cles_without_ties", "cles", "more / (n1::double * n2)", _WINS, "probability", f", {_r(f'greatest(0, magnitude - {_Z95} * sqrt((n1 + n2 + 1) / (12.0::double * n1 * n2)))')} as lower, {_r(f'least(1, magnitude + {_Z95} * sqrt((n1 + n2 + 1) / (12.0::double * n1 * n2)))')} as upper", ties=False)
_SS = """st as (select g, count(*) as n, avg(x) as m, var_pop(x) as v from s group by g),
b0 as (select a.g as group1, b.g as group2, a.n as n1, b.n as n2, a.m as m1, b.m as m2, a.n * a.v + b.n * b.v as ssw, (a.n * a.m + b.n * b.m) / (a.n + b.n) as gm from st a join st b on a.g < b.g),
duo as (select *, n1 * pow(m1 - gm, 2) + n2 * pow(m2 - gm, 2) as ssb from b0)"""
_effect("point_biserial", "point_biserial", "sign(m2 - m1) * sqrt(ssb / (ssb + ssw))", _SS, "correlation")
_effect("eta_squared", "eta_squared", "ssb / (ssb + ssw)", _SS, "variance")
_effect("omega_squared", "omega_squared", "greatest(0, (ssb - ssw / (n1 + n2 - 2)) / (ssb + ssw + ssw / (n1 + n2 - 2)))", _SS, "variance")


@query(f"""select p_partkey, {_r("(p_size - 1) / 49.0")} as delta, {_r("((p_size - 1) / 49.0 + 1) / 2")} as cles, {_r("2 * (((p_size - 1) / 49.0 + 1) / 2) - 1")} as back,
{_r("case when p_size = 50 then null when p_size = 1 then 0 else 2 * sqrt(((p_size - 1) / 49.0) / (1 - (p_size - 1) / 49.0)) end")} as d, {_r("pow(p_size / 10.0, 2) / (pow(p_size / 10.0, 2) + 4)")} as eta from part""")
def effect_conversions(spark, folder):
    e = (F.col("p_size").cast("double") - 1) / 49.0
    d = F.col("p_size").cast("double") / 10.0
    return load_table(spark, folder, "part", "p_partkey", "p_size").select("p_partkey", e.alias("delta"), cles_from_delta(e).alias("cles"), delta_from_cles(cles_from_delta(e)).alias("back"), d_from_eta(e).alias("d"), eta_from_d(d).alias("eta"))


@query("""with a as (select event_id, (value - 50.0) / 25.0 as z from events), e as (select event_id, z, abs(z) / sqrt(2.0) as y, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as t from a),
c as (select event_id, case when z < -8 then 0 when z > 8 then 1 else 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-y * y))) end as cdf from e)
select event_id, """ + _r("cdf") + " as cdf from c")
def normal_distribution(spark, folder):
    z = (F.col("value") - 50.0) / 25.0
    return load_table(spark, folder, "events", "event_id", "value").select("event_id", normal_cdf(z).alias("cdf"))


@query(f"""with z(k, z) as (values {", ".join(f"({k}, {statistics.NormalDist().inv_cdf(k / 51)!r}::double)" for k in range(1, 51))}) select p_partkey, {_r("z", 5)} as z from part join z on p_size = k""", 5)
def normal_quantiles(spark, folder):
    p = F.col("p_size").cast("double") / 51.0
    return load_table(spark, folder, "part", "p_partkey", "p_size").select("p_partkey", normal_ppf(p).alias("z"))


# ------------------------------------------------------------------ confidence


def _ci(n: str = "n") -> str:
    return f"{_r('e')} as estimate, {_r('e - h')} as lower, {_r('e + h')} as upper"


@query(f"with {o.EVENTS}, {o.hd('s', [0.5])} select g as event_type, n, {_ci()} from (select g, n, q as e, {_Z95} * sqrt((m2 - q * q) / n) as h from h)")
def mj_interval(spark, folder):
    return confidence.maritz_jarrett(events(spark, folder), "value", 0.5, E)


@query(f"with {o.EVENTS}, {o.hd('s', [0.5])} select g as event_type, n, {_ci()} from (select g, n, q as e, {_Z95} * sqrt(0.25 / n) as h from h)")
def mj_interval_compat(spark, folder):
    return confidence.maritz_jarrett(events(spark, folder), "value", 0.5, E, compat=True)


@query(f"""with {o.EVENTS}, {o.hd("s", [0.5])} select group1, group2, n1, n2, {_ci()} from (
  select a.g as group1, b.g as group2, a.n as n1, b.n as n2, a.q - b.q as e, {_Z95} * sqrt((a.m2 - a.q * a.q) / a.n + (b.m2 - b.q * b.q) / b.n) as h from h a join h b on a.g < b.g)""")
def mj_two_sample(spark, folder):
    return confidence.maritz_jarrett_two_sample(events(spark, folder), "event_type", "value")


@query(f"select event_type, n, {_ci()} from (select event_type, count(*) as n, avg(value) as e, {_Z95} * stddev_samp(value) / sqrt(count(*)) as h from events group by 1)")
def asymptotic_interval(spark, folder):
    return confidence.asymptotic(events(spark, folder), "value", E)


@query(f"""with t(n, t) as (values {", ".join(f"({n}, {o.student_quantile(n - 1, 0.975)!r}::double)" for n in range(2, 301))}),
a as (select s_nationkey, count(*) as n, avg(s_acctbal) as e, stddev_samp(s_acctbal) as sd from supplier group by 1)
select s_nationkey, a.n, {_r("e")} as estimate, {_r("e - t * sd / sqrt(a.n)")} as lower, {_r("e + t * sd / sqrt(a.n)")} as upper from a left join t on a.n = t.n""")
def student_interval(spark, folder):
    return confidence.asymptotic(load_table(spark, folder, "supplier", "s_nationkey", "s_acctbal"), "s_acctbal", ["s_nationkey"], student=True)


@query(f"""with a as (select event_type, avg(value) as e, {_Z95} * stddev_samp(value) / sqrt(count(*)) as h from events group by 1)
select event_type, {_r("2 * h")} as width, {_r("h")} as margin, (50 between e - h and e + h) as contains50 from a""")
def interval_helpers(spark, folder):
    lo, hi = F.col("lower"), F.col("upper")
    return confidence.asymptotic(events(spark, folder), "value", E).select("event_type", interval_width(lo, hi).alias("width"), interval_margin(lo, hi).alias("margin"), interval_contains(lo, hi, F.lit(50.0)).alias("contains50"))


_N_BOOT = 200
_DRAW = "(xor({x}, {x} >> {s}) * {m}) % 2147483647"


def _boot_sql(pick: str) -> str:
    step = lambda seed: f"(((b * 1000003 + i * 7919 + {seed} * 104729 + 12345) % 2147483647) * 48271 + 11) % 2147483647"
    side = lambda k, group, seed: f"""x{k} as (select row_number() over (order by value) - 1 as i, value::double as x, count(*) over () as n from events where event_type = '{group}'),
d{k} as (select b, {step(seed)} as h, n from x{k}, r), e{k} as (select b, {_DRAW.format(x="h", s=13, m=69621)} as h, n from d{k}),
f{k} as (select b, ({_DRAW.format(x="h", s=11, m=39373)}) % n as at from e{k}),
m{k} as (select f.b, avg(x) as m from f{k} f join x{k} x on f.at = x.i group by f.b)"""  # noqa: E731
    return f"""with r as (select unnest(range(0, {_N_BOOT})) as b), {side(1, "click", 42)}, {side(2, "view", 43)},
v as (select list(m1.m - m2.m order by m1.m - m2.m) as v from m1 join m2 on m1.b = m2.b), t as (select (select avg(x) from x1) - (select avg(x) from x2) as t)
select {_r("t")} as estimate, {pick} from v, t"""


_LO, _HI = f"v[{int((1 - 0.95) / 2 * _N_BOOT) + 1}]", f"v[{min(int((1 - (1 - 0.95) / 2) * _N_BOOT), _N_BOOT - 1) + 1}]"


def _boot(method, pick):
    def f(spark, folder):
        return confidence.bootstrap(events(spark, folder), "event_type", "value", ("click", "view"), confidence.mean_statistic, method=method, resamples=_N_BOOT)

    f.__name__ = f"bootstrap_{method}"
    query(_boot_sql(pick) if pick else None)(f)


_boot("percentile", f"{_r(_LO)} as lower, {_r(_HI)} as upper")
_boot("basic", f"{_r(f'2 * t - {_HI}')} as lower, {_r(f'2 * t - {_LO}')} as upper")
_boot("student", f"{_r(f'2 * t - {_HI}')} as lower, {_r(f'2 * t - {_LO}')} as upper")
_boot("bca", None)


@query()
def quantile_shift_bootstrap(spark, folder):
    return confidence.quantile_bootstrap(events(spark, folder), "event_type", "value", ("click", "view"), quantiles.QUARTILES)


@query()
def quantile_ratio_bootstrap(spark, folder):
    return confidence.quantile_bootstrap(events(spark, folder), "event_type", "value", ("click", "view"), quantiles.QUARTILES, compare=confidence.ratio)


# ------------------------------------------------------------------ histograms and modes

_FIXED = """st as (select g, count(*) as n, min(x) as lo, max(x) as hi, {k} as k from s group by g), w as (select *, (hi - lo) / k as w from st),
e as (select g, n, lo, hi, k, w, unnest(range(0, k::int)) as bin from w),
c as (select e.g, e.bin, count(*) as c from s join e on s.g = e.g and (s.x >= lo + bin * w or bin = 0) and (s.x < lo + (bin + 1) * w or bin = k - 1) group by 1, 2),
hist as (select e.g, e.bin, lo + e.bin * w as l, case when e.bin = k - 1 then hi else lo + (e.bin + 1) * w end as r, coalesce(c, 0) as c, coalesce(c, 0) / (n * w) as d from e left join c on e.g = c.g and e.bin = c.bin)"""
_HIST = f"select g as event_type, bin::bigint as bin, {_r('l')} as \"left\", {_r('r')} as \"right\", c as \"count\", {_r('d', 8)} as density from hist"


def _hist(name, f, k):
    f.__name__ = name
    query(f"with {o.EVENTS}, {_FIXED.format(k=k)} {_HIST}", 8)(lambda s, d: f(s, d).withColumn("left", F.round("left", 6)).withColumn("right", F.round("right", 6)))
    QUERIES[name] = QUERIES.pop("<lambda>")
    SQL[name] = SQL.pop("<lambda>")


_hist("hist_fixed", lambda s, d: histogram.fixed_width(events(s, d), "value", 12, E), "12")
_hist("hist_scott", lambda s, d: histogram.scott(events(s, d), "value", E), "ceil((max(x) - min(x)) / (3.5 * stddev_pop(x) * pow(count(*), -1.0 / 3)))")
_hist("hist_freedman_diaconis", lambda s, d: histogram.freedman_diaconis(events(s, d), "value", E), "ceil((max(x) - min(x)) / (2 * (list(x order by x)[(3 * count(*) // 4)::int + 1] - list(x order by x)[(count(*) // 4)::int + 1]) * pow(count(*), -1.0 / 3)))")


def _between(inner: list[float]) -> str:
    """A histogram between the quantiles at inner and the ends."""
    return f"""with {o.EVENTS}, {o.hd("s", inner)}, ends as (select g, min(x) as lo, max(x) as hi, count(*) as n from s group by g),
ed as (select g, list_sort(list(q) || [any_value(lo), any_value(hi)]) as e, any_value(nn) as n from (select h.g, h.q, ends.lo, ends.hi, ends.n as nn from h join ends on h.g = ends.g) group by g),
b as (select g, n, e, unnest(range(0, len(e) - 1)) as bin from ed),
c as (select b.g, b.bin, count(*) as c from s join b on s.g = b.g and (s.x >= e[bin + 1] or bin = 0) and (s.x < e[bin + 2] or bin = len(e) - 2) group by 1, 2)
select b.g as event_type, b.bin::bigint as bin, {_r("e[b.bin + 1]")} as "left", {_r("e[b.bin + 2]")} as "right", coalesce(c, 0) as "count", {_r("coalesce(c, 0) / (n * (e[b.bin + 2] - e[b.bin + 1]))")} as density from b left join c on b.g = c.g and b.bin = c.bin"""


@query(_between([k / 8 for k in range(1, 8)]))
def hist_quantile(spark, folder):
    return histogram.quantile_bins(events(spark, folder), "value", 8, E)


@query(_between(histogram.exponential_steps(20)[1:-1]))
def hist_qrde_exponential(spark, folder):
    return histogram.qrde(events(spark, folder), "value", histogram.exponential_steps, E, bins=20)


@query(f"""with {o.EVENTS}, {_FIXED.format(k="10")},
pr as (select a.g as group1, b.g as group2 from (select distinct g from hist) a join (select distinct g from hist) b on a.g < b.g),
ed as (select distinct group1, group2, unnest([l, r]) as e from pr join hist on g = group1 or g = group2),
iv as (select * from (select *, lead(e) over (partition by group1, group2 order by e) as nx from ed) where nx is not null),
tot as (select g, sum(c)::double as t from hist group by g),
m as (select group1, group2, e, nx, g, coalesce(sum(case when l <= (e + nx) / 2 and (e + nx) / 2 < r then c end), 0) / any_value(t) as mass, sum(c * greatest(0.0, least(1.0, (e - l) / (r - l)))) / any_value(t) as f
      from iv join hist on g = group1 or g = group2 join tot using (g) group by group1, group2, e, nx, g),
p as (select a.group1, a.group2, a.nx - a.e as wd, a.f as f1, b.f as f2, a.mass / sum(a.mass) over (partition by a.group1, a.group2) as p, b.mass / sum(b.mass) over (partition by a.group1, a.group2) as q
      from m a join m b on a.group1 = b.group1 and a.group2 = b.group2 and a.e = b.e and a.g = a.group1 and b.g = b.group2)
select group1, group2, {_r("sum(wd * abs(f1 - f2))")} as wasserstein, {_r("sum(case when p > 1e-10 then p * ln(p / greatest(q, 1e-10)) else 0 end)")} as kl,
{_r("0.5 * sum(case when p + q > 0 then (p - q) * (p - q) / (p + q) else 0 end)")} as chi_squared, {_r("sum(least(p, q))")} as intersection, {_r("case when sum(sqrt(p * q)) >= 1 then 0 else greatest(0, -ln(sum(sqrt(p * q)))) end")} as bhattacharyya
from p group by group1, group2""")
def hist_distances(spark, folder):
    return histogram.distances(histogram.fixed_width(events(spark, folder), "value", 10, E), "event_type")


@query(f"""with {o.EVENTS}, {_FIXED.format(k="12")} select g as event_type, count(*) as bins, sum(c)::bigint as total, {_r("min(l)")} as lower, {_r("max(r)")} as upper, {_r("max(d)")} as max_density, {_r("min(d)")} as min_density, max(c) as max_count from hist group by g""")
def hist_accessors(spark, folder):
    return histogram.accessors(histogram.fixed_width(events(spark, folder), "value", 12, E), E)


@query()
def modality_lowland(spark, folder):
    return modality.lowland_modes(events(spark, folder), "value", E)


@query()
def modality_assignment(spark, folder):
    ev = events(spark, folder)
    return modality.assign_modes(ev, "value", modality.lowland_modes(ev, "value", E), E).groupBy("event_type", "mode").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ changepoints

_CUSUM = f"""with {o.SERIES}, m as (select *, median(x) over (partition by g) as ref from s),
c as (select g, i, sum(x - ref - 0.5) over w as su, sum(ref - x - 0.5) over w as sd from m window w as (partition by g order by i)),
k as (select g, i, su - least(0, min(su) over (partition by g order by i)) as up, sd - least(0, min(sd) over (partition by g order by i)) as down from c)"""


def series(spark, folder):
    return events(spark, folder, "ts", "event_id")


@query(f"{_CUSUM} select g as event_type, i as idx, {_r('up', 3)} as up, {_r('down', 3)} as down from k", 3)
def cusum_statistics(spark, folder):
    return changepoint.cusum_statistics(series(spark, folder), "value", S, E).drop("x")


def _kept(alarms: str, tolerance: int, kind: str) -> str:
    """Alarms (g, i, c), c being what confidence is made of, thinned."""
    return f"""{o.thinned(alarms, tolerance)} select al.g as event_type, al.i as idx, {_r("least(1, al.c)")} as confidence, '{kind}' as change_type from kept join al on al.g = kept.g and al.i = kept.i"""


@query(f"{_CUSUM}, {_kept('select g, i, greatest(up, down) / 800 as c from k where greatest(up, down) > 400', 1, 'MeanShift')}")
def cusum(spark, folder):
    return changepoint.cusum(series(spark, folder), "value", S, E, threshold=400.0)


_TERMS = 166
_W = "[" + ", ".join(repr(0.2 * 0.8**k) for k in range(_TERMS - 1, -1, -1)) + "]"
_EWMA = f"""with {o.SERIES}, f as (select g, x from s where i < 20), {o.deviation("f", 0.5)},
l as (select g, i, x, list(x) over (partition by g order by i rows between {_TERMS - 1} preceding and current row) as v from s),
a as (select l.g, i, x, center, q, list_dot_product(v, ({_W}::double[])[{_TERMS} - len(v) + 1:]) + pow(0.8, i + 1) * center as ew from l join d on l.g = d.g)"""


@query(f"{_EWMA} select g as event_type, i as idx, {_r('ew')} as ewma, {_r('abs(x - ew)')} as deviation from a")
def ewma_statistics(spark, folder):
    return changepoint.ewma_statistics(series(spark, folder), "value", S, E).select("event_type", "idx", "ewma", "deviation")


_DRIFTS = "select g, i, abs(ew - center) / (3 * q) as c from a where i >= 20 and abs(ew - center) > 1.5 * q"


@query(f"{_EWMA}, {_kept(_DRIFTS, 3, 'Drift')}")
def ewma(spark, folder):
    return changepoint.ewma(series(spark, folder), "value", S, E, multiplier=1.5)


def _slopes_sql(window: int) -> str:
    return f"""with {o.SERIES}, sl as (select g, i - {window - 1} as i, slope from (select g, i, regr_slope(x, i) over (partition by g order by i rows between {window - 1} preceding and current row) as slope from s) where i >= {window - 1}),
df as (select * from (select g, i, abs(lead(slope) over (partition by g order by i) - slope) as x from sl) where x is not null)"""


@query(f"{_slopes_sql(10)} select g as event_type, i, {_r('slope')} as slope from sl")
def window_slopes(spark, folder):
    return changepoint.window_slopes(series(spark, folder), "value", S, E)


@query(f"{_slopes_sql(10)}, {o.deviation('df', 0.5)}, {_kept('select df.g, df.i + 10 as i, x / (6 * q) as c from df join d on df.g = d.g where x > 3 * q and least(1, x / (6 * q)) >= 0.5', 2, 'TrendChange')}")
def slopes(spark, folder):
    return changepoint.slopes(series(spark, folder), "value", S, E)


def _polynomial(degree: int) -> str:
    """CTEs with the slopes sl(g, i, slope) of windows of 25 and the alarms pa(g, l, i, c, kind): trend changes, then steady states."""
    t = np.linspace(-1, 1, 25)
    row = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))[1] * 12
    return f"""with {o.SERIES}, sl as (select g, i - 24 as i, list_dot_product(v, {row.tolist()}::double[]) as slope from (select g, i, list(x) over (partition by g order by i rows between 24 preceding and current row) as v from s) where i >= 24),
df as (select * from (select g, i, abs(lead(slope) over (partition by g order by i) - slope) as x from sl) where x is not null), {o.deviation("df", 0.5)},
size as (select g, i, abs(slope) as x from sl), {o.deviation("size", 0.5, alias="e")},
sm as (select size.g, i, x, 2 * q as lim, i - coalesce(max(case when x >= 2 * q then i end) over (partition by size.g order by i), -1) as run from size join e on size.g = e.g),
pa as (select df.g, 0 as l, df.i + 25 as i, x / (6 * q) as c, 'TrendChange' as kind from df join d on df.g = d.g where x > 3 * q and least(1, x / (6 * q)) >= 0.5
       union all select g, 1, i + 25, lim / (x + 1e-10), 'SteadyState' from sm where run >= 3), {o.thinned_lists("pa", 2, "pk")},
base as (select pa.* from pa join pk on pa.g = pk.g and pa.l = pk.l and pa.i = pk.i)"""


@query(f"""{_polynomial(2)} select g as event_type, i as idx, {_r("least(1, c)")} as confidence, kind as change_type from base""")
def polynomial_slopes(spark, folder):
    return changepoint.polynomial_slopes(series(spark, folder), "value", S, E, degree=2)


@query(f"""{_polynomial(1)}, d2 as (select * from (select g, i, abs(lead(slope, 2) over w - 2 * lead(slope) over w + slope) as x from sl window w as (partition by g order by i)) where x is not null), {o.deviation("d2", 0.5, alias="f")},
aa as (select g, 0 as l, i, m.c as c, m.k as kind from (select g, i, min(struct_pack(c := least(1, c), k := kind)) as m from base group by g, i)
       union all select d2.g, 1, d2.i + 27, x / (5 * q), 'AccelerationChange' from d2 join f on d2.g = f.g where x > 2.5 * q and least(1, x / (5 * q)) >= 0.5), {o.thinned_lists("aa", 3, "ak")}
select aa.g as event_type, aa.i as idx, {_r("least(1, c)")} as confidence, kind as change_type from aa join ak on aa.g = ak.g and aa.l = ak.l and aa.i = ak.i""")
def adaptive_slopes(spark, folder):
    return changepoint.adaptive_slopes(series(spark, folder), "value", S, E)


@query(f"""with {o.SERIES} select g as event_type, i - 9 as i, {_r("m")} as mean, {_r("v")} as variance from (select g, i, avg(x) over w as m, var_pop(x) over w as v from s window w as (partition by g order by i rows between 9 preceding and current row)) where i >= 9""")
def rolling_statistics(spark, folder):
    return changepoint.rolling(series(spark, folder), "value", S, {"mean": F.avg("x"), "variance": F.var_pop("x")}, E, window=10)


# ------------------------------------------------------------------ stability


@query(f"""with {o.SERIES}, t as (select a.g, any_value(a.n) as n, sum(sign(b.x - a.x))::bigint as s from (select *, count(*) over (partition by g) as n from s) a join s b on a.g = b.g and a.i < b.i group by a.g),
z as (select g, n, s, case when s = 0 then 0 else (s - sign(s)) / sqrt(n * (n - 1.0::double) * (2 * n + 5) / 18) end as z from t),
y as (select *, abs(z) / sqrt(2.0) as y, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as k from z),
p as (select *, 2 * (1 - case when z = 0 then 0 else 1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-y * y) end) as p from y)
select g as event_type, n, s, {_r("z")} as z, {_r("p")} as p, {_r("p / 2")} as p_two_sided from p""")
def mann_kendall(spark, folder):
    return stability.mann_kendall(series(spark, folder), "value", S, E)


@query(f"""with {o.SERIES}, a as (select *, least(i // (count(*) over (partition by g) // 3), 2) as part from s), m as (select g, part, median(x) as m from a group by 1, 2),
d as (select a.g, a.part, abs(x - m) as d from a join m on a.g = m.g and a.part = m.part), k as (select g, part, count(*) as c, avg(d) as m, var_pop(d) as v from d group by 1, 2),
t as (select g, sum(c)::bigint as n, sum(c * m) / sum(c) as gm, sum(c * v) as ssw from k group by 1),
f as (select t.g, any_value(n) as n, (sum(c * pow(m - gm, 2)) / 2) / (any_value(ssw) / (any_value(n) - 3)) as f from k join t on k.g = t.g group by 1)
select g as event_type, n, {_r("f")} as f, {_r("1 - f / (f + (n - 3) / 2.0)")} as levene_score from f""")
def levene_score(spark, folder):
    return stability.levene_score(series(spark, folder), "value", S, E)


@query(f"with {o.SERIES} select g as event_type, count(*) as n, {_r('regr_slope(x, i)')} as slope, {_r('regr_r2(x, i)')} as r2 from s group by g")
def ols_trend(spark, folder):
    return stability.ols_trend(series(spark, folder), "value", S, E)


_STAT_N = "(count(*) over (partition by g) // 4)"


@query(f"""with {o.SERIES}, n as (select g, count(*) // 4 as w from s group by g), q as (select s.*, w, x - avg(x) over (partition by s.g) as y, avg(x) over (partition by s.g) as gm from s join n on s.g = n.g),
u as (select g, i, w, gm, sum(y) over (partition by g order by i) as s1, sum(y * y) over (partition by g order by i) as s2 from q),
v as (select a.g, a.gm + (a.s1 - coalesce(b.s1, 0)) / a.w as m, greatest(0, (a.s2 - coalesce(b.s2, 0)) / a.w - pow((a.s1 - coalesce(b.s1, 0)) / a.w, 2)) as v from u a left join u b on a.g = b.g and b.i = a.i - a.w where a.i >= a.w - 1),
ma as (select g, m as x from v), va as (select g, v as x from v),
{o.thd_median("ma", "(1 / sqrt(n))", alias="t1")}, xa as (select ma.g, abs(x - q) as x from ma join t1 on ma.g = t1.g), {o.thd_median("xa", "(1 / sqrt(n))", alias="t2")},
{o.thd_median("va", "(1 / sqrt(n))", alias="t3")}, xb as (select va.g, abs(x - q) as x from va join t3 on va.g = t3.g), {o.thd_median("xb", "(1 / sqrt(n))", alias="t4")}
select t1.g as event_type, {_r("greatest(0, least(1, 1 - (1.4826 * t2.q / abs(t1.q) + 1.4826 * t4.q / abs(t3.q)) / 2))")} as stationarity from t1 join t2 on t1.g = t2.g join t3 on t1.g = t3.g join t4 on t1.g = t4.g""")
def stationarity_score(spark, folder):
    return stability.stationarity_score(series(spark, folder), "value", S, E)


def _whole(name: str) -> str:
    """A query's SQL with its values to the last digit."""
    return SQL[name].replace(f", {DIGITS}) + 0.0", ", 14) + 0.0")


@query(f"""with {o.SERIES}, {o.thd_median("s", "(1 / sqrt(n))", alias="a1")}, x1 as (select s.g, abs(x - q) as x from s join a1 on s.g = a1.g), {o.thd_median("x1", "(1 / sqrt(n))", alias="a2")},
tr as ({_whole("ols_trend")}), mk as ({_whole("mann_kendall")}), lv as ({_whole("levene_score")}), st as ({_whole("stationarity_score")}),
v as (select tr.event_type, tr.n, a1.q as median, 1.4826 * a2.q as spread, 1.4826 * a2.q / abs(a1.q) as cv, slope, r2, p as mk_p, levene_score, stationarity
  from tr join a1 on tr.event_type = a1.g join a2 on a1.g = a2.g join mk using (event_type) join lv using (event_type) join st using (event_type)),
w as (select *, (cv > 0.25)::int + (mk_p < 0.05)::int + (levene_score < 0.05)::int + (stationarity < 0.7)::int as signs from v)
select event_type, n, case when n < 50 then 'InsufficientData' when signs = 0 then 'Stable' when signs >= 3 then 'Unstable' else 'Unknown' end as status,
  case when signs < 3 then null when cv > 0.25 then 'HighVariability' when mk_p < 0.05 then 'Trend' when levene_score < 0.05 then 'VarianceChange' else 'NonStationary' end as reason,
  case when signs < 3 then null else {_r("case when cv > 0.25 then cv / 0.25 when mk_p < 0.05 then abs(slope) / 0.01 when levene_score < 0.05 then 1 - levene_score else 1 - stationarity end")} end as severity,
  {_r("case when signs = 0 then 0.95 - cv / 0.25 * 0.2 when signs >= 3 then 0.9 + 0.1 * least(mk_p, levene_score, stationarity) else 0.5 + 0.2 * (2 - signs) end")} as confidence,
  {", ".join(f"{_r(c)} as {c}" for c in ("median", "spread", "cv", "slope", "r2", "mk_p", "levene_score", "stationarity"))} from w""")
def stability_statistical(spark, folder):
    return stability.statistical_verdict(series(spark, folder), "value", S, E)


def _stable_windows(window: int, step: int, p: stability.Parameters) -> str:
    """CTEs ending in w, the windows with their verdicts."""
    weights = o.thd_weights(window, window**-0.5)
    middle = lambda v: f"list_dot_product(list_sort({v}), {weights}::double[])"
    return f"""with {o.SERIES}, l as (select g, i - {window - 1} as i, list(x) over r as v, avg(x) over r as mean, abs(coalesce(regr_slope(x, i) over r, 0)) as trend from s window r as (partition by g order by i rows between {window - 1} preceding and current row)),
l1 as (select *, {middle("v")} as median from l where i >= 0 and i % {step} = 0), l2 as (select *, 1.4826 * {middle("list_transform(v, lambda x: abs(x - median))")} as spread from l1),
l3 as (select *, spread / abs(median) as cv from l2), l4 as (select *, {window} >= {p.min_samples} and cv <= {p.max_cv} and trend <= {p.max_trend} as ok from l3),
w as (select *, case when {window} < {p.min_samples} then 'Unknown' when ok then 'Stable' else 'Unstable' end as status,
  case when ok or {window} < {p.min_samples} then null when trend > {p.max_trend} then 'Trend' when cv > {p.max_cv} then 'VarianceChange' else 'NonStationary' end as reason,
  case when ok or {window} < {p.min_samples} then null when trend > {p.max_trend} then least(1, trend / {p.max_trend}) when cv > {p.max_cv} then least(1, cv / {p.max_cv}) else 0.5 end as severity from l4)"""


_WINDOW_ROWS = f"""select g as event_type, i, {", ".join(f"{_r(c)} as {c}" for c in ("mean", "median", "spread", "cv", "trend"))}, ok as is_stable, status, reason, case when severity is not null then {_r("severity")} end as severity from w"""


@query(f"{_stable_windows(50, 10, stability.DEFAULT)} {_WINDOW_ROWS}")
def stability_windows(spark, folder):
    return stability.windows(series(spark, folder), "value", S, E, window=50, step=10)


_LOOSE = stability.Parameters(max_cv=1.0, max_trend=0.3)


@query(f"""{_stable_windows(50, 1, _LOOSE)}, t as (select *, row_number() over (partition by g order by i) as no from w), u as (select *, coalesce(max(case when not ok then no end) over (partition by g order by i), 0) as broken from t),
k as (select *, no - broken as run from u)
select g as event_type, i, ok as is_stable, run, case when run >= 5 then 'Stable' when run > 0 then 'Transitioning' else status end as tracker_status, case when run > 0 and run < 5 then {_r("run / 5.0")} end as progress, case when run >= 5 then broken + 5 end as stable_at from k""")
def stability_tracker(spark, folder):
    return stability.track(stability.windows(series(spark, folder), "value", S, E, window=50, parameters=_LOOSE), E, _LOOSE).select("event_type", "i", "is_stable", "run", "tracker_status", "progress", "stable_at")


_ONLINE = f"""with {o.SERIES}, a as (select g, i, avg(x) over w as m, coalesce(stddev_samp(x) over w, 0) as sd, case when i = 0 then 0 else abs(regr_slope(x, i) over w) end as t from s window w as (partition by g order by i)),
b as (select *, sd / abs(m) as cv from a), c as (select *, i + 1 >= 50 and cv <= 0.6 and t <= 0.05 as ok from b),
e as (select *, i - coalesce(max(case when not ok then i end) over (partition by g order by i), -1) as run from c)"""


@query(f"""{_ONLINE} select g as event_type, i as idx, {_r("m + 1e-9")} as mean, {_r("cv")} as cv, ok as is_stable, run, case when run >= 5 then 'Stable' when run > 0 then 'Transitioning' when t > 0.05 or cv > 0.6 then 'Unstable' else 'Unknown' end as status from e""")
def stability_online_batch(spark, folder):
    p = stability.Parameters(max_cv=0.6, max_trend=0.05)
    # the shift keeps means that end in 5 from falling to either side
    return stability.online(series(spark, folder), "value", S, E, p).select("event_type", "idx", (F.col("mean") + 1e-9).alias("mean"), "cv", "is_stable", "run", "status")


@query()
def stability_hilbert(spark, folder):
    return stability.hilbert_verdict(series(spark, folder), "value", S, E)


@query()
def stability_composite(spark, folder):
    return stability.composite(series(spark, folder), "value", S, E)


_BROAD = stability.Parameters(max_cv=0.9, max_trend=0.3)


@query(f"{_stable_windows(50, 1, _BROAD)} select g as event_type, min(i) as stable_from from w where ok group by g")
def stability_index(spark, folder):
    return stability.stability_index(series(spark, folder), "value", S, E, parameters=_BROAD)


@query()
def hilbert_signal(spark, folder):
    return signal.hilbert_signal(series(spark, folder), "value", S, E, center=True).drop("x")


# ------------------------------------------------------------------ streams


def _events_stream(spark, folder):
    return read_stream(spark, folder, "events").select("event_type", "ts", "event_id", "value")


@query(f"""{_ONLINE}, n as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
select e.g as event_type, event_id, {_r("cv")} as cv, ok as is_stable, case when run >= 5 then 'Stable' when run > 0 then 'Transitioning' when t > 0.05 or cv > 0.6 then 'Unstable' else 'Unknown' end as status
from e join n on e.g = n.event_type and e.i = n.i""")
def stream_stability(spark, folder):
    p = stability.Parameters(max_cv=0.6, max_trend=0.05)
    rows = available_now(detectors.stream_stability(_events_stream(spark, folder), "event_type", "value", S, parameters=p))
    return rows.select("event_type", "event_id", "cv", "is_stable", "status")


@query(f"""with {o.SERIES}, f as (select g, x from s where i < 20), {o.deviation("f", 0.5)},
l as (select g, i, list(x) over (partition by g order by i rows between {_TERMS - 1} preceding and current row) as v from s where i >= 20),
a as (select l.g, i, center, q, list_dot_product(v, ({_W}::double[])[{_TERMS} - len(v) + 1:]) + pow(0.8, i - 19) * center as ew from l join d on l.g = d.g),
n as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
select a.g as event_type, event_id, {_r("ew")} as ewma, abs(ew - center) > 3 * q as is_alarm from a join n on a.g = n.event_type and a.i = n.i
union all select n.event_type, event_id, case when i = 19 then {_r("center")} else 0.0 end, false from n join d on n.event_type = d.g where i < 20""")
def stream_ewma(spark, folder):
    return available_now(detectors.stream_ewma(_events_stream(spark, folder), "event_type", "value", S)).select("event_type", "event_id", "ewma", "is_alarm")


@query(f"""{_stable_windows(50, 1, _LOOSE)}, t as (select *, row_number() over (partition by g order by i) as no from w), u as (select *, no - coalesce(max(case when not ok then no end) over (partition by g order by i), 0) as run from t),
n as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
select event_type, event_id, coalesce(ok, false) as is_stable, coalesce(run, 0) as run, case when run >= 5 then 'Stable' when run > 0 then 'Transitioning' else coalesce(status, 'Unknown') end as status
from n left join u on u.g = n.event_type and u.i = n.i - 49""")
def stream_tracker(spark, folder):
    # its SQL divides by the median, and 0 / 0 is above every limit there
    return available_now(detectors.stream_tracker(_events_stream(spark, folder), "event_type", "value", S, parameters=_LOOSE, zero_cv=float("inf"))).select("event_type", "event_id", "is_stable", "run", "status")


# ------------------------------------------------------------------ accessors


@query(f"""with {o.SERIES}, r(ref) as (values (20.0::double), (60.0::double)), c as (select g, i, ref, sum(x - ref - 0.5) over w as su, sum(ref - x - 0.5) over w as sd from s, r window w as (partition by g, ref order by i)),
k as (select g, i, ref, su - least(0, min(su) over w) as up, sd - least(0, min(sd) over w) as down from c window w as (partition by g, ref order by i))
select g as event_type, ref as reference, i as idx, {_r("up", 3)} as up, {_r("down", 3)} as down from k""", 3)
def cusum_batch(spark, folder):
    return changepoint.cusum_batch(series(spark, folder), "value", S, [20.0, 60.0], E).drop("x")


@query(f"""with {o.EVENTS}, {_FIXED.format(k="12")} select g as event_type, bin::bigint as bin, {_r("(l + r) / 2")} as center, {_r("r - l")} as width, {_r("c / n")} as frequency, {_r("d / max(d) over (partition by g)")} as normalized from (select hist.*, sum(c) over (partition by g) as n from hist)""")
def hist_bin_values(spark, folder):
    return histogram.bin_values(histogram.fixed_width(events(spark, folder), "value", 12, E), E).select("event_type", "bin", "center", "width", "frequency", "normalized")


@query(f"""with {o.EVENTS}, {_FIXED.format(k="12")} select hist.g as event_type, bin::bigint as bin, count(*) as n from s join hist on s.g = hist.g and x >= l and (x < r or (bin = 11 and x = r)) group by 1, 2""")
def hist_find_bin(spark, folder):
    ev = events(spark, folder)
    return histogram.find_bin(histogram.fixed_width(ev, "value", 12, E), ev, "value", E).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query(f"""with {o.ORDERS}, {_PLAIN}, m as (select group1, group2, (l1 - l2) / {_POOL} as magnitude from duo)
select group1, group2, {_r("abs(magnitude)")} as size, abs(magnitude) >= 0.5 as significant, magnitude > 0 as favors_second from m""")
def effect_accessors(spark, folder):
    from steadfast.functions.expressions import favors_second, is_practically_significant

    m = F.col("magnitude")
    found = effect.cohen_d(orders(spark, folder), "o_orderpriority", "o_totalprice")
    return found.select("group1", "group2", F.abs(m).alias("size"), is_practically_significant(m, "difference").alias("significant"), favors_second(m).alias("favors_second"))


@query(f"""{_EWMA}, {o.thinned(_DRIFTS, 3)}, c as (select al.g, al.i, least(1, al.c) as c from al join kept on al.g = kept.g and al.i = kept.i where least(1, al.c) >= 0.5)
select g as event_type, max(struct_pack(c := c, i := i)).i as idx, {_r("max(c)")} as confidence, 'Drift' as change_type from c group by g""")
def most_confident_change(spark, folder):
    return changepoint.most_confident(changepoint.confident(changepoint.ewma(series(spark, folder), "value", S, E, multiplier=1.5), 0.5), E)


@query(f"{_stable_windows(100, 50, stability.DEFAULT)} {_WINDOW_ROWS}")
def stability_progression(spark, folder):
    return stability.progression(series(spark, folder), "value", S, E, window=100, step=50)


@query(f"""with s as (select l_returnflag as g, l_extendedprice::double as x from lineitem), {o.hd("s", [0.25, 0.5])}
select g as l_returnflag, {", ".join(f'{_r(f"max(case when p = {p} then q end)", 3)} as "l_extendedprice_q{p:.2f}"' for p in (0.25, 0.5))} from h group by g""", 3)
def quantiles_cached(spark, folder):
    lines, cache = Robust(load_table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"]), QuantileCache(HD, most=64)
    lines.quantiles_cached("l_extendedprice", [0.5], HD, cache)
    return lines.quantiles_cached("l_extendedprice", [0.25, 0.5], HD, cache)  # half of its weights are there


@query(f"with {o.EVENTS}, {o.deviation('s', 0.5)} select g as event_type, {_r('q')} as value_mad from d")
def spread_cached(spark, folder):
    return Robust(events(spark, folder), E).spread_cached("value", "mad", QuantileCache(HD))


@query(f"""with {o.EVENTS} select event_type, count(*) as n from (select g as event_type from s) group by 1""")
def group_sizes(spark, folder):
    return samples.sizes(samples.sample(events(spark, folder), "value", E), E)
