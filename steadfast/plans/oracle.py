"""DuckDB SQL for the registered queries, from small templates.

Harrell-Davis weights are integrals of a beta density over intervals of 1 / n; here they are sums over 16 Gauss-Legendre
nodes of its exponential form, scaled to sum to 1, another way than the incomplete beta function of the library.
"""

from __future__ import annotations

import numpy as np

_X, _W = np.polynomial.legendre.leggauss(16)
NODES = ", ".join(f"({(x + 1) / 2!r}::double, {w / 2!r}::double)" for x, w in zip(_X.tolist(), _W.tolist(), strict=True))


def hd(source: str, ps: list[float], key: str = "g", alias: str = "h") -> str:
    """CTEs ending in {alias}({key}, n, p, q, m2): Harrell-Davis quantiles of source({key}, x)."""
    values = ", ".join(f"({p!r}::double)" for p in ps)
    return f"""
{alias}_r as (select {key}, x, row_number() over (partition by {key} order by x) as r, (count(*) over (partition by {key}))::double as n from {source}),
{alias}_p(p) as (values {values}), {alias}_n(u, gw) as (values {NODES}),
{alias}_c as (select *, (n + 1) * p as a, (n + 1) * (1 - p) as b from {alias}_r, {alias}_p where abs((r - 0.5) / n - p) < 10 * sqrt(p * (1 - p) / n) + 10 / n),
{alias}_w as (
  select {key}, n, p, r, any_value(x) as x,
         sum(gw * exp((a - 1) * ln(((r - 1 + u) / n) / ((a - 1) / (a + b - 2))) + (b - 1) * ln((1 - (r - 1 + u) / n) / (1 - (a - 1) / (a + b - 2))))) as w
  from {alias}_c, {alias}_n group by {key}, n, p, r
),
{alias} as (select {key}, n::bigint as n, p, sum(w * x) / sum(w) as q, sum(w * x * x) / sum(w) as m2 from {alias}_w group by {key}, n, p)"""


def thd_median(source: str, width: str, key: str = "g", alias: str = "t") -> str:
    """CTEs ending in {alias}({key}, n, q): trimmed Harrell-Davis medians; width is SQL of n. The interval is centred at 0.5."""
    return f"""
{alias}_r as (select {key}, x, row_number() over (partition by {key} order by x) as r, (count(*) over (partition by {key}))::double as n from {source}),
{alias}_n(u, gw) as (values {NODES}),
{alias}_i as (select *, (n + 1) / 2 as a, greatest((r - 1) / n, 0.5 - {width} / 2) as lo, least(r / n, 0.5 + {width} / 2) as hi from {alias}_r),
{alias}_w as (
  select {key}, n, r, any_value(x) as x, any_value(hi - lo) * sum(gw * exp((a - 1) * (ln(2 * (lo + (hi - lo) * u)) + ln(2 * (1 - lo - (hi - lo) * u))))) as w
  from {alias}_i, {alias}_n where hi > lo group by {key}, n, r
),
{alias} as (select {key}, n::bigint as n, sum(w * x) / sum(w) as q from {alias}_w group by {key}, n)"""


def deviation(source: str, p: float, key: str = "g", alias: str = "d") -> str:
    """CTEs ending in {alias}({key}, n, center, q): the p-quantile of absolute deviations from the median."""
    return f"""{hd(source, [0.5], key, f"{alias}m")},
{alias}_x as (select s.{key}, abs(s.x - m.q) as x from {source} s join {alias}m m on s.{key} = m.{key}),
{hd(f"{alias}_x", [p], key, f"{alias}q")},
{alias} as (select a.{key}, a.n, b.q as center, a.q from {alias}q a join {alias}m b on a.{key} = b.{key})"""


def thd_weights(n: int, width: float) -> list[float]:
    """The weights of a trimmed Harrell-Davis median of n values, by the same sums as thd_median."""
    a = (n + 1) / 2
    lo, hi = np.maximum(np.arange(n) / n, 0.5 - width / 2), np.minimum(np.arange(1, n + 1) / n, 0.5 + width / 2)
    u = lo[:, None] + (hi - lo)[:, None] * (_X + 1)[None, :] / 2
    w = np.where(hi > lo, (hi - lo) * (np.where(hi[:, None] > lo[:, None], 4 * u * (1 - u), 0) ** (a - 1) * _W / 2).sum(1), 0.0)
    return (w / w.sum()).tolist()


def student_quantile(df: int, p: float) -> float:
    """Of Student's t, by halving: with t = sqrt(df) tan(y) its density is a power of cos(y)."""
    x, w = np.polynomial.legendre.leggauss(300)
    area = lambda y: float((w * np.cos((x + 1) / 2 * y) ** (df - 1)).sum() * y / 2)
    lo, hi, half = 0.0, np.pi / 2, area(np.pi / 2)
    for _ in range(60):
        y = (lo + hi) / 2
        lo, hi = (y, hi) if area(y) < (2 * p - 1) * half else (lo, y)
    return float(np.sqrt(df) * np.tan(lo))


def thinned(alarms: str, tolerance: int, source: str = "al", alias: str = "kept") -> str:
    """CTEs ending in {alias}(g, i): of alarms (g, i) those kept in order, the next one being the first beyond the tolerance."""
    return f"""{source} as ({alarms}), {alias}_n as materialized (select a.g, a.i, min(b.i) as j from {source} a asof join {source} b on a.g = b.g and a.i + {tolerance} < b.i group by a.g, a.i),
{alias} as (with recursive t as (select g, min(i) as i from {source} group by g union all select n.g, n.j from t join {alias}_n n on n.g = t.g and n.i = t.i) select * from t)"""


def thinned_lists(source: str, tolerance: int, alias: str = "kept") -> str:
    """CTEs ending in {alias}(g, l, i): as thinned(), for alarms (g, l, i) in two lists, the second after the first."""
    return f"""{alias}_n as materialized (select a.g, a.l, a.i, min(b.i) filter (where b.l = a.l and b.i > a.i + {tolerance}) as j, min(b.i) filter (where b.l > a.l and abs(b.i - a.i) > {tolerance}) as k
  from {source} a join {source} b on a.g = b.g group by a.g, a.l, a.i),
{alias} as (with recursive t as (
  select g, min(l) as l, arg_min(i, (l, i)) as i from {source} group by g
  union all select n.g, case when n.j is null then 1 else n.l end, coalesce(n.j, n.k) from t join {alias}_n n on n.g = t.g and n.l = t.l and n.i = t.i where coalesce(n.j, n.k) is not null) select * from t)"""


EVENTS = "s as (select event_type as g, value::double as x from events)"
ORDERS = "s as (select o_orderpriority as g, o_totalprice::double as x from orders)"
SERIES = "s as (select event_type as g, row_number() over (partition by event_type order by ts, event_id) - 1 as i, value::double as x from events)"
