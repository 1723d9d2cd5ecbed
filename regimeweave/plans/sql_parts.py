"""Reusable pieces of the DuckDB statements that the Spark results are checked against."""

from __future__ import annotations

from regimeweave.plans.inputs import CENTERS, PERIODS


def r(expr: str, name: str | None = None) -> str:
    """A rounded double column; the sum removes a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def b(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def t(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def bars(by_type: bool = False, hours: int = 1, valid: bool = True) -> str:
    symbol = "event_type" if by_type else "'ALL'"
    having = "HAVING min(value) > 0" if valid else ""
    key = "struct_pack(a := ts, b := event_id)"
    return f"""bars AS (
  SELECT {symbol} AS symbol, time_bucket(INTERVAL '{hours} hours', ts) AS open_time,
         arg_min(value, {key}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {key}) AS close
  FROM events GROUP BY 1, 2 {having})"""


def idx(hours: int = 1) -> str:
    return f"""idx AS (
  SELECT *, row_number() OVER w - 1 AS row_index, count(*) OVER (PARTITION BY symbol) - 1 AS max_index,
         lag(open_time) OVER w AS prev_time, lead(open_time) OVER w AS next_time,
         CASE WHEN open_time - lag(open_time) OVER w = INTERVAL '{hours} hours' THEN 1 ELSE 0 END AS step_ok,
         ln(close / lag(close) OVER w) AS ret
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""


def cand(n: int = 30, name: str = "cand") -> str:
    m = n - 1
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_index + {m} AS stop_index, lead(open_time, {m}) OVER w AS stop_time,
           sum(step_ok) OVER (w ROWS BETWEEN 1 FOLLOWING AND {m} FOLLOWING) AS oks,
           ln(lead(close, {m}) OVER w / open) AS log_return, lead(close, {m}) OVER w AS last_close,
           stddev_pop(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND {m} FOLLOWING) AS volatility,
           avg(abs(ret)) OVER (w ROWS BETWEEN 1 FOLLOWING AND {m} FOLLOWING) AS mean_abs_return,
           max(high) OVER (w ROWS BETWEEN CURRENT ROW AND {m} FOLLOWING) AS top,
           min(low) OVER (w ROWS BETWEEN CURRENT ROW AND {m} FOLLOWING) AS bottom
    FROM idx WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
  WHERE row_index <= max_index - {m})"""


def win(n: int = 30, name: str = "win", source: str = "cand") -> str:
    return f"""{name} AS (
  SELECT *, row_index AS start_index, open_time AS start_time,
         'sample_' || row_index || '_' || stop_index AS sample_name
  FROM {source} WHERE oks = {n - 1})"""


def _distance(i: int) -> str:
    x, y = CENTERS[i]
    return f"sqrt((log_return - ({x})) * (log_return - ({x})) + (volatility - ({y})) * (volatility - ({y}))) AS d{i}"


NEAREST = "CASE WHEN {p}0 <= {p}1 AND {p}0 <= {p}2 THEN 0 WHEN {p}1 <= {p}2 THEN 1 ELSE 2 END"


def lab() -> str:
    return f"""dist AS (SELECT *, {_distance(0)}, {_distance(1)}, {_distance(2)} FROM win),
lab AS (SELECT *, {NEAREST.format(p='d')} AS cluster_id, list_sort([d0, d1, d2]) AS ds FROM dist)"""


def pair(hours: int = 1, n: int = 30) -> str:
    return f"""pair AS (
  SELECT i.symbol, i.symbol || '__' || i.sample_name || '__to__' || t.sample_name AS pair_id,
         i.sample_name AS input_sample_name, t.sample_name AS target_sample_name,
         i.start_index AS input_start_index, i.stop_index AS input_stop_index,
         t.start_index AS target_start_index, t.stop_index AS target_stop_index,
         i.start_time AS input_start_time, i.stop_time AS input_stop_time,
         t.start_time AS target_start_time, t.stop_time AS target_stop_time,
         i.cluster_id AS input_cluster_id, t.cluster_id AS target_cluster_id,
         i.d0 AS i0, i.d1 AS i1, i.d2 AS i2, t.d0 AS t0, t.d1 AS t1, t.d2 AS t2, t.ds AS ts
  FROM lab i JOIN lab t ON i.symbol = t.symbol AND t.start_time = i.start_time + INTERVAL '{n * hours} hours'
  WHERE t.start_time - i.stop_time = INTERVAL '{hours} hours')"""


def partition_case(start: str = "input_start_time", stop: str = "target_stop_time") -> str:
    whens = " ".join(
        f"WHEN {start} >= TIMESTAMP '{lo}' AND {stop} <= TIMESTAMP '{hi}' THEN '{name}'" for name, (lo, hi) in PERIODS.items()
    )
    return f"CASE {whens} END"


def parts() -> str:
    return f"""marked AS (SELECT *, {partition_case()} AS "partition" FROM pair),
parts AS (
  SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY input_start_time, pair_id) - 1 AS chronological_rank
  FROM marked WHERE "partition" IS NOT NULL)"""


def soft(floor: float = 0.1, percentile: float = 0.99) -> str:
    """Order, temperature, limits, memberships and flags of the pairs in ``parts``."""
    return f"""ord AS (
  SELECT *, {NEAREST.format(p='t')} AS near, ts[1] AS n1, ts[2] AS n2, ts[3] AS n3, ts[2] - ts[1] AS gap FROM parts),
tau AS (SELECT quantile_cont(gap, 0.5) AS tau FROM ord WHERE "partition" = 'train' AND gap > 1e-12),
lim AS (SELECT near AS class, quantile_cont(n1, {percentile}) AS lim FROM ord WHERE "partition" = 'train' GROUP BY 1),
aff AS (SELECT o.*, tau, lim, exp((n1 - t0) / tau) AS a0, exp((n1 - t1) / tau) AS a1, exp((n1 - t2) / tau) AS a2
        FROM ord o CROSS JOIN tau JOIN lim ON lim.class = o.near),
mem AS (SELECT *, a0 / (a0 + a1 + a2) AS m0, a1 / (a0 + a1 + a2) AS m1, a2 / (a0 + a1 + a2) AS m2 FROM aff),
ent AS (SELECT *, -(m0 * ln(greatest(m0, 1e-12)) + m1 * ln(greatest(m1, 1e-12)) + m2 * ln(greatest(m2, 1e-12))) AS entropy FROM mem),
ann AS (SELECT *, entropy / ln(3.0) AS nent, least(greatest(1 - entropy / ln(3.0), 0), 1) AS cert,
               {floor} + {1 - floor} * least(greatest(1 - entropy / ln(3.0), 0), 1) AS cw,
               n1 > lim AS outlier, greatest(m0, m1, m2) AS mmax FROM ent),
kept AS (SELECT * FROM ann WHERE "partition" = 'train' AND NOT outlier)"""


def base(by_type: bool = False, upto: str = "soft") -> str:
    """The usual chain of common table expressions up to the named one."""
    chain = [
        ("bars", bars(by_type)), ("idx", idx()), ("cand", cand()), ("win", win()), ("lab", lab()),
        ("pair", pair()), ("parts", parts()), ("soft", soft()),
    ]
    names = [n for n, _ in chain]
    return "WITH " + ",\n".join(text for _, text in chain[: names.index(upto) + 1])


def classes(k: int = 3) -> str:
    return f"(SELECT unnest(range({k})) AS c)"


def macro_f1(cell, k: int = 3) -> str:
    """Macro-F1 over observed labels; ``cell(a, p)`` names a count column."""
    tops, counts = [], []
    for i in range(k):
        support = " + ".join(cell(i, j) for j in range(k))
        chosen = " + ".join(cell(j, i) for j in range(k))
        tops.append(f"CASE WHEN {support} + {chosen} > 0 THEN 2.0 * {cell(i, i)} / ({support} + {chosen}) ELSE 0 END")
        counts.append(f"CASE WHEN {support} + {chosen} > 0 THEN 1 ELSE 0 END")
    return f"(({' + '.join(tops)}) / nullif({' + '.join(counts)}, 0))"


def cells(actual: str = "actual", predicted: str = "predicted", k: int = 3) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {actual} = {a} AND {predicted} = {p}) AS c{a}{p}" for a in range(k) for p in range(k)
    )


def metric_columns(k: int = 3) -> list[str]:
    cell = lambda a, p: f"c{a}{p}"
    n = " + ".join(cell(a, p) for a in range(k) for p in range(k))
    hits = " + ".join(cell(i, i) for i in range(k))
    recalls, present, weighted = [], [], []
    for i in range(k):
        support = "(" + " + ".join(cell(i, j) for j in range(k)) + ")"
        chosen = "(" + " + ".join(cell(j, i) for j in range(k)) + ")"
        recalls.append(f"CASE WHEN {support} > 0 THEN {cell(i, i)} / {support} ELSE 0 END")
        present.append(f"CASE WHEN {support} > 0 THEN 1 ELSE 0 END")
        weighted.append(f"CASE WHEN {support} + {chosen} > 0 THEN 2.0 * {cell(i, i)} / ({support} + {chosen}) * {support} ELSE 0 END")
    return [
        b(f"({n})", "samples"),
        r(f"({hits}) / nullif({n}, 0)", "accuracy"),
        r(f"({' + '.join(recalls)}) / nullif({' + '.join(present)}, 0)", "balanced_accuracy"),
        r(macro_f1(cell, k), "macro_f1"),
        r(f"({' + '.join(weighted)}) / nullif({n}, 0)", "weighted_f1"),
    ]
