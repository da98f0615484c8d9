"""The panels of sources.panels as DuckDB common table expressions."""

from __future__ import annotations

from ..sources.panels import DIMENSIONS, EVENTS, FLAGS, PRIORITIES, STATUSES


def _sum(value: str, test: str | None = None) -> str:
    return f"round(sum({value}) FILTER (WHERE {test}), 2)" if test else f"round(sum({value}), 2)"


def _mean(value: str, test: str | None = None) -> str:
    where = f" FILTER (WHERE {test})" if test else ""
    return f"{_sum(value, test)} / nullif(count({value}){where}, 0)"


ORDERS_DAILY = (
    "orders_daily AS (SELECT o_orderdate::DATE AS ts, "
    + ", ".join(f"{_sum('o_totalprice', f'o_orderpriority = {chr(39)}{p}{chr(39)}')} AS {n}" for n, p in PRIORITIES.items())
    + f", {_sum('o_totalprice')} AS total, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1)"
)
LINEITEM_DAILY = (
    "lineitem_daily AS (SELECT l_shipdate::DATE AS ts, "
    + ", ".join(f"{_mean(f'l_{c}')} AS {n}" for n, c in (("price", "extendedprice"), ("discount", "discount"), ("tax", "tax"), ("quantity", "quantity")))
    + ", "
    + ", ".join(f"{_mean('l_extendedprice', f'l_returnflag = {chr(39)}{f}{chr(39)}')} AS price_{f.lower()}" for f in FLAGS)
    + " FROM lineitem GROUP BY 1)"
)
EVENTS_HOURLY = (
    "events_hourly AS (SELECT date_trunc('hour', ts) AS ts, "
    + ", ".join(f"{_mean('value', f'event_type = {chr(39)}{e}{chr(39)}')} AS {e}" for e in EVENTS)
    + " FROM events GROUP BY 1)"
)
EMBEDDING_MATRIX = "embedding_matrix AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k + 1:02d}" for k in range(DIMENSIONS)) + " FROM embeddings)"
FOLD_STATS = """fold_cents AS (SELECT strftime(o_orderdate, '%Y-%m') AS fold_id, o_orderpriority AS feature_name, round(sum(o_totalprice) * 100)::BIGINT AS c FROM orders GROUP BY 1, 2),
fold_flags AS (SELECT *, c % 10 <> 0 AS eligible FROM fold_cents),
fold_more AS (SELECT *, CASE WHEN NOT eligible THEN 'coverage_below_minimum' END AS quality_reason, eligible AND c % 2 = 0 AS direct_participation, eligible AND c % 3 = 0 AS pc_participation,
  eligible AND c % 5 < 3 AS representative, eligible AND c % 7 < 5 AS sffs_participation FROM fold_flags),
fold_final AS (SELECT *, CASE WHEN pc_participation THEN (c % 1000)::DOUBLE / 1000 END AS pca_credit, sffs_participation AND c % 11 < 4 AS final_selection FROM fold_more),
fold_stats AS (SELECT *, CASE WHEN final_selection THEN ((c % 2001) - 1000)::DOUBLE / 1000 END AS ablation_loss FROM fold_final)"""


def _shares(name: str, source: str, day: str, key: str, values: tuple[str, ...], price: str) -> str:
    sums = ", ".join(f"{_sum(price, f'{key} = {chr(39)}{v}{chr(39)}')} AS s{k}" for k, v in enumerate(values))
    total = " + ".join(f"s{k}" for k in range(len(values)))
    shares = ", ".join(f"s{k} / ({total})" for k in range(len(values)))
    return f"{name}_sums AS (SELECT {day}::DATE AS ts, {sums} FROM {source} GROUP BY 1), {name} AS (SELECT ts, [{shares}] AS v FROM {name}_sums WHERE {total} > 0)"


PROB_PAIRS = ", ".join(
    [
        _shares("shares_p", "lineitem", "l_shipdate", "l_returnflag", FLAGS, "l_extendedprice"),
        _shares("shares_q", "orders", "o_orderdate", "o_orderstatus", STATUSES, "o_totalprice"),
        "prob_pairs AS (SELECT shares_p.ts, shares_p.v AS p, shares_q.v AS q FROM shares_p JOIN shares_q USING (ts))",
    ]
)


def with_panels(*panels: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join(panels)
