"""The views as SQL, for the comparison queries."""

TRADES = """trades AS (SELECT event_type AS product_id, concat('t', event_id) AS trade_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS ingest_seq,
 CASE user_id % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' ELSE 'Unknown' END AS side, value AS price, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS size FROM events)"""
L2 = """l2 AS (SELECT event_type AS product_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, 0 AS ord,
 CASE WHEN (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 500 = 0 THEN 'snapshot' ELSE 'update' END AS kind,
 CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CAST(floor(value) AS DOUBLE) AS price,
 CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS quantity FROM events)"""
FILINGS = """filings AS (SELECT concat('C', o_custkey % 500) AS ticker, o_orderkey AS accession_no, CAST(o_orderdate AS DATE) AS filing_date,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN '4' WHEN '2' THEN '10-K' WHEN '3' THEN '10-Q' WHEN '4' THEN '8-K' ELSE 'DEF 14A' END AS form FROM orders)"""
INSIDER = """insider AS (SELECT concat('P', l_partkey % 200) AS ticker, l_orderkey AS accession_no, s_name AS owner_name, CAST(l_shipdate AS DATE) AS transaction_date,
 CASE l_linenumber WHEN 1 THEN 'P' WHEN 2 THEN 'S' WHEN 3 THEN 'A' WHEN 4 THEN 'F' WHEN 5 THEN 'M' WHEN 6 THEN 'G' ELSE 'K' END AS transaction_code,
 l_quantity AS shares, l_extendedprice / l_quantity AS price_per_share, l_returnflag = 'R' AS is_derivative FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
CODES = """codes AS (SELECT * FROM (VALUES ('P', 'Purchase', true, false), ('S', 'Sale', false, true), ('A', 'Award', true, false), ('F', 'Tax Withholding', false, true),
 ('M', 'Option Exercise', true, false), ('G', 'Gift', true, false)) AS c(transaction_code, description, is_buy, is_sell)),
coded AS (SELECT i.*, coalesce(c.description, 'Unknown') AS description, coalesce(c.is_buy, false) AS is_buy, coalesce(c.is_sell, false) AS is_sell FROM insider i LEFT JOIN codes c USING (transaction_code))"""
FACTS = """facts AS (SELECT o_custkey AS cik, 'us-gaap' AS taxonomy,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN '2' THEN 'NetIncomeLoss' WHEN '3' THEN 'Assets' WHEN '4' THEN 'Liabilities' ELSE 'StockholdersEquity' END AS concept,
 CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'shares' ELSE 'EUR' END AS unit, CAST(o_orderdate AS DATE) AS end_date, o_totalprice AS val, o_orderkey AS pos,
 CASE WHEN o_orderkey % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM orders)"""
LATEST = """ranked AS (SELECT f.*, row_number() OVER (PARTITION BY cik, concept ORDER BY CASE WHEN unit = 'USD' THEN 0 WHEN unit = 'shares' THEN 1 ELSE 2 END, end_date DESC, pos) AS rk FROM facts f),
latest AS (SELECT * FROM ranked WHERE rk = 1)"""

#: Changes of levels, intervals, and the book on a grid of {step} ms.
BOOK = (
    L2
    + """,
gen AS (SELECT * FROM (SELECT *, max(CASE WHEN kind = 'snapshot' THEN seq END) OVER (PARTITION BY product_id ORDER BY seq) AS generation FROM l2) WHERE generation IS NOT NULL),
chg AS (SELECT * FROM (SELECT product_id, ts_ms, seq, generation, side, CAST(round(price) AS BIGINT) AS tick, greatest(quantity, 0.0) AS qty,
 coalesce(lag(greatest(quantity, 0.0)) OVER (PARTITION BY product_id, generation, side, CAST(round(price) AS BIGINT) ORDER BY seq), 0.0) AS prev_qty FROM gen) WHERE qty <> prev_qty),
ends AS (SELECT product_id, seq AS generation, lead(ts_ms) OVER (PARTITION BY product_id ORDER BY seq) AS end_ms FROM l2 WHERE kind = 'snapshot'),
held AS (SELECT c.*, coalesce(lead(c.ts_ms) OVER (PARTITION BY c.product_id, c.generation, c.side, c.tick ORDER BY c.seq), e.end_ms) AS to_ms
 FROM chg c LEFT JOIN ends e USING (product_id, generation)),
intervals AS (SELECT product_id, side, tick, qty, ts_ms AS from_ms, to_ms FROM held WHERE qty > 0 AND (to_ms IS NULL OR to_ms > ts_ms))"""
)


def grid(step: int) -> str:
    """grid: constant stretches by grid place; sampled: a row for each place."""
    return f""",
lastg AS (SELECT product_id, CAST(ceil(max(ts_ms) / {step}.0) AS BIGINT) + 1 AS last_to FROM chg GROUP BY product_id),
grid AS (SELECT * FROM (SELECT product_id, side, tick, qty, CAST(ceil(ts_ms / {step}.0) AS BIGINT) AS from_g, coalesce(CAST(ceil(to_ms / {step}.0) AS BIGINT), last_to) AS to_g
 FROM held JOIN lastg USING (product_id)) WHERE qty > 0 AND from_g < to_g),
sampled AS (SELECT product_id, g, side, tick, qty FROM (SELECT *, unnest(range(from_g, to_g)) AS g FROM grid))"""


def slices(step: int, resolution: int, timeframes: list[int]) -> str:
    return (
        grid(step)
        + f""",
quant AS (SELECT product_id, g, side, CAST(round(tick / {resolution}.0) AS BIGINT) AS tick, sum(qty) AS qty FROM sampled GROUP BY ALL),
tfs AS (SELECT unnest([{", ".join(map(str, timeframes))}]::BIGINT[]) AS timeframe_ms),
metrics AS (SELECT product_id, timeframe_ms, (g * {step} // timeframe_ms) * timeframe_ms AS slice_start, side, tick, sum(qty) AS total, count(*) AS snapshot_count, max(qty) AS max, min(qty) AS min,
 min(g) * {step} AS first_seen, max(g) * {step} AS own_last, sum(qty) / count(*) AS avg FROM quant, tfs GROUP BY ALL),
slices AS (SELECT *, max(own_last) OVER (PARTITION BY product_id, timeframe_ms, slice_start) AS slice_last FROM metrics),
pers AS (SELECT *, slice_start = max(slice_start) OVER (PARTITION BY product_id, timeframe_ms) AS is_open,
 CASE WHEN slice_last > first_seen THEN (slice_last - first_seen) / timeframe_ms::DOUBLE ELSE 0.0 END AS persistence FROM slices),
scored AS (SELECT *, CASE WHEN (is_open AND snapshot_count > 2) OR (NOT is_open AND persistence > 0.8) THEN avg ELSE 0.0 END AS resting FROM pers)"""
    )
