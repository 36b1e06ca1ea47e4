"""The catalogue's queries as DuckDB SQL over the same tables.

Named building blocks are joined into one WITH list per query; a block lists the blocks it reads.
Queries that fit models, or read back what they published, have no SQL twin.
"""

from __future__ import annotations

from lapsewise.functions import fixed

_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}
TWINS: dict[str, str] = {}


def block(name: str, sql: str, *reads: str) -> None:
    _BLOCKS[name] = (reads, sql.strip())


def twin(name: str, sql: str, *reads: str) -> None:
    wanted: list[str] = []

    def collect(block_name: str) -> None:
        if block_name in wanted:
            return
        for other in _BLOCKS[block_name][0]:
            collect(other)
        wanted.append(block_name)

    for r in reads:
        collect(r)
    blocks = ",\n".join(f"{n} AS ({_BLOCKS[n][1]})" for n in wanted)
    recursive = "RECURSIVE " if any(n.endswith(("replay", "rounds")) for n in wanted) else ""
    TWINS[name] = (f"WITH {recursive}{blocks}\n" if blocks else "") + sql.strip()


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _case(subject: str, mapping: dict) -> str:
    return f"CASE {subject} " + " ".join(
        f"WHEN {k if isinstance(k, int) else _quoted([k])} THEN {_quoted([v])}" for k, v in mapping.items()
    ) + " END"


def _bins(value: str, bins, order: bool = False) -> str:
    parts, last = [], "NULL"
    for i, (upper, name) in enumerate(bins):
        label = str(i) if order else _quoted([name])
        if upper is None:
            last = label
        else:
            parts.append(f"WHEN {value} <= {upper} THEN {label}")
    return f"CASE {' '.join(parts)} ELSE {last} END"


# Lines -----------------------------------------------------------------------------------

block("raw", """
  SELECT o_custkey AS customer_id,
    CASE p_size WHEN 1 THEN 'POST' WHEN 2 THEN 'TEST001' WHEN 3 THEN 'C3' WHEN 4 THEN 'gift_0001_20'
      WHEN 5 THEN 'DCGS0058' WHEN 6 THEN lpad(split_part(p_brand, '#', 2), 5, '0') || 'A '
      ELSE lpad(split_part(p_brand, '#', 2), 5, '0') || 'A' END AS raw_stock_code,
    CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'A' ELSE '' END
      || CAST(l_orderkey AS VARCHAR) AS invoice,
    p_name AS description,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
    greatest(500.0::DOUBLE, round(l_extendedprice / l_quantity / 500) * 500) AS price,
    CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END AS invoice_date,
    'Y' || CAST(year(CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END) AS VARCHAR) AS source_sheet,
    n_name AS country, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS ext
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
block("tagged", f"""
  SELECT *, trim(raw_stock_code) AS stock_code,
    CASE WHEN regexp_extract(invoice, '^[A-Za-z]+') = '' THEN 'sale'
      WHEN regexp_extract(invoice, '^[A-Za-z]+') = 'C' THEN 'cancellation'
      WHEN regexp_extract(invoice, '^[A-Za-z]+') = 'A' THEN 'adjustment' ELSE 'other' END AS invoice_type,
    CASE WHEN trim(raw_stock_code) IN ({_quoted(fixed.OPERATIONAL_CODES)}) THEN 'operational_fee'
      WHEN trim(raw_stock_code) IN ({_quoted(fixed.TEST_CODES)}) THEN 'test_dummy'
      WHEN trim(raw_stock_code) IN ({_quoted(fixed.UNCLEAR_CODES)}) THEN 'unclear'
      WHEN starts_with(trim(raw_stock_code), 'gift_0001_') THEN 'gift_voucher'
      WHEN regexp_full_match(trim(raw_stock_code), '[0-9]{{5}}[A-Za-z]{{0,2}}') THEN 'product_standard'
      ELSE 'product_alt_sku' END AS stockcode_category
  FROM raw
""", "raw")
block("excluded", f"""
  SELECT *, CASE WHEN invoice_type = 'adjustment' THEN 'adjustment'
      WHEN stockcode_category IN ({_quoted(fixed.EXCLUDED_CATEGORIES)}) THEN stockcode_category
      WHEN customer_id IS NULL THEN 'no_customer' ELSE 'kept' END AS exclusion_reason
  FROM tagged
""", "tagged")
block("model", "SELECT * FROM excluded WHERE exclusion_reason = 'kept'", "excluded")

twin("invoice_type_counts", """
SELECT invoice_type, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tagged GROUP BY 1
""", "tagged")
twin("invoice_prefix_counts", """
SELECT regexp_extract(invoice, '^[A-Za-z]*') AS prefix, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM raw GROUP BY 1
""", "raw")
twin("stock_category_summary", """
SELECT stockcode_category, count(*) AS rows, count(DISTINCT stock_code) AS codes, sum(quantity) AS net_quantity,
  sum(quantity * price) AS net_revenue FROM tagged GROUP BY 1
""", "tagged")
twin("special_code_summary", """
SELECT stockcode_category, stock_code, count(*) AS rows, sum(quantity) AS net_quantity,
  sum(quantity * price) AS net_revenue, min(description) AS sample_description
FROM tagged WHERE stockcode_category <> 'product_standard' GROUP BY 1, 2
""", "tagged")
twin("clean_transactions", """
SELECT customer_id, stock_code, invoice, line::BIGINT AS line, part, supplier, quantity, price,
  CAST(invoice_date::DATE AS VARCHAR) AS invoice_date, quantity * price AS revenue, invoice_type, stockcode_category
FROM model
""", "model")
twin("ingested_lines", """
SELECT customer_id, stock_code, invoice, quantity, price, CAST(invoice_date::DATE AS VARCHAR) AS invoice_date, invoice_type,
  stockcode_category, count(*) AS lines, round(sum(quantity * price), 6) AS revenue, min(description) AS first_description
FROM model GROUP BY ALL
""", "model")
twin("excluded_lines", """
SELECT exclusion_reason, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM excluded GROUP BY 1
""", "excluded")
twin("anomaly_counts", """
SELECT invoice_type, count(*) AS rows, count(*) FILTER (price = 0) AS zero_price,
  count(*) FILTER (price < 0) AS negative_price, count(*) FILTER (quantity > 0) AS positive_quantity,
  count(*) FILTER (quantity < 0) AS negative_quantity,
  count(*) FILTER (quantity < 0 AND invoice_type <> 'cancellation') AS unexplained_negative,
  count(*) FILTER (raw_stock_code <> stock_code) AS codes_with_whitespace,
  count(*) FILTER (customer_id IS NULL) AS no_customer
FROM tagged GROUP BY 1
""", "tagged")
_PROFILED = {
    "customer_id": "customer_id", "stock_code": "raw_stock_code", "invoice": "invoice", "quantity": "quantity",
    "price": "price", "invoice_date": "invoice_date", "country": "country", "source_sheet": "source_sheet",
}
twin("table_profile", " UNION ALL ".join(f"""
SELECT '{n}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls,
  count(DISTINCT {c}) AS distinct_values FROM raw""" for n, c in _PROFILED.items()), "raw")
twin("numeric_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS rows, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75 FROM model""" for c in ("quantity", "price")), "model")
twin("country_shares", """
SELECT country, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM model GROUP BY 1
""", "model")
twin("top_countries_and_other", """
SELECT CASE WHEN place <= 10 THEN country ELSE 'Other' END AS country, sum(rows)::BIGINT AS rows
FROM (SELECT country, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, country) AS place
      FROM model GROUP BY 1) GROUP BY 1
""", "model")
twin("documentation_checks", """
, facts AS (
  SELECT count(DISTINCT customer_id)::VARCHAR AS customers, count(DISTINCT country)::VARCHAR AS countries,
    min(invoice_date)::DATE::VARCHAR AS first_day,
    round(avg(CASE WHEN country = 'NATION_1' THEN 1.0 ELSE 0.0 END), 6)::VARCHAR AS home_share FROM raw)
SELECT fact, found, documented, (found = documented)::BIGINT AS agrees FROM (
  SELECT 'customers' AS fact, customers AS found, '1500' AS documented FROM facts
  UNION ALL SELECT 'countries', countries, '25' FROM facts
  UNION ALL SELECT 'first_day', first_day, '1995-01-01' FROM facts
  UNION ALL SELECT 'home_share', home_share, '0.04' FROM facts)
""", "raw")
TWINS["documentation_checks"] = TWINS["documentation_checks"].replace(")\n, facts", "),\nfacts")
twin("monthly_line_counts", """
SELECT CAST(m::DATE AS VARCHAR) AS month, count(invoice) AS rows
FROM (SELECT unnest(generate_series(date_trunc('month', min(invoice_date)), date_trunc('month', max(invoice_date)),
        INTERVAL 1 MONTH)) AS m FROM model) LEFT JOIN model ON date_trunc('month', invoice_date) = m GROUP BY 1
""", "model")

# Netting ---------------------------------------------------------------------------------

_ORDER = "ORDER BY invoice_date, invoice, line, part, supplier, quantity, ext ROWS BETWEEN"
_UP = f"{_ORDER} UNBOUNDED PRECEDING AND CURRENT ROW"
_DOWN = f"{_ORDER} CURRENT ROW AND UNBOUNDED FOLLOWING"


def _stock(name: str, keys: str) -> None:
    block(f"{name}_run", f"""
  SELECT *, sum(quantity) OVER (PARTITION BY {keys} {_UP}) AS p,
    sum(greatest(quantity, 0)) OVER (PARTITION BY {keys} {_UP}) AS sold FROM model
""", "model")
    block(f"{name}_stock", f"""
  SELECT *, p - least(0, min(p) OVER (PARTITION BY {keys} {_UP})) AS stock FROM {name}_run
""", f"{name}_run")


_stock("fifo", "customer_id, stock_code")
_stock("lifo", "customer_id, stock_code, price")
block("fifo", """
  SELECT *, CASE WHEN quantity > 0 THEN greatest(0, least(quantity,
    sold - max(sold - stock) OVER (PARTITION BY customer_id, stock_code))) ELSE 0 END AS remaining_quantity
  FROM fifo_stock
""", "fifo_stock")
block("lifo", f"""
  SELECT *, CASE WHEN quantity > 0 THEN greatest(0, least(quantity,
    min(stock) OVER (PARTITION BY customer_id, stock_code, price {_DOWN}) - (stock - quantity))) ELSE 0 END
    AS remaining_quantity FROM lifo_stock
""", "lifo_stock")
block("bought", "SELECT *, remaining_quantity * price AS net_revenue FROM fifo WHERE remaining_quantity > 0", "fifo")
block("bought_lifo", "SELECT *, remaining_quantity * price AS net_revenue FROM lifo WHERE remaining_quantity > 0", "lifo")


def _replay(name: str, source: str, keys: tuple[str, ...], newest_first: bool) -> None:
    """Netting line by line, without the running sums above: a group's open sales are a list, a cancellation eats from one end.

    <name>_replay holds the list after every line (open units and the places of their sales), <name>_kept what is left.
    """
    listed, same = ", ".join(keys), " AND ".join(f"n.{k} = r.{k}" for k in keys)
    reach = "r.open[i : len(r.open)]" if newest_first else "r.open[1 : i]"
    block(f"{name}_places", f"""
  SELECT *, row_number() OVER (PARTITION BY {listed} ORDER BY invoice_date, invoice, line, part, supplier, quantity, ext) AS place
  FROM {source}
""", source)
    block(f"{name}_replay", f"""
  SELECT {listed}, place, invoice_date, CASE WHEN quantity > 0 THEN [quantity] ELSE [] END AS open,
    CASE WHEN quantity > 0 THEN [place] ELSE [] END AS sales FROM {name}_places WHERE place = 1
  UNION ALL
  SELECT {', '.join(f'n.{k}' for k in keys)}, n.place, n.invoice_date,
    CASE WHEN n.quantity > 0 THEN list_append(r.open, n.quantity)
      ELSE [greatest(0, least(r.open[i], list_sum({reach}) + n.quantity)) FOR i IN range(1, len(r.open) + 1)] END,
    CASE WHEN n.quantity > 0 THEN list_append(r.sales, n.place) ELSE r.sales END
  FROM {name}_replay r JOIN {name}_places n ON {same} AND n.place = r.place + 1
""", f"{name}_places")
    block(f"{name}_kept", f"""
  SELECT n.*, remaining_quantity, remaining_quantity * n.price AS net_revenue
  FROM (SELECT {listed}, unnest(open) AS remaining_quantity, unnest(sales) AS place FROM (
      SELECT {listed}, max_by(open, place) AS open, max_by(sales, place) AS sales FROM {name}_replay GROUP BY ALL)) r
  JOIN {name}_places n ON {same} AND n.place = r.place WHERE remaining_quantity > 0
""", f"{name}_replay", f"{name}_places")


_replay("oldest", "model", ("customer_id", "stock_code"), newest_first=False)
_replay("newest", "model", ("customer_id", "stock_code", "price"), newest_first=True)
for _name, _source in (("fifo_purchases", "oldest_kept"), ("folded_purchases", "oldest_kept"), ("price_matched_purchases", "newest_kept")):
    twin(_name, f"""
SELECT customer_id, stock_code, invoice, line::BIGINT AS line, part, supplier, quantity, price,
  remaining_quantity, net_revenue FROM {_source}
""", _source)
twin("netting_effect", " UNION ALL ".join(f"""
SELECT '{p}' AS policy, count(*) AS sales, count(*) FILTER (remaining_quantity = quantity) AS kept,
  count(*) FILTER (remaining_quantity < quantity AND remaining_quantity > 0) AS partly_cancelled,
  count(*) FILTER (remaining_quantity = 0) AS fully_cancelled FROM {s} WHERE quantity > 0
""" for p, s in (("fifo", "fifo"), ("price_compatible", "lifo"))), "fifo", "lifo")

# RFM -------------------------------------------------------------------------------------

for _name, _source in (("rfm", "bought"), ("rfm_lifo", "bought_lifo")):
    block(_name, f"""
  SELECT customer_id, CAST(floor(epoch((SELECT max(invoice_date) + INTERVAL 1 DAY FROM model) - max(invoice_date))
      / 86400) AS BIGINT) AS recency,
    count(DISTINCT invoice) AS frequency, sum(net_revenue) AS monetary FROM {_source} GROUP BY 1
""", _source, "model")
twin("rfm_table", "SELECT * FROM rfm", "rfm")
block("compared", """
  SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, a.recency AS recency_a, a.frequency AS frequency_a,
    a.monetary AS monetary_a, b.recency AS recency_b, b.frequency AS frequency_b, b.monetary AS monetary_b,
    b.recency - a.recency AS recency_diff, b.frequency - a.frequency AS frequency_diff,
    b.monetary - a.monetary AS monetary_diff,
    coalesce(abs(b.monetary - a.monetary) > 1e-6 OR b.frequency <> a.frequency OR b.recency <> a.recency, false)::BIGINT
      AS differs
  FROM rfm a FULL JOIN rfm_lifo b ON a.customer_id = b.customer_id
""", "rfm", "rfm_lifo")
twin("netting_policy_comparison", """
SELECT *, round(differing / in_both * 100, 6) AS differing_pct, total_second - total_first AS total_diff,
  round((total_second - total_first) / total_first * 100, 6) AS total_diff_pct
FROM (SELECT count(*) FILTER (recency_b IS NULL) AS only_in_first, count(*) FILTER (recency_a IS NULL) AS only_in_second,
    count(*) FILTER (recency_a IS NOT NULL AND recency_b IS NOT NULL) AS in_both,
    count(*) FILTER (differs = 1) AS differing,
    sum(monetary_a) FILTER (recency_b IS NOT NULL) AS total_first,
    sum(monetary_b) FILTER (recency_a IS NOT NULL) AS total_second FROM compared)
""", "compared")
twin("netting_largest_differences",
     "SELECT * FROM compared WHERE differs = 1 ORDER BY abs(monetary_diff) DESC, customer_id LIMIT 10", "compared")
block("last_source", "SELECT * FROM model WHERE source_sheet = (SELECT max(source_sheet) FROM model)", "model")
_replay("recent", "last_source", ("customer_id", "stock_code"), newest_first=False)
twin("customers_without_purchase", """
SELECT customer_id, count(*) AS rows, count(DISTINCT invoice) AS invoices, sum(quantity) AS net_quantity FROM model
WHERE customer_id NOT IN (SELECT customer_id FROM oldest_kept) GROUP BY 1
""", "model", "oldest_kept")
twin("newest_customers_without_purchase", """
SELECT customer_id, count(*) AS rows, count(DISTINCT invoice) AS invoices, sum(quantity) AS net_quantity FROM last_source
WHERE customer_id NOT IN (SELECT customer_id FROM recent_kept) GROUP BY 1
""", "last_source", "recent_kept")
twin("self_cancelled_orders", """
SELECT t.customer_id, t.stock_code AS top_code, t.invoice AS top_invoice, t.quantity AS top_quantity,
  sum(m.quantity) AS net_quantity, count(DISTINCT m.invoice) AS invoices, count(*) AS lines,
  sum(m.quantity * m.price) AS net_revenue,
  date_diff('day', min(m.invoice_date) FILTER (m.stock_code = t.stock_code),
    max(m.invoice_date) FILTER (m.stock_code = t.stock_code)) AS days_between_item_rows,
  CASE WHEN abs(sum(m.quantity)) < 0.05 * t.quantity THEN 'self-corrected'
    WHEN count(DISTINCT m.invoice) > 1 THEN 'repeat activity' ELSE 'single invoice' END AS verdict
FROM (SELECT * FROM model ORDER BY quantity DESC, invoice_date DESC, invoice DESC, customer_id DESC, stock_code DESC
      LIMIT 1) t JOIN model m ON m.customer_id = t.customer_id GROUP BY 1, 2, 3, 4
""", "model")
twin("top_quantity_customers", """
SELECT customer_id, sum(quantity) AS net_quantity FROM model GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""", "model")
twin("non_positive_customers", """
SELECT customer_id, sum(quantity * price) AS raw_monetary, count(*) AS rows FROM model GROUP BY 1
HAVING sum(quantity * price) <= 0
""", "model")
twin("rfm_summary", "SELECT count(*) AS customers, " + ", ".join(
    f"round(quantile_cont({c}, 0.5), 6) AS median_{c}, round(quantile_cont({c}, 0.99), 6) AS p99_{c}"
    for c in ("recency", "frequency", "monetary")) + " FROM rfm", "rfm")
twin("representative_customers", """
(SELECT 'largest' AS role, * FROM rfm ORDER BY monetary DESC, customer_id LIMIT 1) UNION ALL
(SELECT 'median' AS role, * FROM rfm
 ORDER BY abs(monetary - (SELECT quantile_cont(monetary, 0.5) FROM rfm)), customer_id LIMIT 1)
""", "rfm")
block("rfm_log", """
  SELECT customer_id, ln(1 + recency::DOUBLE) AS recency, ln(1 + frequency::DOUBLE) AS frequency,
    ln(1 + monetary) AS monetary FROM rfm
""", "rfm")


def _shape(column: str, source: str, extra: str = "") -> str:
    quantiles = ", ".join(f"quantile_cont({column}, {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 95, 99))
    rounded = ", ".join(f"round(p{p}, 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99))
    return f"""
SELECT {extra} {rounded}, round(mean, 6) AS mean, round(max, 6) AS max, round(skew, 6) AS skewness,
  round(p75 - p25, 6) AS iqr, (skew BETWEEN -0.5 AND 0.5)::BIGINT AS nearly_symmetric
FROM (SELECT {quantiles}, avg({column}) AS mean, max({column}) AS max, skewness({column}) AS skew FROM {source})"""


twin("rfm_log_shape", " UNION ALL ".join(
    _shape(c, "rfm_log", f"'{c}' AS column_name,") for c in ("recency", "frequency", "monetary")), "rfm_log")
twin("capped_log_rfm", """
SELECT customer_id, round(recency, 6) AS recency, round(least(frequency, cf), 6) AS frequency,
  round(least(monetary, cm), 6) AS monetary, (frequency > cf)::BIGINT AS frequency_capped,
  (monetary > cm)::BIGINT AS monetary_capped
FROM rfm_log, (SELECT quantile_cont(frequency, 0.99) AS cf, quantile_cont(monetary, 0.99) AS cm FROM rfm_log)
""", "rfm_log")

# Orders and gaps -------------------------------------------------------------------------

block("ord", """
  SELECT customer_id, invoice, min(invoice_date) AS purchase_date, sum(net_revenue) AS order_value,
    sum(remaining_quantity) AS units, count(DISTINCT stock_code) AS unique_products FROM bought GROUP BY 1, 2
""", "bought")
block("days", """
  SELECT customer_id, purchase_date::DATE AS purchase_day, sum(order_value) AS daily_value, count(*) AS invoices
  FROM ord GROUP BY 1, 2
""", "ord")
twin("order_table", "SELECT * REPLACE (purchase_date::DATE::VARCHAR AS purchase_date) FROM ord", "ord")
twin("purchase_days", "SELECT * REPLACE (purchase_day::VARCHAR AS purchase_day) FROM days", "days")
block("customer_profile", """
  SELECT customer_id, count(*) AS orders, min(purchase_date) AS first_purchase, max(purchase_date) AS last_purchase,
    sum(order_value) AS total_value, CASE WHEN count(*) = 1 THEN 'One-time' ELSE 'Repeat' END AS customer_type
  FROM ord GROUP BY 1
""", "ord")
twin("customer_order_profile", """
SELECT * REPLACE (first_purchase::DATE::VARCHAR AS first_purchase, last_purchase::DATE::VARCHAR AS last_purchase)
FROM customer_profile
""", "customer_profile")
twin("customer_types", """
SELECT customer_type, count(*) AS customers, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM customer_profile GROUP BY 1
""", "customer_profile")
twin("order_value_shape", _shape("order_value", "ord"), "ord")
twin("central_orders", """
SELECT customer_id, invoice, order_value FROM ord WHERE order_value <= (SELECT quantile_cont(order_value, 0.99) FROM ord)
""", "ord")
block("pareto", """
  SELECT customer_id, monetary, row_number() OVER w AS position, count(*) OVER () AS n,
    sum(monetary) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(monetary) OVER () AS total
  FROM rfm WINDOW w AS (ORDER BY monetary DESC, customer_id)
""", "rfm")
twin("pareto_curve", """
SELECT customer_id, monetary, position, round(position / n, 6) AS rank_share, round(cum / total, 6) AS value_share
FROM pareto
""", "pareto")
twin("top_customer_share", """
SELECT count(*) FILTER (position <= greatest(1, floor(n * 0.01))) AS top_rows,
  round(sum(monetary) FILTER (position <= greatest(1, floor(n * 0.01))) / sum(monetary), 6) AS top_value_share FROM pareto
""", "pareto")
block("ord_gaps", """
  SELECT * FROM (SELECT customer_id, invoice, purchase_date,
      lag(purchase_date) OVER (PARTITION BY customer_id ORDER BY purchase_date, invoice) AS previous_purchase FROM ord)
  WHERE previous_purchase IS NOT NULL
""", "ord")
twin("order_gaps", """
SELECT customer_id, invoice, purchase_date::DATE::VARCHAR AS purchase_date,
  previous_purchase::DATE::VARCHAR AS previous_purchase,
  round(epoch(purchase_date - previous_purchase) / 3600, 6) AS gap_hours,
  round(epoch(purchase_date - previous_purchase) / 86400, 6) AS gap_days_exact,
  date_diff('day', previous_purchase, purchase_date) AS gap_days FROM ord_gaps
""", "ord_gaps")
twin("short_gap_summary", """
SELECT count(*) FILTER (d = 0) AS same_day, count(*) FILTER (e <= 86400) AS within_1_day,
  count(*) FILTER (e <= 7 * 86400) AS within_7_days, count(*) AS all_gaps,
  round(avg((d = 0)::INT), 6) AS same_day_share
FROM (SELECT date_diff('day', previous_purchase, purchase_date) AS d, epoch(purchase_date - previous_purchase) AS e
      FROM ord_gaps)
""", "ord_gaps")
block("day_gaps", """
  SELECT *, purchase_day - previous_day AS gap_days FROM (SELECT customer_id, purchase_day,
      lag(purchase_day) OVER (PARTITION BY customer_id ORDER BY purchase_day) AS previous_day FROM days)
  WHERE previous_day IS NOT NULL
""", "days")
twin("purchase_day_gaps", """
SELECT customer_id, purchase_day::VARCHAR AS purchase_day, previous_day::VARCHAR AS previous_day, gap_days FROM day_gaps
""", "day_gaps")
twin("gap_quantiles", "SELECT " + ", ".join(
    f"round(quantile_cont(gap_days, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 80, 90, 95, 99)) + " FROM day_gaps",
    "day_gaps")
twin("gap_ecdf", """
SELECT customer_id, purchase_day::VARCHAR AS purchase_day, gap_days,
  row_number() OVER (ORDER BY gap_days, customer_id, purchase_day) AS position,
  round(row_number() OVER (ORDER BY gap_days, customer_id, purchase_day) / count(*) OVER (), 6) AS cumulative_share
FROM day_gaps
""", "day_gaps")
block("cust_gaps", """
  SELECT customer_id, count(*) AS observed_gaps, quantile_cont(gap_days, 0.5) AS median_gap_days,
    avg(gap_days) AS mean_gap_days, max(gap_days) AS max_gap_days FROM day_gaps GROUP BY 1
""", "day_gaps")
twin("customer_gap_summary", """
SELECT * REPLACE (round(median_gap_days, 6) AS median_gap_days, round(mean_gap_days, 6) AS mean_gap_days) FROM cust_gaps
""", "cust_gaps")
twin("cadence_groups", f"""
SELECT {_bins('median_gap_days', fixed.CADENCE_BINS)} AS cadence,
  {_bins('median_gap_days', fixed.CADENCE_BINS, True)}::BIGINT AS cadence_order, count(*) AS customers,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cust_gaps GROUP BY 1, 2
""", "cust_gaps")
twin("horizon_coverage", f"""
SELECT h::BIGINT AS horizon_days, round(avg((gap_days <= h)::INT), 6) AS captured_share,
  round(avg((gap_days > h)::INT), 6) AS beyond_share, count(*) FILTER (gap_days <= h) AS gaps_captured,
  count(*) FILTER (gap_days > h) AS gaps_beyond,
  ((SELECT max(invoice_date)::DATE FROM bought) - h)::VARCHAR AS latest_usable_snapshot,
  {_case('h', fixed.HORIZON_NOTES)} AS note
FROM day_gaps, (SELECT unnest({list(fixed.HORIZONS)}) AS h) GROUP BY h
""", "day_gaps", "bought")
twin("monthly_activity", """
SELECT m::DATE::VARCHAR AS month, count(invoice) AS orders, count(DISTINCT customer_id) AS active_customers,
  coalesce(sum(order_value), 0) AS revenue
FROM (SELECT unnest(generate_series(date_trunc('month', min(purchase_date)), date_trunc('month', max(purchase_date)),
        INTERVAL 1 MONTH)) AS m FROM ord) LEFT JOIN ord ON date_trunc('month', purchase_date) = m GROUP BY 1
""", "ord")
twin("month_of_year", """
SELECT n AS month_number, count(invoice) AS orders, count(DISTINCT customer_id) AS active_customers,
  coalesce(sum(order_value), 0) AS revenue
FROM (SELECT unnest(generate_series(1, 12)) AS n) LEFT JOIN ord ON month(purchase_date) = n GROUP BY 1
""", "ord")
block("follow_up", """
  SELECT customer_id, max(purchase_date) AS last_purchase, count(*) AS orders,
    CAST(floor(epoch((SELECT max(invoice_date) FROM bought) - max(purchase_date)) / 86400) AS BIGINT) AS observed_days
  FROM ord GROUP BY 1
""", "ord", "bought")
twin("follow_up_time", "SELECT * REPLACE (last_purchase::DATE::VARCHAR AS last_purchase) FROM follow_up", "follow_up")
twin("follow_up_summary", """
SELECT count(*) AS customers, round(avg(observed_days), 6) AS mean_days, round(stddev_samp(observed_days), 6) AS std_days,
  min(observed_days) AS min_days, max(observed_days) AS max_days, """ + ", ".join(
    f"round(quantile_cont(observed_days, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95)) + " FROM follow_up",
    "follow_up")

# Labels ----------------------------------------------------------------------------------


def _snapshots(name: str, history: int, horizon: int) -> None:
    block(name, f"""
  SELECT d::DATE AS snapshot_date FROM (SELECT unnest(generate_series(date_trunc('month', min(purchase_day) + {history}),
      (max(purchase_day) - {horizon})::TIMESTAMP, INTERVAL 1 MONTH)) AS d, min(purchase_day) + {history} AS lo FROM days)
  WHERE d >= lo
""", "days")


_snapshots("snaps", 180, 90)
_snapshots("snaps_horizons", 180, max(fixed.HORIZONS))
_snapshots("snaps_histories", max(fixed.HISTORY_WINDOWS), 90)


def _labels(name: str, snaps: str, horizons, histories) -> None:
    block(name, f"""
  SELECT e.*, e.snapshot_date - e.history_window_days AS observation_start,
    e.snapshot_date - e.last_purchase_before_snapshot AS recency_at_snapshot,
    e.last_purchase_before_snapshot - e.first_purchase_in_window AS observed_tenure_in_window,
    CASE WHEN history_purchase_days = 1 THEN '{fixed.ONE_DAY_STAGE}' ELSE '{fixed.REPEAT_STAGE}' END
      AS customer_stage_at_snapshot,
    n.next_purchase_date, n.next_purchase_date - e.snapshot_date AS days_to_next_purchase, h.horizon_days,
    e.snapshot_date + h.horizon_days AS label_end_date,
    coalesce(n.next_purchase_date < e.snapshot_date + h.horizon_days, false)::BIGINT AS returned_within_horizon,
    1 - coalesce(n.next_purchase_date < e.snapshot_date + h.horizon_days, false)::BIGINT AS churn
  FROM (SELECT customer_id, snapshot_date, w AS history_window_days, count(*) AS history_purchase_days,
          sum(invoices)::BIGINT AS history_invoices, sum(daily_value) AS history_monetary,
          min(purchase_day) AS first_purchase_in_window, max(purchase_day) AS last_purchase_before_snapshot
        FROM {snaps}, (SELECT unnest({list(histories)}) AS w), days
        WHERE purchase_day >= snapshot_date - w AND purchase_day < snapshot_date GROUP BY 1, 2, 3) e
  LEFT JOIN (SELECT customer_id, snapshot_date, min(purchase_day) AS next_purchase_date
             FROM {snaps} JOIN days ON purchase_day >= snapshot_date GROUP BY 1, 2) n
    ON n.customer_id = e.customer_id AND n.snapshot_date = e.snapshot_date,
  (SELECT unnest({list(horizons)}) AS horizon_days) h
""", snaps, "days")


_labels("lab", "snaps", [90], [180])
_labels("lab_horizons", "snaps_horizons", fixed.HORIZONS, [180])
_labels("lab_histories", "snaps_histories", [90], fixed.HISTORY_WINDOWS)
twin("labels_90d", """
SELECT * EXCLUDE (history_window_days) REPLACE (snapshot_date::VARCHAR AS snapshot_date, horizon_days::BIGINT AS horizon_days,
  first_purchase_in_window::VARCHAR AS first_purchase_in_window,
  last_purchase_before_snapshot::VARCHAR AS last_purchase_before_snapshot,
  observation_start::VARCHAR AS observation_start, next_purchase_date::VARCHAR AS next_purchase_date,
  label_end_date::VARCHAR AS label_end_date) FROM lab
""", "lab")
twin("missing_values", """
SELECT c AS column_name, n AS missing_rows, round(n / total, 6) AS missing_share FROM (
  SELECT 'next_purchase_date' AS c, count(*) FILTER (next_purchase_date IS NULL) AS n, count(*) AS total FROM lab
  UNION ALL SELECT 'days_to_next_purchase', count(*) FILTER (days_to_next_purchase IS NULL), count(*) FROM lab)
WHERE n > 0
""", "lab")


def _prevalence(by: str, source: str, shown: str | None = None) -> str:
    low = "(p + z2 / (2 * n) {} 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)"
    return f"""
SELECT {shown or by}, n::BIGINT AS customer_snapshots, u AS unique_customers, c::BIGINT AS churned, r::BIGINT AS returned,
  round(p, 6) AS churn_rate, round(r / n, 6) AS return_rate, round({low.format('-')}, 6) AS churn_rate_lower,
  round({low.format('+')}, 6) AS churn_rate_upper
FROM (SELECT {by}, count(*)::DOUBLE AS n, count(DISTINCT customer_id) AS u, sum(churn)::DOUBLE AS c,
        sum(returned_within_horizon)::DOUBLE AS r, avg(churn) AS p, 1.96::DOUBLE * 1.96 AS z2 FROM {source} GROUP BY ALL)
"""


twin("label_prevalence_wilson", _prevalence("horizon_days", "lab_horizons", "horizon_days::BIGINT AS horizon_days"), "lab_horizons")
twin("prevalence_by_snapshot", _prevalence(
    "snapshot_date, horizon_days", "lab_horizons",
    "snapshot_date::VARCHAR AS snapshot_date, horizon_days::BIGINT AS horizon_days"), "lab_horizons")
twin("prevalence_by_stage", _prevalence("customer_stage_at_snapshot", "lab"), "lab")
twin("prevalence_matrix", "SELECT snapshot_date::VARCHAR AS snapshot_date, " + ", ".join(
    f"round(avg(churn) FILTER (horizon_days = {h}), 6) AS churn_rate_{h}d" for h in fixed.HORIZONS
) + " FROM lab_horizons GROUP BY 1", "lab_horizons")
twin("recency_band_prevalence", f"""
SELECT horizon_days::BIGINT AS horizon_days, {_bins('recency_at_snapshot', fixed.RECENCY_BINS)} AS recency_band,
  {_bins('recency_at_snapshot', fixed.RECENCY_BINS, True)}::BIGINT AS band_order, count(*) AS customer_snapshots,
  sum(churn)::BIGINT AS churned, round(avg(churn), 6) AS churn_rate FROM lab_horizons GROUP BY 1, 2, 3
""", "lab_horizons")
twin("label_checks", """
SELECT count(*) FILTER (churn + returned_within_horizon <> 1) AS not_complementary,
  count(*) FILTER (last_purchase_before_snapshot >= snapshot_date) AS history_after_snapshot,
  count(*) FILTER (label_end_date > (SELECT max(purchase_day) FROM days)) AS incomplete_outcome,
  count(*) FILTER (next_purchase_date < snapshot_date) AS next_before_snapshot,
  count(*) FILTER (recency_at_snapshot < 1) AS recency_below_one FROM lab
""", "lab")
twin("horizon_checks", """
SELECT count(*) FILTER (n <> pn) AS population_changes, count(*) FILTER (r > pr) AS rate_rises
FROM (SELECT *, lag(n) OVER w AS pn, lag(r) OVER w AS pr
      FROM (SELECT snapshot_date, horizon_days, count(*) AS n, avg(churn) AS r FROM lab_horizons GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY snapshot_date ORDER BY horizon_days))
""", "lab_horizons")
twin("history_window_by_snapshot", """
SELECT history_window_days::BIGINT AS history_window_days, snapshot_date::VARCHAR AS snapshot_date,
  count(*) AS eligible_customers, round(avg(churn), 6) AS churn_rate,
  round(quantile_cont(recency_at_snapshot, 0.5), 6) AS median_recency,
  round(avg(history_purchase_days), 6) AS mean_purchase_days, round(avg(history_invoices), 6) AS mean_invoices,
  round(avg(history_monetary), 6) AS mean_monetary FROM lab_histories GROUP BY 1, 2
""", "lab_histories")
twin("history_window_sensitivity", f"""
SELECT a.history_window_days::BIGINT AS history_window_days, customer_snapshots, unique_customers, churn_rate,
  one_purchase_share, median_recency, median_purchase_days, median_invoices, median_monetary,
  average_eligible_customers, minimum_eligible_customers, maximum_eligible_customers, churn_rate_std
FROM (SELECT history_window_days, count(*) AS customer_snapshots, count(DISTINCT customer_id) AS unique_customers,
        round(avg(churn), 6) AS churn_rate,
        round(avg((customer_stage_at_snapshot = '{fixed.ONE_DAY_STAGE}')::INT), 6) AS one_purchase_share,
        round(quantile_cont(recency_at_snapshot, 0.5), 6) AS median_recency,
        round(quantile_cont(history_purchase_days, 0.5), 6) AS median_purchase_days,
        round(quantile_cont(history_invoices, 0.5), 6) AS median_invoices,
        round(quantile_cont(history_monetary, 0.5), 6) AS median_monetary FROM lab_histories GROUP BY 1) a
JOIN (SELECT history_window_days, round(avg(n), 6) AS average_eligible_customers, min(n) AS minimum_eligible_customers,
        max(n) AS maximum_eligible_customers, round(stddev_samp(r), 6) AS churn_rate_std
      FROM (SELECT history_window_days, snapshot_date, count(*) AS n, avg(churn) AS r FROM lab_histories GROUP BY 1, 2)
      GROUP BY 1) b ON a.history_window_days = b.history_window_days
""", "lab_histories")
_PAIRS = list(zip(fixed.HISTORY_WINDOWS, fixed.HISTORY_WINDOWS[1:]))
block("added", " UNION ALL ".join(f"""
  SELECT s.snapshot_date, 'Added by {wide} vs {short} days' AS comparison, count(l.customer_id) AS added_customers,
    avg(l.churn) AS added_churn_rate, quantile_cont(l.recency_at_snapshot, 0.5) AS added_median_recency,
    avg((l.customer_stage_at_snapshot = '{fixed.ONE_DAY_STAGE}')::INT) AS added_one_purchase_share
  FROM (SELECT DISTINCT snapshot_date FROM lab_histories) s LEFT JOIN (
    SELECT * FROM lab_histories WHERE history_window_days = {wide} AND (customer_id, snapshot_date) NOT IN (
      SELECT (customer_id, snapshot_date) FROM lab_histories WHERE history_window_days = {short})) l
    ON l.snapshot_date = s.snapshot_date GROUP BY 1
""" for short, wide in _PAIRS), "lab_histories")
twin("added_population", """
SELECT snapshot_date::VARCHAR AS snapshot_date, comparison, added_customers, round(added_churn_rate, 6) AS added_churn_rate,
  round(added_median_recency, 6) AS added_median_recency, round(added_one_purchase_share, 6) AS added_one_purchase_share
FROM added
""", "added")
twin("added_population_summary", """
SELECT comparison, round(avg(added_customers), 6) AS average_added_customers,
  round(avg(added_churn_rate), 6) AS added_churn_rate,
  round(quantile_cont(added_median_recency, 0.5), 6) AS added_median_recency,
  round(avg(added_one_purchase_share), 6) AS added_one_purchase_share FROM added GROUP BY 1
""", "added")
twin("history_windows_nested", "SELECT sum(n)::BIGINT AS missing_customers FROM (" + " UNION ALL ".join(f"""
  SELECT count(*) AS n FROM lab_histories a WHERE history_window_days = {short} AND NOT EXISTS (
    SELECT 1 FROM lab_histories b WHERE b.history_window_days = {wide} AND b.customer_id = a.customer_id
      AND b.snapshot_date = a.snapshot_date)""" for short, wide in _PAIRS) + ")", "lab_histories")

# As-of state and features ----------------------------------------------------------------

block("moves", f"""
  SELECT *, sold - stock AS used, lead(invoice_date) OVER (PARTITION BY customer_id, stock_code
    ORDER BY invoice_date, invoice, line, part, supplier, quantity, ext) AS next_date FROM fifo_stock
""", "fifo_stock")
block("open_lots", """
  SELECT l.customer_id, l.stock_code, l.invoice, l.invoice_date::DATE AS day, s.snapshot_date, l.price,
    least(l.quantity, l.sold - s.used) AS units, least(l.quantity, l.sold - s.used) * l.price AS value,
    s.snapshot_date - l.invoice_date::DATE AS age
  FROM moves l JOIN (SELECT customer_id, stock_code, used, snapshot_date FROM moves JOIN snaps
      ON snapshot_date > invoice_date AND (next_date IS NULL OR snapshot_date <= next_date)) s
    ON l.customer_id = s.customer_id AND l.stock_code = s.stock_code
  WHERE l.quantity > 0 AND l.invoice_date < s.snapshot_date AND l.sold > s.used
""", "moves", "snaps")
twin("incremental_lots", """
SELECT customer_id, stock_code, invoice, day::VARCHAR AS open_day, price, close_day::VARCHAR AS close_day, sum(units) AS units
FROM (
  SELECT l.customer_id, l.stock_code, l.invoice, l.invoice_date::DATE AS day, l.price, c.invoice_date::DATE AS close_day,
    least(l.sold, c.used) - greatest(l.sold - l.quantity, c.before) AS units
  FROM moves l JOIN (SELECT *, coalesce(lag(used) OVER (PARTITION BY customer_id, stock_code
      ORDER BY invoice_date, invoice, line, part, supplier, quantity, ext), 0) AS before FROM moves) c
    ON l.customer_id = c.customer_id AND l.stock_code = c.stock_code AND c.used > c.before
  WHERE l.quantity > 0
  UNION ALL
  SELECT customer_id, stock_code, invoice, invoice_date::DATE, price, NULL,
    sold - greatest(sold - quantity, max(used) OVER (PARTITION BY customer_id, stock_code))
  FROM moves QUALIFY quantity > 0
) WHERE units > 0 GROUP BY ALL
""", "moves")
# From the replay: the open list after the last line before the snapshot.
block("replayed", """
  SELECT r.customer_id, r.stock_code, s.snapshot_date, unnest(open) AS units, unnest(sales) AS place
  FROM (SELECT *, lead(invoice_date) OVER (PARTITION BY customer_id, stock_code ORDER BY place) AS next_date FROM oldest_replay) r
  JOIN snaps s ON s.snapshot_date > r.invoice_date AND (next_date IS NULL OR s.snapshot_date <= next_date)
""", "oldest_replay", "snaps")
twin("asof_open_lots", """
SELECT snapshot_date::VARCHAR AS snapshot_date, customer_id, stock_code, count(*) AS lots, sum(units) AS units,
  sum(value) AS value
FROM (SELECT r.snapshot_date, r.customer_id, r.stock_code, n.invoice, n.invoice_date::DATE AS day, n.price,
        sum(r.units) AS units, sum(r.units * n.price) AS value
      FROM replayed r JOIN oldest_places n USING (customer_id, stock_code, place) WHERE r.units > 0 GROUP BY ALL)
GROUP BY 1, 2, 3
""", "replayed", "oldest_places")
_W = fixed.FEATURE_WINDOWS
block("seen", "SELECT * FROM open_lots WHERE (customer_id, snapshot_date) IN "
      "(SELECT (customer_id, snapshot_date) FROM open_lots WHERE age BETWEEN 1 AND 180)", "open_lots")
block("feat_lots", "SELECT customer_id, snapshot_date, min(age) AS recency, max(age) AS tenure_days, "
      "count(DISTINCT day) AS lifetime_purchase_days, count(DISTINCT invoice) AS lifetime_orders, "
      "sum(value) AS lifetime_monetary, sum(units) AS lifetime_units, "
      "count(DISTINCT stock_code) AS lifetime_unique_products, " + ", ".join(
          f"count(DISTINCT day) FILTER (age <= {w}) AS purchase_days_{w}d, "
          f"count(DISTINCT invoice) FILTER (age <= {w}) AS orders_{w}d, "
          f"coalesce(sum(value) FILTER (age <= {w}), 0) AS monetary_{w}d, "
          f"coalesce(sum(units) FILTER (age <= {w}), 0) AS units_{w}d" for w in _W) +
      ", count(DISTINCT invoice) FILTER (age BETWEEN 91 AND 180) AS orders_previous_90d"
      ", coalesce(sum(value) FILTER (age BETWEEN 91 AND 180), 0) AS monetary_previous_90d"
      ", count(DISTINCT day) FILTER (age BETWEEN 91 AND 180) AS purchase_days_previous_90d"
      " FROM seen GROUP BY 1, 2", "seen")
block("feat_orders", "SELECT customer_id, snapshot_date, avg(v) AS average_order_value FROM (SELECT customer_id, "
      "snapshot_date, invoice, sum(value) AS v FROM seen GROUP BY 1, 2, 3) GROUP BY 1, 2", "seen")
block("feat_gaps", """
  SELECT customer_id, snapshot_date, quantile_cont(gap, 0.5) AS median_purchase_gap,
    arg_max(gap, day) AS latest_purchase_gap, stddev_pop(gap) AS purchase_gap_std
  FROM (SELECT customer_id, snapshot_date, day, (day - lag(day) OVER (PARTITION BY customer_id, snapshot_date ORDER BY day))
          ::DOUBLE AS gap FROM (SELECT DISTINCT customer_id, snapshot_date, day FROM seen)) GROUP BY 1, 2
""", "seen")
block("feat_cancel", """
  SELECT customer_id, snapshot_date, count(*) FILTER (quantity < 0) AS cancellation_rows_180d,
    sum(greatest(-quantity, 0)) AS cancelled_units_180d, sum(greatest(-quantity, 0) * price) AS cancellation_value_180d,
    sum(greatest(quantity, 0)) AS positive_units_180d
  FROM model JOIN snaps ON invoice_date >= snapshot_date - 180 AND invoice_date < snapshot_date GROUP BY 1, 2
""", "model", "snaps")
block("feat", """
  SELECT l.*, o.average_order_value, orders_90d - orders_previous_90d AS order_change_90d,
    monetary_90d - monetary_previous_90d AS monetary_change_90d,
    (orders_90d + 1) / (orders_previous_90d + 1) AS order_trend_ratio_90d,
    (monetary_90d + 1) / (monetary_previous_90d + 1) AS monetary_trend_ratio_90d,
    median_purchase_gap, latest_purchase_gap, purchase_gap_std,
    (lifetime_purchase_days >= 2)::BIGINT AS has_repeat_purchase_history,
    coalesce(cancellation_rows_180d, 0) AS cancellation_rows_180d, coalesce(cancelled_units_180d, 0) AS cancelled_units_180d,
    coalesce(cancellation_value_180d, 0) AS cancellation_value_180d, coalesce(positive_units_180d, 0) AS positive_units_180d,
    coalesce(cancelled_units_180d / nullif(positive_units_180d, 0), 0) AS cancellation_unit_rate_180d,
    month(l.snapshot_date) AS snapshot_month, quarter(l.snapshot_date) AS snapshot_quarter,
    (month(l.snapshot_date) IN (10, 11, 12))::BIGINT AS is_holiday_season
  FROM feat_lots l JOIN feat_orders o USING (customer_id, snapshot_date) JOIN feat_gaps g USING (customer_id, snapshot_date)
    LEFT JOIN feat_cancel c USING (customer_id, snapshot_date)
""", "feat_lots", "feat_orders", "feat_gaps", "feat_cancel")
_ROUNDED = ("average_order_value", "order_trend_ratio_90d", "monetary_trend_ratio_90d", "median_purchase_gap",
            "purchase_gap_std", "cancellation_unit_rate_180d")
_FEATURES = "* REPLACE (snapshot_date::VARCHAR AS snapshot_date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ")"
twin("snapshot_features", f"SELECT {_FEATURES} FROM feat", "feat")
block("train", "SELECT f.*, l.churn FROM lab l JOIN feat f USING (customer_id, snapshot_date)", "lab", "feat")
twin("training_table", f"SELECT {_FEATURES} FROM train", "train")
_RULES = {
    "recency_out_of_range": "recency BETWEEN 1 AND 180", "monetary_180d_negative": "monetary_180d >= 0",
    "orders_180d_missing": "orders_180d >= 1", "churn_not_binary": "churn IN (0, 1)",
} | {
    f"{n}_{wide}d_below_{short}d": f"{n}_{wide}d >= {n}_{short}d"
    for n in ("purchase_days", "orders", "monetary", "units") for short, wide in zip(_W, _W[1:])
} | {
    f"{g}_presence": f"({g} IS NULL) = (has_repeat_purchase_history = 0)"
    for g in ("median_purchase_gap", "latest_purchase_gap", "purchase_gap_std")
}
twin("training_contract_checks", "SELECT " + ", ".join(
    f"count(*) FILTER (NOT coalesce({r}, false)) AS {n}" for n, r in _RULES.items()) + " FROM train", "train")
twin("churn_class_medians", " UNION ALL ".join(f"""
SELECT churn, '{c}' AS column_name, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
  round(avg({c}) / nullif(quantile_cont({c}, 0.5), 0), 6) AS mean_to_median FROM train GROUP BY 1
""" for c in ("recency", "orders_90d", "monetary_90d", "lifetime_orders")), "train")
twin("feature_missing_values", "SELECT c AS column_name, n AS missing_rows, round(n / total, 6) AS missing_share FROM (" +
     " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) AS n, count(*) AS total FROM train"
                        for c in ("median_purchase_gap", "latest_purchase_gap", "purchase_gap_std")) + ") WHERE n > 0",
     "train")
twin("invalid_feature_rows", """
SELECT * FROM (SELECT customer_id, snapshot_date::VARCHAR AS snapshot_date, concat_ws('; ',
    CASE WHEN orders_30d >= 2 THEN 'recency: negative' END,
    CASE WHEN lifetime_orders <= 1 THEN 'average_order_value: missing' END,
    CASE WHEN orders_90d >= 3 THEN 'snapshot_month: not a month' END) AS problems FROM train) WHERE problems <> ''
""", "train")

# Splits and metrics ----------------------------------------------------------------------

block("scored", """
  SELECT customer_id, snapshot_date, churn, recency_at_snapshot AS recency, history_monetary AS customer_value,
    least(1.0::DOUBLE, recency_at_snapshot / 180.0::DOUBLE) AS churn_probability FROM lab
""", "lab")
block("last_snap", "SELECT max(snapshot_date) AS d FROM snaps", "snaps")
block("holdout", "SELECT * FROM scored WHERE snapshot_date = (SELECT d FROM last_snap)", "scored", "last_snap")
block("fold_dates", """
  SELECT snapshot_date AS validation_date, row_number() OVER (ORDER BY snapshot_date) AS fold
  FROM (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS back FROM snaps) WHERE back BETWEEN 5 AND 8
""", "snaps")
block("folds", """
  SELECT s.*, f.fold, f.validation_date,
    CASE WHEN s.snapshot_date = f.validation_date THEN 'validation' ELSE 'train' END AS role
  FROM scored s JOIN fold_dates f ON s.snapshot_date = f.validation_date OR s.snapshot_date + 90 <= f.validation_date
""", "scored", "fold_dates")
block("valid", "SELECT * FROM folds WHERE role = 'validation'", "folds")
_SUMMARY = """count(*) AS rows, count(DISTINCT customer_id) AS customers, min(snapshot_date)::VARCHAR AS first_snapshot,
  max(snapshot_date)::VARCHAR AS last_snapshot, round(avg(churn), 6) AS churn_rate"""
twin("temporal_folds", f"""
SELECT fold, validation_date::VARCHAR AS validation_date, role, {_SUMMARY} FROM folds GROUP BY 1, 2, 3
""", "folds")
twin("holdout_roles", f"""
SELECT CASE WHEN snapshot_date = (SELECT d FROM last_snap) THEN 'test'
    WHEN snapshot_date + 90 <= (SELECT d FROM last_snap) THEN 'development' ELSE 'purged' END AS role, {_SUMMARY}
FROM scored GROUP BY 1
""", "scored", "last_snap")


def _confusion(source: str, by: str, predicted: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (churn = 1 AND {predicted}) AS tp, count(*) FILTER (churn = 0 AND {predicted}) AS fp,
      count(*) FILTER (churn = 1 AND NOT {predicted}) AS fn, count(*) FILTER (churn = 0 AND NOT {predicted}) AS tn
      FROM {source} GROUP BY ALL"""


_SCORES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    CASE WHEN tn + fp = 0 THEN tp / (tp + fn) WHEN tp + fn = 0 THEN tn / (tn + fp)
      ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_accuracy"""


def _ranks(source: str, score: str, by: str, tie: str = "customer_id") -> str:
    """ROC area by counting pairs through ranks, average precision over distinct scores, lift at 20 %."""
    return f"""SELECT {by}, any_value(auc) AS roc_auc, any_value(ap) AS average_precision, any_value(lift) AS lift FROM (
      SELECT {by}, sum(f / n * (ct - t / 2) / p) OVER (PARTITION BY {by}) AS auc,
        sum(t / p * ct / (ct + cf)) OVER (PARTITION BY {by}) AS ap
      FROM (SELECT *, sum(t) OVER w AS ct, sum(f) OVER w AS cf, sum(t) OVER (PARTITION BY {by}) AS p,
              sum(f) OVER (PARTITION BY {by}) AS n
            FROM (SELECT {by}, {score} AS score, sum(churn)::DOUBLE AS t, sum(1 - churn)::DOUBLE AS f
                  FROM {source} GROUP BY ALL)
            WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))) a
      JOIN (SELECT {by}, avg(churn) FILTER (place <= greatest(1, ceil(n * 0.2::DOUBLE))) / nullif(avg(churn), 0) AS lift
            FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {tie}) AS place,
                    count(*) OVER (PARTITION BY {by}) AS n FROM {source}) GROUP BY ALL) b USING ({by}) GROUP BY ALL"""


_RANKED = "round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(lift, 6) AS lift"
_RATES = ("precision", "recall", "f1", "balanced_accuracy")
_ROUND_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)
twin("recency_rule_metrics", f"""
SELECT fold, tp, fp, fn, tn, {_ROUND_RATES}, {_RANKED}
FROM (SELECT *, {_SCORES} FROM ({_confusion('valid', 'fold', '(recency >= 60)')})) c
JOIN ({_ranks('valid', 'recency', 'fold')}) r USING (fold)
""", "valid")
twin("recency_confusion", """
SELECT churn, (recency >= 60)::BIGINT AS predicted, count(*) AS rows FROM holdout GROUP BY 1, 2
""", "holdout")
twin("recency_threshold_tuning", f"""
SELECT threshold::BIGINT AS threshold, round(avg(balanced_accuracy), 6) AS mean_balanced_accuracy,
  round(stddev_samp(balanced_accuracy), 6) AS std_balanced_accuracy, round(avg(precision), 6) AS mean_precision,
  round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(roc_auc), 6) AS mean_roc_auc,
  round(avg(average_precision), 6) AS mean_average_precision, round(avg(lift), 6) AS mean_lift
FROM (SELECT *, {_SCORES} FROM ({_confusion(
    '(SELECT * FROM valid, (SELECT unnest([30, 60, 90, 120, 150]) AS threshold))', 'fold, threshold', '(recency >= threshold)'
)})) c JOIN ({_ranks('valid', 'recency', 'fold')}) r USING (fold) GROUP BY 1
""", "valid")
_BY_FOLD = f"""(SELECT *, {_SCORES} FROM ({_confusion(
    '(SELECT * FROM valid, (SELECT unnest([30, 60, 90, 120, 150]) AS threshold))', 'fold, threshold', '(recency >= threshold)'
)})) c JOIN ({_ranks('valid', 'recency', 'fold')}) r USING (fold)"""
twin("recency_tuning_by_fold", f"""
SELECT fold, validation_date::VARCHAR AS validation_date, threshold::BIGINT AS threshold, tp, fp, {_ROUND_RATES}, {_RANKED}
FROM {_BY_FOLD} JOIN fold_dates USING (fold)
""", "valid", "fold_dates")
twin("chosen_recency_threshold", f"""
SELECT threshold::BIGINT AS threshold FROM (SELECT threshold, avg(balanced_accuracy) AS a, avg(f1) AS b FROM {_BY_FOLD} GROUP BY 1)
ORDER BY a DESC, b DESC, threshold LIMIT 1
""", "valid")
_GRID = list(fixed.PROBABILITY_GRID)
twin("probability_threshold_tuning", f"""
SELECT threshold, tp, fp, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_share, {_ROUND_RATES}, {_RANKED}
FROM (SELECT *, {_SCORES} FROM ({_confusion(
    f'(SELECT * FROM valid, (SELECT unnest({_GRID})::DOUBLE AS threshold))', '1 AS one, threshold',
    '(churn_probability >= threshold)')})) c
JOIN ({_ranks('(SELECT *, 1 AS one FROM valid)', 'churn_probability', 'one', 'customer_id, fold')}) r USING (one)
""", "valid")
_CAPS = list(fixed.CAPACITIES)
twin("capacity_table", f"""
SELECT snapshot_date::VARCHAR AS snapshot_date, capacity, contacts AS customers_contacted, reached AS churners_reached,
  round(reached / contacts, 6) AS precision, round(reached / churners, 6) AS recall,
  round(reached / contacts / (churners / n), 6) AS lift
FROM (SELECT snapshot_date, capacity, n, count(*) FILTER (place <= greatest(1, ceil(n * capacity))) AS contacts,
        (sum(churn) FILTER (place <= greatest(1, ceil(n * capacity))))::BIGINT AS reached, sum(churn) AS churners
      FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY churn_probability DESC, customer_id) AS place,
              count(*) OVER (PARTITION BY snapshot_date) AS n FROM scored),
        (SELECT unnest({_CAPS})::DOUBLE AS capacity) GROUP BY 1, 2, 3)
""", "scored")
twin("lift_at_20", """
SELECT snapshot_date::VARCHAR AS snapshot_date,
  round(avg(churn) FILTER (place <= greatest(1, ceil(n * 0.2::DOUBLE))) / nullif(avg(churn), 0), 6) AS lift
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY churn_probability DESC, customer_id) AS place,
        count(*) OVER (PARTITION BY snapshot_date) AS n FROM scored) GROUP BY 1
""", "scored")
_EPS = "2.220446049250313e-16::DOUBLE"
_CLIPPED = f"least(greatest({{0}}, {_EPS}), 1 - {_EPS})"


def _errors(score: str) -> str:
    p = _CLIPPED.format(score)
    return f"""avg(({score} - churn) * ({score} - churn)) AS brier_score,
      -avg(CASE WHEN churn = 1 THEN ln({p}) ELSE ln(1 - {p}) END) AS log_loss"""


twin("probability_errors", f"""
SELECT snapshot_date::VARCHAR AS snapshot_date, round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss
FROM (SELECT snapshot_date, {_errors('churn_probability')} FROM scored GROUP BY 1)
""", "scored")
twin("calibration_curve", """
SELECT len(list_filter(edges, lambda e: e < churn_probability))::BIGINT AS bin, count(*) AS rows,
  round(avg(churn_probability), 6) AS mean_score, round(avg(churn), 6) AS churn_rate
FROM scored, (SELECT quantile_cont(churn_probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored)
GROUP BY 1
""", "scored")
twin("model_comparison", " UNION ALL ".join(f"""
SELECT '{name}' AS model, tp, fp, fn, tn, {_ROUND_RATES}, {_RANKED}, round(brier_score, 6) AS brier_score,
  round(log_loss, 6) AS log_loss
FROM (SELECT *, {_SCORES} FROM ({_confusion(source, '1 AS one', '(score >= 0.5)')})) c
JOIN ({_ranks(source, 'score', 'one')}) r USING (one)
JOIN (SELECT 1 AS one, {_errors('score')} FROM {source}) e USING (one)
""" for name, source in (
    ("recency", "(SELECT *, 1 AS one, churn_probability AS score FROM holdout)"),
    ("value", "(SELECT *, 1 AS one, 1 / (1 + customer_value / 100000.0::DOUBLE) AS score FROM holdout)"),
)), "holdout")
TWINS["model_comparison"] = TWINS["model_comparison"].replace("SELECT 1 AS one, count(*)", "SELECT one, count(*)")

block("rules", f"""
  SELECT customer_id, CASE WHEN recency <= mr AND frequency > mf AND monetary > mm THEN '{fixed.SEGMENT_CHAMPIONS}'
      WHEN recency <= mr THEN '{fixed.SEGMENT_RECENT}' WHEN frequency > mf OR monetary > mm THEN '{fixed.SEGMENT_AT_RISK}'
      ELSE '{fixed.SEGMENT_LAPSED}' END AS segment, recency, frequency, monetary
  FROM rfm, (SELECT quantile_cont(recency, 0.5) AS mr, quantile_cont(frequency, 0.5) AS mf,
      quantile_cont(monetary, 0.5) AS mm FROM rfm)
""", "rfm")
twin("segment_label_agreement", """
SELECT round((cells - rows_ * cols_ / total) / ((rows_ + cols_) / 2 - rows_ * cols_ / total), 6) AS adjusted_rand
FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM rules GROUP BY segment, recency <= 200)) AS cells,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM rules GROUP BY segment)) AS rows_,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM rules GROUP BY recency <= 200)) AS cols_,
    (SELECT count(*) * (count(*) - 1) / 2 FROM rules) AS total)
""", "rules")

# Decisions -------------------------------------------------------------------------------

twin("risk_bands", f"""
SELECT customer_id, round(churn_probability, 6) AS churn_probability,
  CASE WHEN churn_probability >= v THEN 'Very High' WHEN churn_probability >= h THEN 'High'
    WHEN churn_probability >= m THEN 'Medium' ELSE 'Low' END AS risk_band,
  (CASE WHEN churn_probability >= v THEN 4 WHEN churn_probability >= h THEN 3
    WHEN churn_probability >= m THEN 2 ELSE 1 END)::BIGINT AS risk_band_order
FROM holdout, (SELECT quantile_cont(churn_probability, 0.5) AS m, quantile_cont(churn_probability, 0.8) AS h,
    quantile_cont(churn_probability, 0.9) AS v FROM scored WHERE snapshot_date = (
      SELECT snapshot_date FROM (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS back FROM snaps)
      WHERE back = 5))
""", "holdout")
_BAND = "CASE WHEN {0} / {1} <= 0.1::DOUBLE THEN 'Priority 1 - Immediate' WHEN {0} / {1} <= 0.2::DOUBLE THEN " \
        "'Priority 2 - Targeted' WHEN {0} / {1} <= 0.5::DOUBLE THEN 'Priority 3 - Nurture' ELSE 'Standard monitoring' END"


def _ranking(name: str, source: str, cap: str, by: str = "", *reads: str) -> None:
    part = f"PARTITION BY {by} " if by else ""
    block(name, f"""
  SELECT *, {_BAND.format('probability_rank', 'n')} AS campaign_priority_band,
    {_BAND.format('value_at_risk_rank', 'n')} AS value_protection_priority_band
  FROM (SELECT *, row_number() OVER ({part}ORDER BY churn_probability DESC, customer_id) AS probability_rank,
          row_number() OVER ({part}ORDER BY value_at_risk_score DESC, customer_id) AS value_at_risk_rank,
          count(*) OVER ({part.strip()}) AS n
        FROM (SELECT *, churn_probability * least(customer_value, customer_value_cap) AS value_at_risk_score
              FROM (SELECT *, {cap} AS customer_value_cap FROM {source})))
""", *reads)


_ranking("ranked_all", "scored", "quantile_cont(customer_value, 0.99) OVER (PARTITION BY snapshot_date)",
         "snapshot_date", "scored")
twin("priority_bands", f"""
SELECT customer_id, snapshot_date::VARCHAR AS snapshot_date, round(churn_probability, 6) AS churn_probability,
  probability_rank, campaign_priority_band, {_case('campaign_priority_band', fixed.CAMPAIGN_ACTIONS)}
  AS campaign_recommended_action FROM ranked_all
""", "ranked_all")
twin("value_at_risk", """
SELECT customer_id, snapshot_date::VARCHAR AS snapshot_date, round(customer_value_cap, 6) AS customer_value_cap,
  round(value_at_risk_score, 6) AS value_at_risk_score, probability_rank, value_at_risk_rank,
  value_protection_priority_band FROM ranked_all
""", "ranked_all")
block("valued", """
  SELECT s.* EXCLUDE (customer_value), l.customer_value FROM scored s
  JOIN (SELECT customer_id, snapshot_date, sum(value) AS customer_value FROM open_lots GROUP BY 1, 2) l
    USING (customer_id, snapshot_date)
""", "scored", "open_lots")
block("valued_last", "SELECT * FROM valued WHERE snapshot_date = (SELECT d FROM last_snap)", "valued", "last_snap")
block("safe_cap", """
  SELECT quantile_cont(customer_value, 0.99) AS cap FROM valued WHERE snapshot_date = (
    SELECT max(snapshot_date) FROM valued WHERE snapshot_date + 90 <= (SELECT d FROM last_snap))
""", "valued", "last_snap")
_ranking("ranked_last", "valued_last", "(SELECT cap FROM safe_cap)", "", "valued_last", "safe_cap")
_CONTACTS = "greatest(1, ceil(n * 0.2::DOUBLE))"
twin("strategy_comparison", f"""
SELECT strategy, count(*) AS customers, round(sum(churn) / count(*), 6) AS churn_precision,
  round(sum(churn) / any_value(churners), 6) AS churn_recall,
  round(sum(churn) / count(*) / any_value(rate), 6) AS lift,
  round(sum(customer_value) FILTER (churn = 1) / any_value(lost), 6) AS churned_value_coverage,
  round(avg(customer_value), 6) AS average_customer_value
FROM (SELECT 'Probability ranking' AS strategy, * FROM ranked_last WHERE probability_rank <= {_CONTACTS}
  UNION ALL SELECT 'Value-at-risk ranking', * FROM ranked_last WHERE value_at_risk_rank <= {_CONTACTS}
  UNION ALL SELECT * EXCLUDE (place) FROM (SELECT 'Threshold-gated value ranking' AS strategy, *,
      row_number() OVER (ORDER BY value_at_risk_rank) AS place FROM ranked_last WHERE churn_probability >= 0.4)
    WHERE place <= {_CONTACTS}),
  (SELECT sum(churn) AS churners, avg(churn) AS rate, sum(customer_value) FILTER (churn = 1) AS lost FROM ranked_last)
GROUP BY strategy HAVING count(*) >= any_value({_CONTACTS})
""", "ranked_last")
twin("strategy_overlap", f"""
SELECT max({_CONTACTS})::BIGINT AS contacts,
  count(*) FILTER (probability_rank <= {_CONTACTS} AND value_at_risk_rank <= {_CONTACTS}) AS in_both FROM ranked_last
""", "ranked_last")
twin("band_profile", """
SELECT campaign_priority_band, count(*) AS customers, round(avg(churn_probability), 6) AS average_probability,
  round(avg(churn), 6) AS observed_churn_rate, round(count(*) / any_value(n), 6) AS customer_share,
  round(avg(churn) / any_value(rate), 6) AS observed_lift
FROM ranked_last, (SELECT avg(churn) AS rate FROM ranked_last) GROUP BY 1
""", "ranked_last")
block("last_scores", """
  SELECT h.customer_id, h.snapshot_date, h.churn_probability, r.segment, r.frequency::DOUBLE AS segment_frequency,
    r.monetary AS customer_value FROM holdout h LEFT JOIN rules r USING (customer_id)
""", "holdout", "rules")
_ranking("decided", "last_scores", "quantile_cont(customer_value, 0.99) OVER ()", "", "last_scores")


def _decisions(threshold: float) -> str:
    return f"""customer_id, snapshot_date::VARCHAR AS snapshot_date, segment, customer_value, segment_frequency,
  round(churn_probability, 6) AS churn_probability, (churn_probability >= {threshold})::BIGINT AS above_model_threshold,
  {threshold}::DOUBLE AS probability_threshold, campaign_priority_band,
  {_case('campaign_priority_band', fixed.CAMPAIGN_ACTIONS)} AS campaign_recommended_action,
  round(customer_value_cap, 6) AS customer_value_cap, round(value_at_risk_score, 6) AS value_at_risk_score,
  probability_rank, value_at_risk_rank, value_protection_priority_band,
  {_case('value_protection_priority_band', fixed.VALUE_ACTIONS)} AS value_protection_recommended_action,
  '{fixed.MODEL_VERSION}' AS model_version"""


twin("decision_table", f"SELECT {_decisions(0.4)} FROM decided", "decided")
twin("refreshed_decisions", f"SELECT {_decisions(0.5)} FROM decided", "decided")
twin("published_decisions", f"SELECT {_decisions(0.4)} FROM decided".replace(
    "customer_id, snap", "customer_id::VARCHAR AS customer_id, snap"), "decided")
_ACTIVE = f"""'value_protection' AS active_strategy, value_protection_priority_band AS active_priority_band,
  {_case('value_protection_priority_band', fixed.VALUE_ACTIONS)} AS active_recommended_action"""
twin("published_customer", f"SELECT {_decisions(0.4)}, {_ACTIVE} FROM decided "
     "WHERE customer_id = (SELECT max(customer_id) FROM decided)".replace("customer_id, snap", "customer_id, snap"), "decided")
TWINS["published_customer"] = TWINS["published_customer"].replace(
    "SELECT customer_id, snapshot_date::VARCHAR", "SELECT customer_id::VARCHAR AS customer_id, snapshot_date::VARCHAR")
twin("decision_listing", f"""
SELECT {_decisions(0.4)} FROM decided WHERE campaign_priority_band = 'Priority 3 - Nurture'
ORDER BY decided.value_at_risk_score DESC, customer_id LIMIT 50
""", "decided")
twin("strategy_view", f"SELECT customer_id, {_ACTIVE} FROM decided", "decided")
twin("upgraded_decisions", f"""
SELECT customer_id, snapshot_date::VARCHAR AS snapshot_date, round(churn_probability, 6) AS churn_probability,
  campaign_priority_band, (churn_probability >= 0.4)::BIGINT AS above_model_threshold,
  {_case('campaign_priority_band', fixed.CAMPAIGN_ACTIONS)} AS campaign_recommended_action,
  0.4::DOUBLE AS probability_threshold, 0.0::DOUBLE AS customer_value_cap, 0.0::DOUBLE AS value_at_risk_score,
  0::BIGINT AS probability_rank, 0::BIGINT AS value_at_risk_rank,
  'Standard monitoring' AS value_protection_priority_band,
  'Monitor customer value and churn risk' AS value_protection_recommended_action FROM decided
""", "decided")

# Segmentation ----------------------------------------------------------------------------

block("scaled", "SELECT customer_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER ()) AS {c}" for c in ("recency", "frequency", "monetary")
) + " FROM rfm_log", "rfm_log")
twin("scaled_rfm", "SELECT customer_id, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("recency", "frequency", "monetary")) + " FROM scaled", "scaled")


def _near(eps: float, name: str) -> None:
    block(f"near_{name}", f"""
  SELECT a.customer_id AS a, b.customer_id AS b FROM scaled a, scaled b
  WHERE (a.recency - b.recency) * (a.recency - b.recency) + (a.frequency - b.frequency) * (a.frequency - b.frequency)
    + (a.monetary - b.monetary) * (a.monetary - b.monetary) <= {eps}::DOUBLE * {eps}::DOUBLE
""", "scaled")
    block(f"core_{name}", f"SELECT a FROM near_{name} GROUP BY a HAVING count(*) >= {fixed.MIN_SAMPLES}", f"near_{name}")
    block(f"noise_{name}", f"""
  SELECT customer_id FROM scaled EXCEPT SELECT a FROM near_{name} WHERE b IN (SELECT a FROM core_{name})
""", f"near_{name}", f"core_{name}")


for _eps in fixed.OUTLIER_EPS:
    _near(_eps, str(round(_eps * 100)))
twin("dbscan_noise", """
SELECT customer_id, (customer_id IN (SELECT a FROM core_40))::BIGINT AS core,
  (customer_id IN (SELECT customer_id FROM noise_40))::BIGINT AS noise FROM scaled
""", "core_40", "noise_40")
twin("robust_outliers", " INTERSECT ".join(
    f"SELECT customer_id FROM noise_{round(e * 100)}" for e in fixed.OUTLIER_EPS), *[
    f"noise_{round(e * 100)}" for e in fixed.OUTLIER_EPS])
for _eps in fixed.OUTLIER_EPS:
    _name = str(round(_eps * 100))
    block(f"linked_{_name}", f"SELECT a, b FROM near_{_name} WHERE a IN (SELECT a FROM core_{_name}) AND b IN (SELECT a FROM core_{_name})",
          f"near_{_name}", f"core_{_name}")
    # Every core point takes the smallest label around it until none changes; it is its own neighbour.
    block(f"label_{_name}_rounds", f"""
  SELECT 0 AS round, a, a AS label, true AS moving FROM core_{_name}
  UNION ALL
  SELECT round, a, label, bool_or(label <> was) OVER () FROM (
    SELECT any_value(l.round) + 1 AS round, n.a, min(l.label) AS label, max(l.label) FILTER (l.a = n.a) AS was
    FROM label_{_name}_rounds l JOIN linked_{_name} n ON n.b = l.a WHERE l.moving GROUP BY n.a)
""", f"core_{_name}", f"linked_{_name}")
twin("dbscan_cluster_summary", " UNION ALL ".join(f"""
SELECT {e}::DOUBLE AS eps, (SELECT count(DISTINCT label) FROM label_{round(e * 100)}_rounds WHERE NOT moving) AS clusters,
  (SELECT count(*) FROM noise_{round(e * 100)}) AS noise_rows,
  round((SELECT count(*) FROM noise_{round(e * 100)}) / (SELECT count(*) FROM scaled), 6) AS noise_share
""" for e in fixed.OUTLIER_EPS), "scaled", *[f"{kind}_{round(e * 100)}{end}" for e in fixed.OUTLIER_EPS for kind, end in (("noise", ""), ("label", "_rounds"))])
twin("k_distance", f"""
SELECT customer_id, round(sqrt(d), 6) AS distance, row_number() OVER (ORDER BY sqrt(d), customer_id) AS position
FROM (SELECT a.customer_id, (a.recency - b.recency) * (a.recency - b.recency)
        + (a.frequency - b.frequency) * (a.frequency - b.frequency)
        + (a.monetary - b.monetary) * (a.monetary - b.monetary) AS d,
        row_number() OVER (PARTITION BY a.customer_id ORDER BY (a.recency - b.recency) * (a.recency - b.recency)
        + (a.frequency - b.frequency) * (a.frequency - b.frequency)
        + (a.monetary - b.monetary) * (a.monetary - b.monetary)) AS place FROM scaled a, scaled b)
WHERE place = {fixed.MIN_SAMPLES}
""", "scaled")
_RFM = ("recency", "frequency", "monetary")
_APART = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in _RFM)


def _kmeans(name: str, source: str, seeds, ks) -> None:
    """Starts, rounds, resting centres, labels and best restart of every fit over a block of points."""
    block(f"{name}_starts", f"""
  SELECT seed, restart, k, place - 1 AS j, recency, frequency, monetary FROM (
    SELECT p.*, seed, restart, row_number() OVER (PARTITION BY seed, restart
      ORDER BY md5(seed::VARCHAR || ':' || restart::VARCHAR || ':' || customer_id::VARCHAR), customer_id) AS place
    FROM {source} p, (SELECT unnest({list(seeds)}) AS seed), (SELECT unnest(range(10)) AS restart)
  ), (SELECT unnest({list(ks)}) AS k) WHERE place <= k
""", source)
    block(f"{name}_rounds", f"""
  SELECT 0 AS round, seed, restart, k, j, recency, frequency, monetary, true AS moving FROM {name}_starts
  UNION ALL
  SELECT round + 1, seed, restart, k, j, r, f, m,
    sum((r - recency) * (r - recency) + (f - frequency) * (f - frequency) + (m - monetary) * (m - monetary))
      OVER (PARTITION BY seed, restart, k) > 1e-10
  FROM (
    SELECT o.*, coalesce(n.r, o.recency) AS r, coalesce(n.f, o.frequency) AS f, coalesce(n.m, o.monetary) AS m
    FROM {name}_rounds o LEFT JOIN (
      SELECT seed, restart, k, j, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM (
        SELECT c.seed, c.restart, c.k, c.j, p.customer_id, p.recency, p.frequency, p.monetary, row_number() OVER (
          PARTITION BY c.seed, c.restart, c.k, p.customer_id ORDER BY {_APART}, c.j) AS place
        FROM {source} p, {name}_rounds c WHERE c.moving AND c.round < 100
      ) WHERE place = 1 GROUP BY 1, 2, 3, 4
    ) n ON o.seed = n.seed AND o.restart = n.restart AND o.k = n.k AND o.j = n.j
    WHERE o.moving AND o.round < 100
  )
""", f"{name}_starts", source)
    block(f"{name}_all", f"""
  SELECT c.seed, c.restart, c.k, c.j, p.customer_id, p.recency, p.frequency, p.monetary, {_APART} AS apart
  FROM {source} p, (SELECT * FROM {name}_rounds QUALIFY round = max(round) OVER (PARTITION BY seed, restart, k)) c
  QUALIFY row_number() OVER (PARTITION BY c.seed, c.restart, c.k, p.customer_id ORDER BY apart, c.j) = 1
""", f"{name}_rounds", source)
    block(f"{name}_labels", f"""
  SELECT l.* FROM {name}_all l JOIN (
    SELECT seed, k, arg_min(restart, round(inertia, 9)) AS restart
    FROM (SELECT seed, k, restart, sum(apart) AS inertia FROM {name}_all GROUP BY ALL ORDER BY restart) GROUP BY 1, 2
  ) b ON l.seed = b.seed AND l.k = b.k AND l.restart = b.restart
""", f"{name}_all")


_kmeans("elbow", "scaled", [42], range(2, 11))
_SQUARE = " + ".join(f"p.{c} * p.{c}" for c in _RFM)
twin("kmeans_elbow", f"""
SELECT k, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette FROM (
  SELECT k, avg(CASE WHEN own_n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM (
    SELECT p.k, p.customer_id, max(c.n) FILTER (c.j = p.j) AS own_n, max(c.total / nullif(c.n - 1, 0)) FILTER (c.j = p.j) AS a,
      min(c.total / c.n) FILTER (c.j <> p.j) AS b
    FROM (SELECT p.*, c.j AS other FROM elbow_labels p, (SELECT 1 AS j) c) p JOIN LATERAL (
      SELECT c.j, c.n, c.n * ({_SQUARE}) - 2 * (p.recency * c.r + p.frequency * c.f + p.monetary * c.m) + c.q AS total
      FROM (SELECT k, j, count(*) AS n, sum(recency) AS r, sum(frequency) AS f, sum(monetary) AS m,
          sum(recency * recency + frequency * frequency + monetary * monetary) AS q FROM elbow_labels GROUP BY 1, 2) c
      WHERE c.k = p.k
    ) c ON true GROUP BY 1, 2
  ) GROUP BY 1
) JOIN (SELECT k, sum(apart) AS inertia FROM elbow_labels GROUP BY 1) USING (k)
""", "elbow_labels")
twin("kmeans_silhouette", """
SELECT k, count(*) AS points, max(clusters) AS clusters,
  round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
  SELECT k, customer_id, count(*) AS clusters, max(total / nullif(n - 1, 0)) FILTER (own) AS a, min(total / n) FILTER (NOT own) AS b FROM (
    SELECT p.k, p.customer_id, p.j = o.j AS own, count(*) AS n, sum(sqrt((p.recency - o.recency) * (p.recency - o.recency)
      + (p.frequency - o.frequency) * (p.frequency - o.frequency) + (p.monetary - o.monetary) * (p.monetary - o.monetary))) AS total
    FROM elbow_labels p JOIN elbow_labels o ON p.k = o.k GROUP BY p.k, p.customer_id, p.j, o.j
  ) GROUP BY 1, 2
) GROUP BY 1
""", "elbow_labels")
_kmeans("steady", "scaled", fixed.STABILITY_SEEDS, [fixed.SEGMENT_COUNT])
_PAIRS = "sum(n * (n - 1) / 2.0::DOUBLE)"
twin("kmeans_stability", f"""
SELECT seed_a, seed_b, round(coalesce((inside - of_a * of_b / pairs) / nullif((of_a + of_b) / 2 - of_a * of_b / pairs, 0), 1), 6) AS adjusted_rand
FROM (SELECT seed_a, seed_b, {_PAIRS} AS inside FROM (
    SELECT a.seed AS seed_a, b.seed AS seed_b, a.j AS x, b.j AS y, count(*) AS n
    FROM steady_labels a JOIN steady_labels b ON a.customer_id = b.customer_id GROUP BY ALL) GROUP BY 1, 2)
JOIN (SELECT seed AS seed_a, {_PAIRS} AS of_a FROM (SELECT seed, j, count(*) AS n FROM steady_labels GROUP BY 1, 2) GROUP BY 1) USING (seed_a)
JOIN (SELECT seed AS seed_b, {_PAIRS} AS of_b FROM (SELECT seed, j, count(*) AS n FROM steady_labels GROUP BY 1, 2) GROUP BY 1) USING (seed_b),
  (SELECT count(*) * (count(*) - 1) / 2.0::DOUBLE AS pairs FROM scaled),
  (SELECT {list(fixed.STABILITY_SEEDS)} AS seeds)
WHERE list_position(seeds, seed_a) < list_position(seeds, seed_b)
""", "steady_labels", "scaled")
block("outliers", " INTERSECT ".join(f"SELECT customer_id FROM noise_{round(e * 100)}" for e in fixed.OUTLIER_EPS),
      *[f"noise_{round(e * 100)}" for e in fixed.OUTLIER_EPS])
block("inner_log", "SELECT * FROM rfm_log WHERE customer_id NOT IN (SELECT customer_id FROM outliers)", "rfm_log", "outliers")
block("inner_scaled", "SELECT customer_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER ()) AS {c}" for c in _RFM)
      + " FROM inner_log", "inner_log")
_kmeans("hybrid", "inner_scaled", [42], [fixed.SEGMENT_COUNT])
block("named", f"""
  SELECT j, CASE WHEN place = 1 THEN {_quoted([fixed.SEGMENT_CHAMPIONS])} WHEN place = last THEN {_quoted([fixed.SEGMENT_LAPSED])}
      WHEN row_number() OVER (PARTITION BY place > 1 AND place < last ORDER BY recency, j) = 1 THEN {_quoted([fixed.SEGMENT_RECENT])}
      ELSE {_quoted([fixed.SEGMENT_AT_RISK])} END AS segment
  FROM (SELECT *, row_number() OVER (ORDER BY frequency + monetary - recency DESC, j) AS place, count(*) OVER () AS last FROM (
    SELECT h.j, avg(l.recency) AS recency, avg(l.frequency) AS frequency, avg(l.monetary) AS monetary
    FROM hybrid_labels h JOIN inner_log l ON h.customer_id = l.customer_id GROUP BY 1))
""", "hybrid_labels", "inner_log")
twin("kmeans_segments", f"""
SELECT r.customer_id, coalesce(n.segment, {_quoted([fixed.SEGMENT_OUTLIER])}) AS segment, r.recency, r.frequency, round(r.monetary, 6) AS monetary,
  (SELECT max(invoice_date) + INTERVAL 1 DAY FROM model)::DATE::VARCHAR AS snapshot_date
FROM rfm r LEFT JOIN hybrid_labels h ON r.customer_id = h.customer_id LEFT JOIN named n ON h.j = n.j
""", "rfm", "hybrid_labels", "named", "model")

# Principal components: eigenvalues of the 3 x 3 covariances by the cosine formula, a component as the cross product
# of two rows of (covariances - eigenvalue).
block("moments", """
  SELECT *, (a + b + c) / 3 AS q, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)
    + 2 * (d * d + e * e + g * g)) / 6) AS p
  FROM (SELECT var_samp(recency) AS a, var_samp(frequency) AS b, var_samp(monetary) AS c, covar_samp(recency, frequency) AS d,
    covar_samp(recency, monetary) AS e, covar_samp(frequency, monetary) AS g FROM scaled)
""", "scaled")
block("turned", """
  SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - g * g) - d * (d * (c - q) - g * e) + e * (d * g - (b - q) * e))
    / (2 * p * p * p)))) / 3 AS angle FROM moments
""", "moments")
block("components", """
  SELECT component, variance, x / size AS x, y / size AS y, z / size AS z FROM (
    SELECT *, sqrt(x * x + y * y + z * z) * CASE WHEN abs(x) >= greatest(abs(y), abs(z)) - 1e-12 THEN sign(x)
      WHEN abs(y) >= abs(z) - 1e-12 THEN sign(y) ELSE sign(z) END AS size FROM (
      SELECT component, variance, d * g - e * (b - variance) AS x, d * e - (a - variance) * g AS y, (a - variance) * (b - variance) - d * d AS z
      FROM (SELECT *, unnest([1, 2, 3]) AS component, unnest([q + 2 * p * cos(angle), 3 * q - (q + 2 * p * cos(angle)) - (q + 2 * p * cos(angle + 2 * pi() / 3)),
        q + 2 * p * cos(angle + 2 * pi() / 3)]) AS variance FROM turned)))
""", "turned")
twin("rfm_plane", """
SELECT customer_id, round(s.recency * u.x + s.frequency * u.y + s.monetary * u.z, 6) + 0.0 AS pc1,
  round(s.recency * v.x + s.frequency * v.y + s.monetary * v.z, 6) + 0.0 AS pc2
FROM scaled s, (SELECT * FROM components WHERE component = 1) u, (SELECT * FROM components WHERE component = 2) v
""", "scaled", "components")
twin("rfm_plane_shares", """
SELECT component, round(variance, 6) AS variance, round(variance / sum(variance) OVER (), 6) AS explained_share FROM components
""", "components")
block("context", """
  SELECT r.*, primary_country, years_active FROM rules r
  LEFT JOIN (SELECT customer_id, arg_min(country, place) AS primary_country FROM (SELECT customer_id, country,
        row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS place FROM bought GROUP BY 1, 2)
      GROUP BY 1) USING (customer_id)
  LEFT JOIN (SELECT customer_id, string_agg(source_sheet, ' & ' ORDER BY source_sheet) AS years_active
      FROM (SELECT DISTINCT customer_id, source_sheet FROM bought) GROUP BY 1) USING (customer_id)
""", "rules", "bought")
twin("segment_context", "SELECT * FROM context", "context")
_MEDIANS = ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in ("recency", "frequency", "monetary"))
twin("segment_stats", f"""
SELECT segment, count(*) AS customers, round(avg((primary_country = 'NATION_1')::INT) * 100, 6) AS home_share_pct,
  {_MEDIANS}, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM context GROUP BY 1
""", "context")
twin("segment_foreign_countries", """
SELECT * FROM (SELECT segment, primary_country, count(*) AS customers,
    row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, primary_country) AS place
  FROM context WHERE primary_country <> 'NATION_1' GROUP BY 1, 2) WHERE place <= 3
""", "context")
twin("years_active_crosstab", """
SELECT segment, years_active, count(c.customer_id) AS customers,
  round(count(c.customer_id) * 100.0::DOUBLE / any_value(n), 6) AS segment_share_pct
FROM (SELECT * FROM (SELECT segment, count(*) AS n FROM context GROUP BY 1),
    (SELECT DISTINCT years_active FROM context WHERE years_active IS NOT NULL))
LEFT JOIN context c USING (segment, years_active) GROUP BY 1, 2
""", "context")
twin("lifecycle_split", f"""
SELECT CASE WHEN years_active = (SELECT max(source_sheet) FROM bought) THEN 'new' ELSE 'long-tenured' END AS lifecycle,
  count(*) AS customers, {_MEDIANS}, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM context WHERE segment = '{fixed.SEGMENT_RECENT}' GROUP BY 1
""", "context", "bought")
twin("model_information", f"""
SELECT '{fixed.MODEL_VERSION}' AS model_version, {fixed.HISTORY_DAYS}::BIGINT AS observation_window_days,
  {fixed.HORIZON_DAYS}::BIGINT AS prediction_horizon_days, {fixed.PROBABILITY_THRESHOLD}::DOUBLE AS probability_threshold,
  41::BIGINT AS feature_count, min(snapshot_date)::VARCHAR AS training_snapshot_start, max(snapshot_date)::VARCHAR AS training_snapshot_end
FROM lab
""", "lab")
