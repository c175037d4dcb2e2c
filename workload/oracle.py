"""DuckDB SQL for every query, written independently of the library's expressions."""

from workload.model import AS_OF, DUCKDB, LEAD_IMPORT_AS_OF, TABLES, duckdb_ctes

NOW = f"TIMESTAMP '{AS_OF}'"
IMPORT_NOW = f"TIMESTAMP '{LEAD_IMPORT_AS_OF}'"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, ctes: list[str] | None = None) -> None:
    """Register SQL; the model tables it mentions are defined in front of it.

    `ctes` are further common table expressions, "name AS (...)".
    """
    whole = "\n".join([*(ctes or []), body])
    used = [t for t in TABLES if f"m_{t}" in whole]
    sql = ",\n".join([duckdb_ctes(used), *(ctes or [])])
    ORACLES[name] = f"{sql}\n{body}"


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def double(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def mean(money: str) -> str:
    """Average to four places, rounded half up in whole numbers."""
    n = f"count({money})"
    return f"CAST((CAST(sum({money}) * 20000 AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 10000"


def number(expr: str) -> str:
    return f"CASE WHEN regexp_matches(trim({expr}), '{NUMBER}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END"


def days_since(now: str, t: str) -> str:
    return f"coalesce(CAST(floor((epoch_us({now}) - epoch_us({t})) / 86400000000.0) AS BIGINT), 999)"


# --- reports ---------------------------------------------------------------------

oracle("order_kpis", f"""
SELECT count(*) AS total, {double('coalesce(sum(net_revenue), 0)')} AS total_revenue,
       coalesce({mean('net_revenue')}, 0)
         AS avg_order_value,
       {double('coalesce(sum(shipping_cost), 0)')} AS total_shipping,
       {double('coalesce(sum(seller_shipping_discount), 0)')} AS total_subsidi_ongkir
FROM m_orders WHERE order_status = 'completed'""")

oracle("customer_kpis", """
SELECT count(*) AS total, count(*) FILTER (WHERE segment = 'Loyal') AS loyal,
       count(*) FILTER (WHERE segment = 'Returning') AS returning,
       count(*) FILTER (WHERE segment = 'New') AS new,
       count(*) FILTER (WHERE segment = 'Churn') AS churn
FROM m_customers""")


def monthly(months: int) -> str:
    def part(comparison: str) -> str:
        condition = f"CAST(order_date AS DATE) {comparison} CAST(first_order_date AS DATE)"
        return double(f"sum(CASE WHEN {condition} THEN net_revenue ELSE 0 END)")

    return f"""
SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders,
       {double('sum(net_revenue)')} AS revenue, {part('=')} AS revenue_new,
       {part('>')} AS revenue_repeat
FROM m_orders AS o LEFT JOIN m_customers AS c ON o.customer_id = c.customer_id
WHERE order_status = 'completed' AND order_date >= {NOW} - INTERVAL '{months}' MONTH
GROUP BY 1 ORDER BY 1"""


oracle("monthly_new_vs_repeat", monthly(24))
oracle("monthly_new_vs_repeat_all", monthly(120))


def top_products(keys: str) -> str:
    return f"""
SELECT i.product_id, max(coalesce(p.product_name, i.product_name)) AS product_name,
       max(i.product_category) AS product_category, count(*) AS order_count,
       {big('sum(qty_item)')} AS total_qty
FROM m_items AS i
JOIN m_orders AS o ON i.order_id = o.order_id AND i.source_platform = o.source_platform
LEFT JOIN m_products AS p ON i.product_id = p.product_id
WHERE order_status = 'completed' AND i.product_id IS NOT NULL
  AND i.product_id NOT IN ('UNMAPPED', 'UNKNOWN', 'CGEB_UNKNOWN', 'CTPWSU_UNKNOWN')
GROUP BY {keys} ORDER BY total_qty DESC NULLS LAST, {keys} LIMIT 10"""


oracle("top_products", top_products("i.product_id"))
oracle("top_products_by_category", top_products("i.product_id, i.product_category"))

oracle("top_provinces", """
SELECT province, count(*) AS customers FROM m_customers WHERE province IS NOT NULL
GROUP BY province ORDER BY customers DESC, province LIMIT 10""")


def revenue(period: str, where: str = "") -> str:
    return f"""
SELECT {period} AS period, count(*) AS orders, {double('sum(net_revenue)')} AS revenue,
       {mean('net_revenue')} AS avg_order_value,
       {big('sum(total_qty)')} AS total_qty
FROM m_orders WHERE order_status = 'completed' {where}
GROUP BY 1 ORDER BY 1"""


WEEK1 = "CAST(date_trunc('week', make_date(year(order_date), 1, 4)) AS DATE)"
WEEK = f"CAST(floor(date_diff('day', {WEEK1}, CAST(order_date AS DATE)) / 7.0) + 1 AS BIGINT)"
oracle("revenue_by_month", revenue("strftime(order_date, '%Y-%m')"))
oracle("revenue_by_week", revenue(
    f"concat(CAST(year(order_date) AS VARCHAR), '-', lpad(CAST({WEEK} AS VARCHAR), 2, '0'))"
))
oracle("revenue_by_day", revenue("strftime(order_date, '%Y-%m-%d')"))
oracle("revenue_in_range", revenue(
    "strftime(order_date, '%Y-%m')",
    "AND order_date >= TIMESTAMP '1998-03-05' AND order_date <= TIMESTAMP '1999-11-20 12:00:00'",
))

oracle("pipeline_stats", f"""
SELECT pipeline_status, count(*) AS total, {big('sum(converted)')} AS converted FROM m_leads
GROUP BY pipeline_status ORDER BY total DESC, pipeline_status NULLS FIRST""")

# --- listings and views ----------------------------------------------------------

CUSTOMER_PAGE = f"""
SELECT customer_id, name, city, province, segment, total_orders,
       {double('total_revenue')} AS total_revenue, {double('avg_order_value')} AS avg_order_value,
       last_order_date, first_platform, last_platform, recency_days, first_order_date
FROM m_customers"""

oracle("list_customers_page", f"""{CUSTOMER_PAGE}
ORDER BY m_customers.total_revenue DESC NULLS LAST, customer_id LIMIT 50 OFFSET 100""")
oracle("list_customers_search", f"""{CUSTOMER_PAGE}
WHERE name ILIKE '%customer#0000001%' AND province ILIKE '%a%'
  AND (first_platform = 'mengantar' OR last_platform = 'mengantar')
ORDER BY last_order_date ASC NULLS FIRST, customer_id LIMIT 500""")
oracle("list_customers_by_phone", f"""{CUSTOMER_PAGE}
WHERE customer_id LIKE '62800000001%'
ORDER BY last_order_date DESC NULLS LAST, customer_id LIMIT 100""")

oracle("list_customers_backslash", f"""{CUSTOMER_PAGE}
WHERE contains(lower(name), 'customer\\#0000001')
ORDER BY last_order_date DESC NULLS LAST, customer_id LIMIT 500""")

oracle("customers_with_backslash", f"""
SELECT customer_id, replace(name, '#', '\\#') AS name, province FROM m_customers
WHERE contains(name, '#0000001') AND province ILIKE '%a%'""")
oracle("list_orders_page_near_end", f"""
SELECT order_id, source_platform, order_date, customer_name, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       shipping_provider, total_qty
FROM (SELECT *, row_number() OVER (ORDER BY order_date DESC NULLS LAST, order_id, source_platform) AS n,
             greatest(1, CAST(ceil(count(*) OVER () / 100.0) AS BIGINT) * 9 // 10) AS page
      FROM m_orders) AS o
WHERE n > (page - 1) * 100 AND n <= page * 100""")
oracle("list_orders_deep_page", f"""
SELECT order_id, source_platform, order_date, customer_name, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       shipping_provider, total_qty
FROM m_orders ORDER BY order_date DESC NULLS LAST, order_id, source_platform LIMIT 100 OFFSET 1200""")

oracle("list_orders_page", f"""
SELECT order_id, source_platform, order_date, customer_name, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       shipping_provider, total_qty
FROM m_orders
WHERE order_status = 'completed' AND source_platform = 'mengantar'
  AND order_date >= TIMESTAMP '1997-01-01' AND order_date <= TIMESTAMP '2000-06-30'
ORDER BY order_date DESC NULLS LAST, order_id, source_platform LIMIT 100 OFFSET 100""")

oracle("list_leads_page", f"""
SELECT l.*, c.segment, c.total_orders, {double('c.total_revenue')} AS total_revenue,
       c.last_order_date AS customer_last_order_date
FROM m_leads AS l LEFT JOIN m_customers AS c ON l.customer_id = c.customer_id
WHERE label_names ILIKE '%LABEL%' AND l.created_at >= TIMESTAMP '2000-06-01'
  AND l.created_at <= TIMESTAMP '2001-07-01 23:59:59'
ORDER BY l.created_at ASC NULLS FIRST, l.contact_id LIMIT 50 OFFSET 50""")

oracle("filter_customers", """
SELECT customer_id, segment, province FROM m_customers
WHERE segment = 'Loyal' AND lower(province) LIKE '%asia%'""")

oracle("filter_leads_prospects", """
SELECT contact_id, kota, track, converted FROM m_leads
WHERE pipeline_status = 'Prospect' AND converted = 0 AND (name LIKE '%00%' OR phone LIKE '%00%')
  AND kota ILIKE '%nation_1%' AND track = 'T2-Nurturing'""")

oracle("leads_page_info", f"""
SELECT count(*) AS total, {big('ceil(count(*) / 20.0)')} AS pages
FROM m_leads WHERE converted = 0""")

oracle("orders_with_product_list", f"""
SELECT o.order_id, o.source_platform, customer_id, order_date, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       total_qty, CAST(0 AS BIGINT) AS part, products
FROM m_orders AS o
LEFT JOIN (SELECT order_id, source_platform,
                  string_agg(product_name, ', ' ORDER BY item_id) AS products
           FROM m_items GROUP BY ALL) AS i
  ON o.order_id = i.order_id AND o.source_platform = i.source_platform""")

PIECES = """
SELECT order_id, source_platform, part, string_agg(product_name, ', ' ORDER BY item_id) AS products
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY order_id, source_platform ORDER BY item_id) - 1)
                     // 2 AS BIGINT) AS part
      FROM m_items WHERE product_name IS NOT NULL)
GROUP BY ALL"""
oracle("orders_with_cut_product_list", f"""
SELECT o.order_id, o.source_platform, customer_id, order_date, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       total_qty, coalesce(part, CAST(0 AS BIGINT)) AS part, products
FROM m_orders AS o LEFT JOIN ({PIECES}) AS i
  ON o.order_id = i.order_id AND o.source_platform = i.source_platform""")

oracle("lead_detail", f"""
SELECT a.contact_id, l.contact_id IS NOT NULL AS found, l.name, phone, l.customer_id, c.segment,
       c.total_orders, {double('c.total_revenue')} AS total_revenue,
       c.last_order_date AS customer_last_order_date
FROM (SELECT DISTINCT contact_id FROM m_lead_export) AS a
LEFT JOIN m_leads AS l ON a.contact_id = l.contact_id
LEFT JOIN m_customers AS c ON l.customer_id = c.customer_id""")

oracle("leads_enriched", f"""
SELECT contact_id, l.name, phone, l.customer_id, c.segment, c.total_orders,
       {double('c.total_revenue')} AS total_revenue,
       c.last_order_date AS customer_last_order_date
FROM m_leads AS l LEFT JOIN m_customers AS c ON l.customer_id = c.customer_id""")

HISTORY = f"""
SELECT c.customer_id, c.name,
       (SELECT count(*) FROM m_orders AS x WHERE x.customer_id = c.customer_id) AS order_count,
       o.order_id, o.source_platform, order_date, order_status, payment_method,
       {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
       shipping_provider, total_qty, product_name, product_raw, qty_item, product_category
FROM m_customers AS c
LEFT JOIN m_orders AS o ON c.customer_id = o.customer_id
LEFT JOIN m_items AS i ON o.order_id = i.order_id AND o.source_platform = i.source_platform
  AND is_parent_row = 1"""
oracle("customer_360_flat", HISTORY)
oracle("customer_360_nested", HISTORY)


def normalized(phone: str) -> str:
    digits = f"regexp_replace({phone}, '[^0-9]', '', 'g')"
    full = f"""CASE WHEN {digits} LIKE '0%' THEN concat('62', substring({digits}, 2))
                    WHEN {digits} LIKE '8%' THEN concat('62', {digits}) ELSE {digits} END"""
    return f"""CASE WHEN {phone} IS NOT NULL AND length({full}) >= 10 AND {full} LIKE '62%'
                    THEN substring({full}, 1, 13) END"""


oracle("phone_match", f"""
SELECT n.row_id, n.phone, normalized_phone, name, segment, total_orders,
       {double('total_revenue')} AS total_revenue,
       CASE WHEN normalized_phone IS NULL THEN 'invalid' WHEN customer_id IS NULL THEN 'not_found'
            ELSE 'found' END AS match_status
FROM (SELECT row_id, phone, {normalized('phone')} AS normalized_phone FROM m_messy_phones) AS n
LEFT JOIN m_customers AS c ON n.normalized_phone = c.customer_id""")

oracle("phone_lookup_orders", f"""
SELECT n.row_id, normalized_phone AS customer_id,
       CASE WHEN normalized_phone IS NULL THEN 'invalid' WHEN c.customer_id IS NULL THEN 'not_found'
            ELSE 'found' END AS match_status,
       o.order_id, o.source_platform, o.order_date, {double('o.net_revenue')} AS net_revenue,
       CASE WHEN o.order_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS part, products
FROM (SELECT row_id, {normalized('phone')} AS normalized_phone FROM m_messy_phones) AS n
LEFT JOIN m_customers AS c ON n.normalized_phone = c.customer_id
LEFT JOIN m_orders AS o ON o.customer_id = c.customer_id
LEFT JOIN (SELECT order_id, source_platform,
                  string_agg(product_name, ', ' ORDER BY item_id) AS products
           FROM m_items GROUP BY ALL) AS i
  ON o.order_id = i.order_id AND o.source_platform = i.source_platform""")

# --- cleansing -------------------------------------------------------------------


def courier_phone(phone: str) -> str:
    bare = f"replace(replace(ltrim(trim({phone}), ''''), ' ', ''), '-', '')"
    return f"""CASE WHEN {phone} IS NULL OR {bare} IN ('', 'nan') THEN NULL
                    WHEN {bare} LIKE '0%' THEN concat('62', substring({bare}, 2))
                    WHEN {bare} LIKE '62%' THEN {bare} ELSE concat('62', {bare}) END"""


def whole_text(expr: str) -> str:
    return f"CAST(TRY_CAST(trunc({number(expr)}) AS BIGINT) AS VARCHAR)"


oracle("clean_phones", f"""
SELECT row_id, {normalized('phone')} AS normalized, {courier_phone('phone')} AS courier,
       {whole_text('phone')} AS lead
FROM m_messy_phones""")


def courier_text(expr: str) -> str:
    bare = f"ltrim(trim({expr}), '''')"
    return f"CASE WHEN {bare} NOT IN ('', 'nan', 'NaN') THEN {bare} END"


def whole(expr: str, default: int) -> str:
    n = number(expr)
    return f"CAST(trunc(coalesce(nullif({n}, 0), {default})) AS BIGINT)"


COURIER_ROWS = f"""c_rows AS (
SELECT row_no, {courier_text('"Order ID"')} AS order_id,
       {courier_phone('"Customer Phone Number"')} AS phone,
       {courier_text('"Customer Name"')} AS name, {courier_text('"Province"')} AS province,
       {courier_text('"City"')} AS city,
       CASE trim("Expedition") WHEN 'JT' THEN 'J&T' WHEN 'jt' THEN 'J&T'
            WHEN 'lion' THEN 'Lion Parcel' WHEN 'Sap' THEN 'SAP' WHEN 'sap' THEN 'SAP'
            WHEN 'iDexpress' THEN 'ID Express' ELSE trim("Expedition") END AS shipping_provider,
       CASE WHEN upper("Last Status") LIKE '%DELIVERED%'
             AND upper("Last Status") NOT LIKE '%UN%' THEN 'completed'
            WHEN upper(trim("Last Status")) IN ('RTS', 'CANCELLED', 'UNDELIVERED') THEN 'rts'
            WHEN upper("Last Status") LIKE '%CANCEL%' THEN 'cancelled'
            ELSE 'processing_unpaid' END AS order_status,
       try_strptime("Create Date", '%d-%m-%Y %H:%M') AS order_date,
       "Goods Description" AS goods,
       CAST({whole('"Quantity"', 1)} AS INTEGER) AS total_qty,
       CAST({whole('"Product Value"', 0)} AS DECIMAL(18,2)) AS net_revenue,
       CAST({whole('"Shipping Fee"', 0)} AS DECIMAL(18,2)) AS shipping_cost,
       CASE WHEN {number('"COD"')} > 0 THEN 'COD' ELSE 'Bank Transfer' END AS payment_method
FROM m_courier_export)"""

oracle("clean_courier_fields", f"""
SELECT * EXCLUDE (goods, net_revenue, shipping_cost), {double('net_revenue')} AS net_revenue,
       {double('shipping_cost')} AS shipping_cost
FROM c_rows WHERE order_id IS NOT NULL""", [COURIER_ROWS])


def rupiah(expr: str) -> str:
    bare = f"trim(replace(replace({expr}, 'Rp', ''), ',', ''))"
    return f"TRY_CAST({bare} AS DECIMAL(18,2))"


oracle("parse_rupiah", f"""
SELECT product_name, product_price, product_cost, {double(rupiah('product_price'))} AS price,
       {double(rupiah('product_cost'))} AS cost
FROM m_raw_products""")

oracle("clean_lead_times", f"""
SELECT row_no,
       CASE WHEN created_at LIKE '%+07:00'
            THEN TRY_CAST(replace(created_at, '+07:00', '') AS TIMESTAMP) - INTERVAL '7' HOUR
            ELSE TRY_CAST(created_at AS TIMESTAMP) END AS created_at,
       nullif(note, 'None') AS note, substring(label_names, 1, 50) AS label_names
FROM m_lead_export""")

oracle("null_nan_prices", f"""
SELECT order_id, CASE WHEN total_qty <> 1 THEN {double('net_revenue')} END AS net_revenue
FROM m_orders""")

GOODS = """goods_rows AS (
SELECT *, list_filter(list_transform(string_split(whole, ','), lambda x : trim(x)),
                      lambda x : x <> '') AS parts
FROM (SELECT *, ltrim(trim(goods), '''') AS whole FROM {source}) AS g),
goods_items AS (
SELECT *, CASE WHEN len(parts) > 0 THEN parts WHEN whole = '' THEN ['Unknown'] ELSE [whole] END
         AS names
FROM goods_rows)"""

oracle("explode_goods", """
SELECT row_no, unnest(range(len(names))) AS item_id, unnest(names) AS product_raw,
       CAST(1 AS BIGINT) AS qty_item
FROM goods_items WHERE order_id IS NOT NULL""", [COURIER_ROWS, GOODS.format(source="c_rows")])

oracle("null_orphan_fk", """
SELECT order_id, item_id,
       CASE WHEN product_id IN (SELECT product_id FROM m_products) THEN product_id END
         AS product_id, qty_item
FROM m_items""")

MASTER_PRODUCTS = f"""
SELECT product_id, product_category, product_subcategory, product_name,
       {double(rupiah('product_price'))} AS product_price,
       {double(rupiah('product_cost'))} AS product_cost,
       TRY_CAST(product_weight AS DOUBLE) AS product_weight
FROM m_raw_products WHERE product_id IS NOT NULL
UNION ALL
SELECT 'EDEQPC01', 'Education', 'Equipment', 'Peralatan Cuci Sarang Walet', NULL, NULL, NULL"""
oracle("master_products", MASTER_PRODUCTS)

oracle("master_customers", f"""
SELECT customer_id, name, phone_raw, TRY_CAST(first_order_date AS TIMESTAMP) AS first_order_date,
       TRY_CAST(last_order_date AS TIMESTAMP) AS last_order_date,
       CAST(TRY_CAST(recency_days AS DOUBLE) AS BIGINT) AS recency_days,
       TRY_CAST(recency_months AS DOUBLE) AS recency_months,
       TRY_CAST(total_orders AS BIGINT) AS total_orders,
       TRY_CAST(total_revenue AS DOUBLE) AS total_revenue,
       CASE WHEN segment IN ('New', 'Returning', 'Loyal', 'Churn', 'Unknown') THEN segment
            ELSE 'Unknown' END AS segment
FROM m_raw_customers""")


def raw_orders(customer: str, flags: str) -> str:
    return f"""
SELECT order_id, source_platform, TRY_CAST(order_date AS TIMESTAMP) AS order_date,
       TRY_CAST(completed_date AS TIMESTAMP) AS completed_date, {customer} AS customer_id,
       TRY_CAST(net_revenue AS DOUBLE) AS net_revenue,
       TRY_CAST(gross_revenue AS DOUBLE) AS gross_revenue,
       TRY_CAST(shipping_cost AS DOUBLE) AS shipping_cost,
       CAST(CASE WHEN is_hpp IN ({flags}) THEN 1 ELSE 0 END AS INTEGER) AS is_hpp
FROM m_raw_orders"""


oracle("master_orders", raw_orders("customer_id", "'True', '1'"))
oracle("reload_orders", raw_orders(
    "CASE WHEN customer_id NOT IN ('', 'nan') THEN split_part(customer_id, '.', 1) END", "'True'"
))


def raw_items(product: str) -> str:
    return f"""
SELECT order_id, source_platform, product_raw, {product} AS product_id, product_name,
       product_category, coalesce(TRY_CAST(qty_item AS BIGINT), 1) AS qty_item,
       CAST(CASE is_parent_row WHEN 'True' THEN 1 ELSE 0 END AS INTEGER) AS is_parent_row
FROM m_raw_items"""


oracle("master_items", raw_items(
    "CASE WHEN product_id IN (SELECT product_id FROM catalogue) THEN product_id END"
), [f"catalogue AS ({MASTER_PRODUCTS})"])
oracle("reload_items", raw_items("product_id"))

oracle("load_report", """
SELECT 'products' AS table_name, count(*) AS rows FROM m_products
UNION ALL SELECT 'customers', count(*) FROM m_customers
UNION ALL SELECT 'orders', count(*) FROM m_orders
UNION ALL SELECT 'order_items', count(*) FROM m_items
UNION ALL SELECT 'leads', count(*) FROM m_leads""")

oracle("order_form_check", """
SELECT 'product, phone, name, status, payment_method, created_at' AS missing, count(*) AS rows
FROM m_raw_orders""")

# --- rules -----------------------------------------------------------------------


def refreshed(customers: str, orders: str) -> str:
    """Customers of the courier platform with statistics by correlated subqueries."""
    mine = "c.last_platform = 'mengantar'"
    of = f"FROM {orders} AS o WHERE o.customer_id = c.customer_id"
    done = f"{of} AND o.order_status = 'completed'"
    return f"""
SELECT c.* EXCLUDE (total_orders, total_revenue, last_order_date),
       CASE WHEN {mine} THEN (SELECT count(*) {done}) ELSE c.total_orders END AS total_orders,
       CASE WHEN {mine} THEN (SELECT coalesce(sum(o.net_revenue), 0) {done})
            ELSE c.total_revenue END AS total_revenue,
       CASE WHEN {mine} THEN (SELECT max(o.order_date) {of}) ELSE c.last_order_date END
         AS last_order_date
FROM {customers} AS c"""


SEGMENT = f"""CASE WHEN total_orders >= 4 THEN 'Loyal' WHEN total_orders >= 2 THEN 'Returning'
     WHEN total_orders = 1 AND date_diff('day', last_order_date, {NOW}) <= 90 THEN 'New'
     ELSE 'Churn' END"""

oracle("refresh_customer_stats", f"""
SELECT customer_id, last_platform, total_orders, {double('total_revenue')} AS total_revenue,
       {double('avg_order_value')} AS avg_order_value, first_order_date, last_order_date
FROM ({refreshed('stale', 'm_orders')}) AS r""", ["""stale AS (
SELECT * REPLACE (total_orders + 1 AS total_orders, first_order_date AS last_order_date)
FROM m_customers)"""])

oracle("assign_segments", f"""
SELECT customer_id, total_orders, last_order_date, {SEGMENT} AS segment FROM m_customers""")


def buyers(orders: str, customers: str, now: str, days: int | None) -> str:
    recent = "" if days is None else f"AND order_date >= {now} - INTERVAL '{days}' DAY"
    return f"""buyers AS (
SELECT phone_raw, max(order_date) AS last_bought
FROM {orders} AS o JOIN {customers} AS c ON o.customer_id = c.customer_id
WHERE order_status = 'completed' AND phone_raw IS NOT NULL {recent} GROUP BY phone_raw)"""


def track(policy: str, now: str) -> str:
    created, active = days_since(now, "created_at"), days_since(
        now, "coalesce(last_message_at, created_at)"
    )
    bought = days_since(now, "last_bought")
    prospect = f"""WHEN converted = 1 THEN 'T3-Fresh' WHEN {created} <= 14 THEN 'T1-Akuisisi'
         WHEN {active} <= 90 THEN 'T2-Nurturing' ELSE 'T4-Winback' END"""
    branches = {
        "courier_import": f"""WHEN phone_raw IS NOT NULL THEN 'T3-Fresh'
         WHEN {active} <= 90 THEN 'T2-Nurturing'
         WHEN last_message_at IS NOT NULL THEN 'T4-Winback' ELSE 'T1-Akuisisi' END""",
        "lead_import": f"WHEN phone_raw IS NOT NULL THEN 'T3-Fresh' {prospect}",
        "full_sync": f"""WHEN phone_raw IS NOT NULL AND {bought} <= 90 THEN 'T3-Fresh'
         WHEN phone_raw IS NOT NULL AND {bought} <= 365 THEN 'T3-Lama'
         WHEN phone_raw IS NOT NULL THEN 'T4-Winback' {prospect}""",
    }
    return f"CASE WHEN trim(pipeline_status) = 'Blacklist' THEN 'Arsip' {branches[policy]}"


def tracked(leads: str, policy: str, now: str) -> str:
    converted = "converted"
    if policy == "courier_import":
        converted = "CASE WHEN phone_raw IS NOT NULL THEN 1 ELSE converted END"
    return f"""tracked AS (
SELECT contact_id, phone, pipeline_status, customer_id,
       CAST({converted} AS INTEGER) AS converted, track AS previous_track,
       {track(policy, now)} AS track
FROM {leads} AS l LEFT JOIN buyers AS b ON l.phone = b.phone_raw)"""


def track_ctes(policy: str, days: int | None) -> list[str]:
    return [buyers("m_orders", "m_customers", NOW, days), tracked("m_leads", policy, NOW)]


TRACKED = """
SELECT contact_id, phone, pipeline_status, converted, previous_track, track FROM tracked"""
oracle("tracks_courier_import", TRACKED, track_ctes("courier_import", 90))
oracle("tracks_lead_import", TRACKED, track_ctes("lead_import", 90))
oracle("tracks_full_sync", TRACKED, track_ctes("full_sync", None))
oracle("filter_leads_winback_paid", """
SELECT contact_id, track FROM tracked WHERE track = 'T4-Winback' AND converted = 1""",
       track_ctes("courier_import", 90))
oracle("track_distribution", """
SELECT track, count(*) AS leads,
       count(*) FILTER (WHERE previous_track IS NULL OR previous_track <> track) AS changed
FROM tracked GROUP BY track""", track_ctes("full_sync", None))
oracle("track_report", """
SELECT count(*) AS processed,
       count(*) FILTER (WHERE previous_track IS NULL OR previous_track <> track) AS updated,
       (SELECT count(*) FROM buyers) AS buyers_total
FROM tracked""", track_ctes("full_sync", None))

# --- lead import -----------------------------------------------------------------

LEAD_ROWS = f"""l_rows AS (
SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY row_no DESC) AS from_last,
       first_value(created) OVER (PARTITION BY contact_id ORDER BY row_no) AS first_created,
       count(*) OVER (PARTITION BY contact_id) AS copies
FROM (SELECT * REPLACE (nullif(trim(contact_id), '') AS contact_id),
             CASE WHEN created_at LIKE '%+07:00'
                  THEN TRY_CAST(replace(created_at, '+07:00', '') AS TIMESTAMP)
                       - INTERVAL '7' HOUR
                  ELSE TRY_CAST(created_at AS TIMESTAMP) END AS created
      FROM m_lead_export) AS x
WHERE contact_id IS NOT NULL)"""


def lead_text(column: str, limit: int | None = None) -> str:
    bare = f'trim("{column}")'
    kept = f"CASE WHEN {bare} NOT IN ('', 'nan', 'NaN', 'None') THEN {bare} END"
    return f"nullif(substring({kept}, 1, {limit}), '')" if limit else kept


STORED_PHONES = """stored AS (
SELECT phone_raw, min(customer_id) AS customer_id, arg_min(name, customer_id) AS name
FROM m_customers WHERE phone_raw IS NOT NULL GROUP BY phone_raw)"""

INCOMING = f"""incoming AS (
SELECT contact_id, {lead_text('display_name')} AS name, {whole_text('phone_number')} AS phone,
       {lead_text('pipeline_status_name')} AS pipeline_status,
       {lead_text('stage_status')} AS stage_status, {lead_text('label_names', 50)} AS label_names,
       {lead_text('handled_by_name')} AS handled_by_name, {lead_text('inboxes_name')} AS inbox,
       {lead_text('note')} AS note, {lead_text('first_message', 500)} AS first_message,
       {lead_text('additional_kota')} AS kota,
       {lead_text('additional_data rumah walet', 20)} AS rumah_walet,
       {lead_text('additional_usia rumah walet', 20)} AS usia_rbw,
       {lead_text('additional_ukuran rumah walet', 20)} AS ukuran_rbw,
       {lead_text('additional_jumlah sarang (keping)')} AS jumlah_sarang,
       {lead_text('additional_lantai rumah walet', 20)} AS lantai_rbw,
       {lead_text('additional_panen per 3 bulan')} AS panen_per_3bulan,
       first_created AS created_at, TRY_CAST(last_message_at AS TIMESTAMP) AS last_message_at,
       copies
FROM l_rows WHERE from_last = 1),
linked AS (
SELECT i.*, CASE WHEN s.customer_id <> i.phone THEN s.customer_id END AS customer_id
FROM incoming AS i LEFT JOIN stored AS s ON i.phone = s.phone_raw)"""

SAME_IN_FILE = [
    "name", "phone", "pipeline_status", "stage_status", "label_names", "handled_by_name",
    "inbox", "note", "first_message", "kota", "rumah_walet", "usia_rbw", "ukuran_rbw",
    "jumlah_sarang", "lantai_rbw", "panen_per_3bulan", "customer_id", "last_message_at",
]
STORED_FIELDS = [
    "name", "phone", "pipeline_status", "label_names", "kota", "note", "customer_id",
    "last_message_at",
]
AFTER_UPSERT = f"""after_upsert AS (
SELECT n.contact_id, {', '.join(f'n.{c}' for c in SAME_IN_FILE)},
       CAST(CASE WHEN n.customer_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS converted,
       CASE WHEN l.contact_id IS NULL THEN n.created_at ELSE l.created_at END AS created_at,
       CASE WHEN l.contact_id IS NOT NULL OR copies > 1 THEN {IMPORT_NOW} END AS updated_at,
       l.track
FROM linked AS n LEFT JOIN m_leads AS l ON n.contact_id = l.contact_id
UNION ALL BY NAME
SELECT contact_id, {', '.join(STORED_FIELDS)}, converted, created_at, updated_at, track
FROM m_leads WHERE contact_id NOT IN (SELECT contact_id FROM linked))"""

UPSERT = [LEAD_ROWS, STORED_PHONES, INCOMING, AFTER_UPSERT]
oracle("upsert_leads", "SELECT * FROM after_upsert", UPSERT)
oracle("lead_import_tracks", """
SELECT contact_id, converted, previous_track, track FROM tracked""", [
    *UPSERT, buyers("m_orders", "m_customers", IMPORT_NOW, 90),
    tracked("after_upsert", "lead_import", IMPORT_NOW),
])
oracle("lead_import_report", """
SELECT inserted, total - inserted AS updated, total
FROM (SELECT count(DISTINCT contact_id)
               FILTER (WHERE contact_id NOT IN (SELECT contact_id FROM m_leads)) AS inserted,
             count(*) AS total
      FROM l_rows) AS r""", [LEAD_ROWS])


def last_patch(field: str, kinds: str, value: str) -> str:
    return f"""last_{field} AS (
SELECT contact_id, {value} AS value FROM m_patch_events WHERE kind IN ({kinds})
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY patch_no DESC) = 1)"""


oracle("lead_patches_applied", f"""
SELECT l.* REPLACE (
         CASE WHEN n.contact_id IS NULL THEN l.note ELSE n.value END AS note,
         CASE WHEN k.contact_id IS NULL THEN l.kota ELSE k.value END AS kota,
         CASE WHEN k.contact_id IS NULL THEN l.track ELSE 'T3-Fresh' END AS track,
         CASE WHEN n.contact_id IS NULL AND k.contact_id IS NULL THEN l.updated_at
              ELSE {IMPORT_NOW} END AS updated_at)
FROM m_leads AS l LEFT JOIN last_note AS n ON l.contact_id = n.contact_id
LEFT JOIN last_kota AS k ON l.contact_id = k.contact_id""", [
    last_patch("note", "0, 3", "CASE WHEN kind = 0 THEN new_text END"),
    last_patch("kota", "1", "new_text"),
])
oracle("lead_patch_report", """
SELECT count(*) FILTER (WHERE kind <> 2) AS accepted, count(*) FILTER (WHERE kind = 2) AS rejected
FROM m_patch_events""")

# --- courier import --------------------------------------------------------------

COURIER = [COURIER_ROWS, STORED_PHONES, """c_fresh AS (
SELECT * FROM (SELECT * FROM c_rows WHERE order_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY row_no) = 1) AS f
WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE source_platform = 'mengantar'))""",
"""c_unknown AS (
SELECT * FROM c_fresh
WHERE phone IS NOT NULL AND phone NOT IN (SELECT phone_raw FROM stored)
QUALIFY row_number() OVER (PARTITION BY phone ORDER BY row_no) = 1)""",
"""c_orders AS (
SELECT f.order_id, 'mengantar' AS source_platform,
       CASE WHEN s.phone_raw IS NULL THEN f.phone ELSE s.customer_id END AS customer_id,
       CASE WHEN f.phone IS NULL THEN f.name WHEN s.phone_raw IS NULL THEN u.name
            ELSE s.name END AS customer_name,
       f.order_date, f.order_status, f.payment_method, f.shipping_provider, f.net_revenue,
       f.shipping_cost, CAST(0 AS DECIMAL(18,2)) AS seller_shipping_discount, f.total_qty,
       f.phone
FROM c_fresh AS f LEFT JOIN stored AS s ON f.phone = s.phone_raw
LEFT JOIN c_unknown AS u ON f.phone = u.phone)""",
"""c_customers AS (
SELECT phone AS customer_id, phone AS phone_raw, name, city, province, 'New' AS segment,
       CAST(1 AS BIGINT) AS total_orders, net_revenue AS total_revenue,
       net_revenue AS avg_order_value, order_date AS first_order_date,
       order_date AS last_order_date, 'mengantar' AS last_platform
FROM c_unknown WHERE phone NOT IN (SELECT customer_id FROM m_customers))""",
"""all_orders AS (
SELECT order_id, customer_id, order_status, order_date, net_revenue FROM m_orders
UNION ALL SELECT order_id, customer_id, order_status, order_date, net_revenue FROM c_orders)""",
"""all_customers AS (
SELECT customer_id, phone_raw, name, city, province, segment, total_orders, total_revenue,
       avg_order_value, first_order_date, last_order_date, last_platform FROM m_customers
UNION ALL BY NAME SELECT * FROM c_customers)""",
"""c_buyers AS (
SELECT phone, min(customer_id) AS customer_id FROM c_orders
WHERE order_status = 'completed' AND phone IS NOT NULL GROUP BY phone)""",
"""c_leads AS (
SELECT l.* REPLACE (
         CASE WHEN b.phone IS NOT NULL AND converted = 0 THEN b.customer_id
              ELSE l.customer_id END AS customer_id,
         CASE WHEN b.phone IS NOT NULL THEN 1 ELSE converted END AS converted),
       b.phone IS NOT NULL AND converted = 0 AS newly
FROM m_leads AS l LEFT JOIN c_buyers AS b ON l.phone = b.phone)"""]

oracle("courier_new_orders", f"""
SELECT * EXCLUDE (phone) REPLACE (
         {double('net_revenue')} AS net_revenue, {double('shipping_cost')} AS shipping_cost,
         {double('seller_shipping_discount')} AS seller_shipping_discount)
FROM c_orders""", COURIER)
oracle("courier_new_items", """
SELECT order_id, 'mengantar' AS source_platform, unnest(range(len(names))) AS item_id,
       unnest(names) AS product_raw, CAST(1 AS BIGINT) AS qty_item
FROM goods_items""", [*COURIER, GOODS.format(source="c_fresh")])
MONEY_AS_DOUBLE = f"""{double('total_revenue')} AS total_revenue,
  {double('avg_order_value')} AS avg_order_value"""
oracle("courier_new_customers", f"""
SELECT * REPLACE ({MONEY_AS_DOUBLE}) FROM c_customers""", COURIER)
oracle("courier_customers_after", f"""
SELECT * REPLACE ({MONEY_AS_DOUBLE}, {SEGMENT} AS segment)
FROM ({refreshed('all_customers', 'all_orders')}) AS r""", COURIER)
oracle("courier_leads_after", """
SELECT contact_id, phone, customer_id, converted, track FROM tracked""", [
    *COURIER, buyers("all_orders", "all_customers", NOW, 90),
    tracked("c_leads", "courier_import", NOW),
])
oracle("courier_report", """
SELECT (SELECT count(*) FROM c_fresh) AS inserted,
       (SELECT count(*) FROM c_rows WHERE order_id IS NOT NULL)
         - (SELECT count(*) FROM c_fresh) AS skipped_duplicate,
       (SELECT count(*) FROM c_leads WHERE newly) AS leads_synced""", COURIER)


def state(orders: str) -> str:
    done = "FILTER (WHERE order_status = 'completed')"
    return f"""
SELECT customer_id, count(*) {done} AS completed_orders,
       {double(f'sum(net_revenue) {done}')} AS completed_revenue,
       max(order_date) AS last_order_date, max(order_date) {done} AS last_completed_date
FROM {orders} WHERE customer_id IS NOT NULL GROUP BY customer_id"""


oracle("customer_state", state("m_orders"))
oracle("courier_state_after", state("all_orders"), COURIER)

oracle("daily_sales", f"""
SELECT CAST(order_date AS DATE) AS day, count(*) AS orders, count(net_revenue) AS priced,
       {double('sum(net_revenue)')} AS revenue,
       {double('sum(net_revenue) FILTER (WHERE CAST(order_date AS DATE) = CAST(first_order_date AS DATE))')}
         AS revenue_new,
       {double('sum(net_revenue) FILTER (WHERE CAST(order_date AS DATE) > CAST(first_order_date AS DATE))')}
         AS revenue_repeat,
       {big('sum(total_qty)')} AS total_qty
FROM m_orders AS o LEFT JOIN m_customers AS c ON o.customer_id = c.customer_id
WHERE order_status = 'completed' GROUP BY 1""")
ORACLES["revenue_by_week_from_days"] = ORACLES["revenue_by_week"]
ORACLES["monthly_new_vs_repeat_from_days"] = ORACLES["monthly_new_vs_repeat_all"]
oracle("revenue_in_days", revenue(
    "strftime(order_date, '%Y-%m')",
    "AND order_date >= TIMESTAMP '1998-03-05' AND order_date < TIMESTAMP '1999-11-21'",
))
oracle("tracks_of_due_leads", """
SELECT contact_id, converted, track FROM tracked""", track_ctes("full_sync", None))
oracle("search_customers_by_trigrams", """
SELECT customer_id, name, province FROM m_customers
WHERE name ILIKE '%mer#0000001%7%' AND province ILIKE '%asi%'""")
