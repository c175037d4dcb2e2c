"""The driver's tables reshaped to the data model and to raw export files.

Each table is one SELECT over whole driver tables, written in the SQL that Spark and
DuckDB share; `Dialect` covers the few functions that differ. Spark runs it to feed the
queries, DuckDB as a common table expression of the oracle. See FIXTURES.md.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02 00:00:00"
LEAD_IMPORT_AS_OF = "2024-01-31 00:00:00"
DRIVER_TABLES = ["region", "nation", "customer", "part", "orders", "lineitem", "events"]


@dataclass(frozen=True)
class Dialect:
    timestamp: str
    day_month: str
    iso: str
    micro: str
    thousands: str
    days_between: str
    quote: str

    def name(self, heading: str) -> str:
        return f"{self.quote}{heading}{self.quote}"


SPARK = Dialect(
    timestamp="TIMESTAMP_NTZ",
    day_month="date_format(%s, 'dd-MM-yyyy HH:mm')",
    iso="date_format(%s, 'yyyy-MM-dd HH:mm:ss')",
    micro="date_format(%s, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
    thousands="format_number(%s, 0)",
    days_between="datediff(%s, %s)",
    quote="`",
)
DUCKDB = Dialect(
    timestamp="TIMESTAMP",
    day_month="strftime(%s, '%%d-%%m-%%Y %%H:%%M')",
    iso="strftime(%s, '%%Y-%%m-%%d %%H:%%M:%%S')",
    micro="strftime(%s, '%%Y-%%m-%%d %%H:%%M:%%S.%%f')",
    thousands="format('{{:,}}', %s)",
    days_between="(CAST(%s AS DATE) - CAST(%s AS DATE))",
    quote='"',
)


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def nine(key: str) -> str:
    return f"lpad({text(key)}, 9, '0')"


def phone(key: str) -> str:
    return f"concat('628', {nine(key)})"


def customer_id(key: str) -> str:
    return f"CASE WHEN {key} % 3 <> 0 THEN {phone(key)} ELSE concat('C', {text(key)}) END"


def platform(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 1 THEN 'mengantar' ELSE 'orderonline' END"


def money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


# Grouped, so that Spark sees a key and drops the join where no column of it is used.
PLACES = """
  SELECT n_nationkey, max(n_name) AS n_name, max(r_name) AS r_name
  FROM {nation} AS n LEFT JOIN {region} AS r ON n.n_regionkey = r.r_regionkey
  GROUP BY n_nationkey"""


def customers(d: Dialect) -> str:
    as_of = f"{d.timestamp} '{AS_OF}'"
    half = "CAST(floor(c_custkey / 2) AS BIGINT)"
    # Rounded half up in whole numbers: the engines' round() of a double differs at ties.
    mean_cents = (
        "CAST(floor(CAST(200 * revenue + n_completed AS DOUBLE) / (2 * n_completed)) AS BIGINT)"
    )
    return f"""
SELECT {customer_id('c_custkey')} AS customer_id, {phone('c_custkey')} AS phone_raw,
       c_name AS name, n_name AS city,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE r_name END AS province,
       first_order_date, last_order_date,
       CAST({d.days_between % (as_of, 'last_order_date')} AS BIGINT) AS recency_days,
       coalesce(n_completed, 0) AS total_orders,
       {money('coalesce(revenue, 0)')} AS total_revenue,
       CASE WHEN n_completed > 0 THEN {money(f'{mean_cents} * 0.01')} END AS avg_order_value,
       {platform('c_custkey')} AS first_platform, {platform(half)} AS last_platform,
       CASE WHEN n_completed >= 4 THEN 'Loyal' WHEN n_completed >= 2 THEN 'Returning'
            WHEN n_completed = 1
             AND {d.days_between % (as_of, 'last_order_date')} <= 90 THEN 'New'
            ELSE 'Churn' END AS segment
FROM {{customer}} AS c
LEFT JOIN ({PLACES}) AS n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (
  SELECT o_custkey, min(o_orderdate) AS first_order_date, max(o_orderdate) AS last_order_date,
         count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_completed,
         sum(CASE WHEN o_orderstatus = 'F' THEN {money('o_totalprice')} END) AS revenue
  FROM {{orders}} GROUP BY o_custkey
) AS s ON c.c_custkey = s.o_custkey"""


def orders(d: Dialect) -> str:
    return f"""
SELECT {text('o_orderkey')} AS order_id, {platform('o_orderkey')} AS source_platform,
       {customer_id('o_custkey')} AS customer_id,
       concat('Customer#', {nine('o_custkey')}) AS customer_name,
       CASE WHEN o_orderstatus = 'F' THEN 'completed'
            ELSE CASE WHEN o_orderstatus = 'O' THEN 'processing_unpaid' ELSE 'rts' END END
         AS order_status,
       o_orderdate AS order_date,
       CASE WHEN o_orderkey % 3 = 0 THEN 'COD' ELSE 'Bank Transfer' END AS payment_method,
       {money('o_totalprice')} AS net_revenue,
       {money('(o_orderkey % 50) * 1000')} AS shipping_cost,
       CASE WHEN o_orderkey % 9 <> 0
            THEN {money('(o_orderkey % 20) * 500')} END AS seller_shipping_discount,
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'J&T' WHEN '2' THEN 'Lion Parcel'
            WHEN '3' THEN 'SAP' WHEN '4' THEN 'ID Express' ELSE 'JNE' END AS shipping_provider,
       CAST(NULL AS STRING) AS shipping_type, CAST(NULL AS STRING) AS receipt_number,
       CAST(o_orderkey % 7 + 1 AS INT) AS total_qty
FROM {{orders}}"""


def items(d: Dialect) -> str:
    line_id = "l_linenumber * 100000000000000000 + l_partkey * 100000000 + l_suppkey"
    return f"""
SELECT CAST({line_id} AS BIGINT) AS item_id,
       {text('l_orderkey')} AS order_id, {platform('l_orderkey')} AS source_platform,
       CASE WHEN l_partkey % 51 = 0 THEN NULL WHEN l_partkey % 50 = 0 THEN 'UNKNOWN'
            WHEN l_partkey % 40 = 7 THEN concat('X', {text('l_partkey')})
            ELSE concat('P', {text('l_partkey')}) END AS product_id,
       CASE WHEN l_partkey % 23 <> 0 THEN concat('item ', {text('l_partkey')}) END
         AS product_name,
       concat('raw ', {text('l_partkey')}) AS product_raw,
       concat('cat ', {text('(l_partkey + l_suppkey) % 8')}) AS product_category,
       CAST(l_quantity AS BIGINT) AS qty_item,
       CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT) AS is_parent_row
FROM {{lineitem}}"""


def products(d: Dialect) -> str:
    return f"""
SELECT concat('P', {text('p_partkey')}) AS product_id, p_type AS product_category,
       p_brand AS product_subcategory,
       CASE WHEN p_partkey % 19 <> 0 THEN p_name END AS product_name,
       {money('p_retailprice')} AS product_price
FROM {{part}}"""


def leads(d: Dialect) -> str:
    k = "c_custkey"
    as_of = f"{d.timestamp} '{AS_OF}'"
    return f"""
SELECT concat('L', {text(k)}) AS contact_id, c_name AS name,
       CASE {k} % 4 WHEN 3 THEN NULL WHEN 2 THEN concat('629', {nine(k)})
            ELSE {phone(k)} END AS phone,
       CASE {k} % 13 WHEN 0 THEN ' Blacklist ' WHEN 1 THEN NULL ELSE 'Prospect' END
         AS pipeline_status,
       concat('label ', {text(f'{k} % 6')}) AS label_names,
       n_name AS kota, concat('note ', {text(k)}) AS note,
       CASE WHEN {k} % 17 = 0 THEN {customer_id(k)} END AS customer_id,
       CAST(CASE WHEN {k} % 17 = 0 THEN 1 ELSE 0 END AS INT) AS converted,
       {as_of} - (({k} * 7) % 500) * INTERVAL '1' DAY AS created_at,
       CASE WHEN {k} % 5 <> 0
            THEN {as_of} - (({k} * 3) % 400) * INTERVAL '1' DAY END AS last_message_at,
       CAST(NULL AS {d.timestamp}) AS updated_at,
       CASE WHEN {k} % 2 <> 0 THEN 'T2-Nurturing' END AS track
FROM {{customer}} AS c LEFT JOIN ({PLACES}) AS n ON c.c_nationkey = n.n_nationkey"""


def courier_export(d: Dialect) -> str:
    o, c, q = "o_orderkey", "o_custkey", d.name
    return f"""
SELECT {o} AS row_no,
       CASE WHEN {o} % 97 = 0 THEN '  ' WHEN {o} % 10 = 1 THEN {text(o)}
            ELSE concat('''M', {text(f'{o} - {o} % 2')}) END AS {q('Order ID')},
       CASE WHEN {o} % 41 = 0 THEN '' WHEN {o} % 43 = 0 THEN 'nan'
            WHEN {c} % 5 = 0 THEN concat('''07', {nine(c)})
            WHEN {c} % 3 = 0 THEN concat('''08', {nine(c)})
            WHEN {c} % 3 = 1
            THEN concat('8', substring({nine(c)}, 1, 4), '-', substring({nine(c)}, 5, 5))
            ELSE concat(' 628', {nine(c)}) END AS {q('Customer Phone Number')},
       CASE WHEN {o} % 37 = 0 THEN 'nan'
            ELSE concat(' Buyer ', {text(c)}, '-', {text(f'{o} % 3')}, ' ') END
         AS {q('Customer Name')},
       concat('Province ', {text(f'{c} % 7')}) AS {q('Province')},
       CASE WHEN {o} % 11 = 0 THEN '' ELSE concat('''City ', {text(f'{c} % 13')}) END
         AS {q('City')},
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'JT' WHEN '2' THEN 'lion'
            WHEN '3' THEN ' Sap ' WHEN '4' THEN 'iDexpress' ELSE 'Other' END
         AS {q('Expedition')},
       CASE {o} % 7 WHEN 0 THEN 'Delivered' WHEN 1 THEN 'UNDELIVERED' WHEN 2 THEN 'RTS'
            WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'Canceled' WHEN 5 THEN 'Pickup' ELSE '' END
         AS {q('Last Status')},
       CASE WHEN {o} % 31 = 0 THEN 'bad' ELSE {d.day_month % 'o_orderdate'} END
         AS {q('Create Date')},
       CASE {o} % 4 WHEN 0 THEN 'a, b,,c' WHEN 1 THEN ',' WHEN 2 THEN ''
            ELSE concat('''Nest ', {text(f'{o} % 9')}, ' , Extra') END
         AS {q('Goods Description')},
       CASE {o} % 19 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '2.7' WHEN 3 THEN 'x'
            WHEN 4 THEN '0.5' ELSE {text(f'{o} % 5 + 1')} END AS {q('Quantity')},
       CASE WHEN {o} % 23 = 0 THEN ''
            ELSE concat({text('CAST(floor(o_totalprice) AS BIGINT)')},
                        CASE WHEN {o} % 5 = 0 THEN '.9' ELSE '' END) END AS {q('Product Value')},
       CASE WHEN {o} % 29 = 0 THEN 'free' ELSE {text(f'({o} % 50) * 1000')} END
         AS {q('Shipping Fee')},
       CASE {o} % 3 WHEN 0 THEN '150000' WHEN 1 THEN '0' ELSE 'x' END AS {q('COD')}
FROM {{orders}}"""


def lead_export(d: Dialect) -> str:
    e, u, q = "event_id", "user_id", d.name
    return f"""
SELECT {e} AS row_no,
       CASE WHEN {e} % 53 = 0 THEN ' ' WHEN {u} < 100 THEN concat('L', {text(u)})
            ELSE concat('N', {text(u)}) END AS contact_id,
       CASE WHEN {u} % 7 = 0 THEN 'n/a' WHEN {u} % 2 = 0 THEN concat({phone(u)}, '.0')
            ELSE {phone(u)} END AS phone_number,
       concat(' Lead ', {text(u)}, ' ') AS display_name,
       event_type AS pipeline_status_name,
       CASE WHEN {e} % 2 = 0 THEN 'NaN' ELSE 'open' END AS stage_status,
       repeat(concat(event_type, ', '), 12) AS label_names,
       concat('agent ', {text(f'{e} % 4')}) AS handled_by_name,
       'inbox' AS inboxes_name,
       CASE WHEN {e} % 3 = 0 THEN 'None' ELSE concat('note ', {text(e)}) END AS note,
       repeat(concat('message ', {text(e)}, ' '), 60) AS first_message,
       concat('kota ', {text(f'{u} % 9')}) AS additional_kota,
       CASE WHEN {e} % 5 = 0 THEN '' ELSE 'a house with three storeys' END
         AS {q('additional_data rumah walet')},
       concat(' ', {text(f'{u} % 12')}, ' years ') AS {q('additional_usia rumah walet')},
       '4x12 metres on each storey' AS {q('additional_ukuran rumah walet')},
       {text(f'{e} % 40')} AS {q('additional_jumlah sarang (keping)')},
       {text(f'{u} % 4')} AS {q('additional_lantai rumah walet')},
       {text(f'{e} % 30')} AS {q('additional_panen per 3 bulan')},
       CASE WHEN {e} % 59 = 0 THEN 'bad' WHEN {e} % 3 = 0 THEN concat({d.iso % 'ts'}, '+07:00')
            WHEN {e} % 3 = 1 THEN {d.micro % 'ts'} ELSE {d.iso % 'ts'} END AS created_at,
       CASE WHEN {e} % 61 = 0 THEN '' ELSE {d.micro % 'ts'} END AS last_message_at
FROM {{events}}"""


def patch_events(d: Dialect) -> str:
    """Lead edits; `kind` 0 sets note, 1 sets kota and track, 2 only a field that may
    not be edited, 3 clears note."""
    return f"""
SELECT concat('L', {text('user_id')}) AS contact_id, event_id AS patch_no,
       event_id % 4 AS kind, concat('edit ', {text('event_id')}) AS new_text
FROM {{events}}"""


def raw_products(d: Dialect) -> str:
    price = d.thousands % "CAST(floor(p_retailprice) AS BIGINT)"
    return f"""
SELECT CASE WHEN p_partkey % 71 = 0 THEN NULL ELSE concat('P', {text('p_partkey')}) END
         AS product_id,
       p_type AS product_category, p_brand AS product_subcategory, p_name AS product_name,
       CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 17 = 1 THEN 'Rp n/a'
            ELSE concat('Rp', {price}) END AS product_price,
       concat(' ', {price}, ' ') AS product_cost,
       CASE WHEN p_partkey % 13 = 0 THEN 'heavy' ELSE {text('p_size')} END AS product_weight,
       'x' AS not_in_schema
FROM {{part}}"""


def raw_customers(d: Dialect) -> str:
    k = "c_custkey"
    return f"""
SELECT {customer_id(k)} AS customer_id, c_name AS name, {phone(k)} AS phone_raw,
       CASE WHEN {k} % 6 = 0 THEN 'never' ELSE '2001-02-03 04:05:06' END AS first_order_date,
       CASE {k} % 3 WHEN 0 THEN '2001-07-08' WHEN 1 THEN '2001-07-08T09:10:11' END
         AS last_order_date,
       CASE WHEN {k} % 8 = 0 THEN '-' ELSE concat({text(f'{k} % 400')}, '.0') END
         AS recency_days,
       concat({text(f'{k} % 13')}, '.25') AS recency_months,
       {text(f'{k} % 10')} AS total_orders,
       CASE WHEN {k} % 9 = 0 THEN '' ELSE {text(money('c_acctbal'))} END AS total_revenue,
       CASE {k} % 7 WHEN 0 THEN 'New' WHEN 1 THEN 'Returning' WHEN 2 THEN 'Loyal'
            WHEN 3 THEN 'Churn' WHEN 4 THEN 'loyal' WHEN 5 THEN NULL ELSE 'VIP' END AS segment
FROM {{customer}}"""


def raw_orders(d: Dialect) -> str:
    o = "o_orderkey"
    return f"""
SELECT {text(o)} AS order_id, {platform(o)} AS source_platform,
       CASE WHEN {o} % 25 = 0 THEN 'soon' ELSE {d.iso % 'o_orderdate'} END AS order_date,
       CASE o_orderstatus WHEN 'F' THEN {d.iso % 'o_orderdate'} ELSE '' END AS completed_date,
       CASE {o} % 30 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN ''
            ELSE concat({text('o_custkey')}, '.0') END AS customer_id,
       CASE WHEN {o} % 21 = 0 THEN 'n/a' ELSE {text(money('o_totalprice'))} END AS net_revenue,
       {text(money('o_totalprice'))} AS gross_revenue,
       {text(f'({o} % 50) * 1000')} AS shipping_cost,
       CASE {o} % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'False' WHEN 3 THEN 'true'
            END AS is_hpp
FROM {{orders}}"""


def raw_items(d: Dialect) -> str:
    return f"""
SELECT order_id, source_platform, product_raw, product_id, product_name, product_category,
       CASE WHEN item_id % 12 = 0 THEN 'two' ELSE {text('qty_item')} END AS qty_item,
       CASE is_parent_row WHEN 1 THEN 'True' ELSE 'False' END AS is_parent_row
FROM ({items(d)}) AS i"""


def messy_phones(d: Dialect) -> str:
    k = "c_custkey"
    return f"""
SELECT {k} AS row_id,
       CASE {k} % 10 WHEN 0 THEN concat('08', {nine(k)}) WHEN 1 THEN concat('8', {nine(k)})
            WHEN 2 THEN concat('+62 8', {nine(k)}) WHEN 3 THEN {phone(k)}
            WHEN 4 THEN '0812' WHEN 5 THEN '' WHEN 6 THEN NULL
            WHEN 7 THEN concat('''08', substring({nine(k)}, 1, 3), '-', substring({nine(k)}, 4, 6))
            WHEN 8 THEN concat({phone(k)}, '9999.0') ELSE concat('44', {nine(k)}) END AS phone
FROM {{customer}}"""


TABLES = {
    "customers": customers,
    "orders": orders,
    "items": items,
    "products": products,
    "leads": leads,
    "courier_export": courier_export,
    "lead_export": lead_export,
    "patch_events": patch_events,
    "raw_products": raw_products,
    "raw_customers": raw_customers,
    "raw_orders": raw_orders,
    "raw_items": raw_items,
    "messy_phones": messy_phones,
}


class Model:
    """The tables as Spark DataFrames: Model(spark, sf_dir).orders"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir
        self._driver_tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        """Called once per table; the result is then a plain attribute."""
        if name not in TABLES:
            raise AttributeError(name)
        sql = TABLES[name](SPARK)
        used = [t for t in DRIVER_TABLES if f"{{{t}}}" in sql]
        df = self._spark.sql(sql, **{t: self._read(t) for t in used})
        setattr(self, name, df)
        return df

    def _read(self, table: str) -> DataFrame:
        if table not in self._driver_tables:
            path = f"{self._dir}/{table}.parquet"
            self._driver_tables[table] = self._spark.read.parquet(path)
        return self._driver_tables[table]


def duckdb_ctes(names: list[str]) -> str:
    """WITH clause that defines the tables for DuckDB, each under the name m_<table>."""
    views = {t: t for t in DRIVER_TABLES}
    ctes = [f"m_{n} AS ({TABLES[n](DUCKDB).format(**views)})" for n in names]
    return "WITH " + ",\n".join(ctes)
