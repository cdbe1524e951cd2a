"""The same results in SQL over the same tables, written independently.

Sums are compared at four decimals; reported two-decimal values round the
binary value, which ``printf`` does.
"""

from tallyline.plans.reports import FIELDS

TX = """
tx AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date, l_shipdate AS ship_date,
         o_orderpriority AS order_priority, c_name AS customer_name, c_mktsegment AS segment,
         n_name AS country, r_name AS market, p_type AS category, p_brand AS sub_category,
         p_name AS product_name, l_extendedprice AS sales,
         l_extendedprice * (CAST(0.05 AS DOUBLE) - l_discount) AS profit,
         l_extendedprice * l_tax AS shipping_cost, -(l_extendedprice * l_discount) AS loss,
         CAST(l_quantity AS INTEGER) AS quantity, l_discount AS discount_rate,
         l_extendedprice * l_discount AS discount_amount,
         round(l_discount + 2 * l_tax, 2) AS wide_rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""


def r4(x):
    return f"(round({x}, 4) + 0.0)"


def two(x):
    """Two decimals of the binary value, as reported."""
    return f"(CAST(printf('%.2f', round({x}, 6)) AS DOUBLE) + 0.0)"


def shortest(x):
    """Two decimals at most, one at least: 5.0, 5.1, 5.12."""
    return f"regexp_replace(printf('%.2f', round({x}, 9)), '0$', '')"


def usd(x):
    return f"'$' || format('{{:,}}', CAST(round({x}) AS BIGINT)) || ' USD'"


def with_tx(body, more=""):
    return f"WITH {TX}{', ' + more if more else ''} {body}"


YEARS = "years AS (SELECT max(year(order_date)) AS y FROM tx)"

TWO_YEARS = f"""{YEARS}, f AS (
  SELECT y,
    sum(sales) FILTER (year(order_date) = y) AS s1, sum(sales) FILTER (year(order_date) = y - 1) AS s0,
    sum(profit) FILTER (year(order_date) = y) AS p1,
    count(DISTINCT order_id) FILTER (year(order_date) = y) AS n1,
    count(DISTINCT order_id) FILTER (year(order_date) = y - 1) AS n0
  FROM tx, years GROUP BY y),
o AS (SELECT avg(s) AS a FROM (
  SELECT sum(sales) AS s FROM tx, years WHERE year(order_date) = y GROUP BY order_id))"""


def trend(now, before):
    change = f"(({now}) - ({before})) * 100.0 / ({before})"
    return f"CASE WHEN {change} >= 0 THEN '+' ELSE '' END || {shortest(change)} || '%'"


CUSTOMERS = """c AS (SELECT customer_name AS name, sum(sales) AS s, sum(profit) AS p,
  count(DISTINCT order_id) AS orders FROM tx GROUP BY customer_name)"""

COUNTRIES = """g AS (SELECT country, sum(sales) AS s, sum(profit) AS p, sum(shipping_cost) AS h,
  count(order_id) AS n FROM tx GROUP BY country)"""

PRODUCTS = """p AS (SELECT product_name, sum(sales) AS s, sum(profit) AS pr, abs(sum(loss)) AS d
  FROM tx GROUP BY product_name)"""


def ranking(column, direction):
    return with_tx(
        f"SELECT name, {two('s')} AS sales, {two('p')} AS profit, orders FROM c "
        f"ORDER BY {column} {direction}, name LIMIT 20",
        CUSTOMERS,
    )


def in_both(direction):
    return (
        f"SELECT name FROM (SELECT name FROM c ORDER BY p {direction}, name LIMIT 200) "
        f"INTERSECT SELECT name FROM (SELECT name FROM c ORDER BY s {direction}, name LIMIT 200)"
    )


# Edges and labels of the discount bands.
BAND_ROWS = """b(band_ord, lo, hi, band) AS (VALUES
  (0, CAST(-0.001 AS DOUBLE), CAST(0 AS DOUBLE), '0%'), (1, 0, 0.05, '1-5%'), (2, 0.05, 0.10, '6-10%'),
  (3, 0.10, 0.15, '11-15%'), (4, 0.15, 0.20, '16-20%'), (5, 0.20, 2.0, 'Más de 20%'))"""


def bands(measure, rate):
    return with_tx(
        f"SELECT CAST(band_ord AS BIGINT) AS band_ord, band, {two('coalesce(m, 0)')} AS {measure} FROM t",
        f"""{BAND_ROWS}, t AS (SELECT band_ord, band, sum({measure}) AS m
            FROM b LEFT JOIN tx ON {rate} > lo AND {rate} <= hi GROUP BY band_ord, band)""",
    )


def leak(measure):
    total = f"coalesce(sum(m) FILTER (m < 0), 0)"
    return with_tx(
        f"SELECT {r4(total)} AS total, {usd(total)} AS total_formatted FROM t",
        f"""{BAND_ROWS}, t AS (SELECT band, sum({measure}) AS m
            FROM b LEFT JOIN tx ON wide_rate > lo AND wide_rate <= hi GROUP BY band)""",
    )


ROWS = "order_id, CAST(order_date AS VARCHAR) AS order_date, customer_name, country, product_name, sales"
ROW_ORDER = "order_id, customer_name, country, product_name, sales"
FOUND = "product_name ILIKE '%gizmo%' AND regexp_matches(country, 'NATION_7$')"

# Month labels.
MONTHS = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"


def iso(ts):
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def sized(x, n):
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


def cleaned_name():
    x = "c_name || ' S.A. de C.V. ' || lower(c_mktsegment) || ' INDUSTRIAL y familia'"
    x = f"replace({x}, ' S.A. de C.V.', '')"
    x = f"replace({x}, ' y familia', '')"
    return f"replace({x}, ' INDUSTRIAL', '')"


# Postal prefixes and their states.
STATES = """st(prefix, state) AS (VALUES ('01','CDMX'),('02','CDMX'),('03','CDMX'),('04','CDMX'),('05','CDMX'),
  ('06','CDMX'),('20','Aguascalientes'),('21','Baja California'),('23','Baja California Sur'),('24','Campeche'),
  ('29','Chiapas'),('31','Chihuahua'),('34','Durango'),('37','Guanajuato'),('39','Guerrero'),('42','Hidalgo'),
  ('44','Jalisco'),('50','Estado de México'),('58','Michoacán'),('62','Morelos'),('63','Nayarit'),
  ('64','Nuevo León'),('68','Oaxaca'),('72','Puebla'),('76','Querétaro'),('77','Quintana Roo'),
  ('78','San Luis Potosí'),('80','Sinaloa'),('83','Sonora'),('86','Tabasco'),('87','Tamaulipas'),
  ('91','Veracruz'),('97','Yucatán'),('98','Zacatecas'))"""

MEMBER = "concat_ws('-', l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
UUID = f"concat_ws('-', l_orderkey, l_linenumber, {MEMBER})"
KEY = "lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0')"
CATEGORY = (
    f"CASE WHEN {KEY} IN ('43','81') THEN 'Technology' WHEN {KEY} = '56' THEN 'Furniture' ELSE 'Office Supplies' END"
)


def margin(category, amount):
    rate = f"CASE {category} WHEN 'Technology' THEN CAST(0.25 AS DOUBLE) WHEN 'Furniture' THEN 0.10 ELSE 0.30 END"
    return f"(CAST(printf('%.2f', {amount} * ({rate})) AS DOUBLE) + 0.0)"


def line_rate(amount, discount):
    rate = f"CAST(printf('%.4f', {discount} / ({amount} + {discount})) AS DOUBLE)"
    return f"CASE WHEN {amount} + {discount} > 0 THEN {rate} ELSE 0.0 END"


def invoices(last_line=False, canonical=False):
    """Two lines per document: the first with discount, the second Furniture."""
    discount = "CAST(printf('%.4f', l_extendedprice * l_discount) AS DOUBLE)"
    amount = "l_extendedprice"
    zero = "CAST(0 AS DOUBLE)"
    first = {
        "sub_category": "'Unidad'", "product_name": "p_name", "quantity": "CAST(l_quantity AS BIGINT)",
        "discount_amount": discount, "category": CATEGORY, "rate": line_rate(amount, discount),
    }
    second = {
        "sub_category": "p_brand", "product_name": "'Producto sin descripción'", "quantity": "CAST(1 AS BIGINT)",
        "discount_amount": zero, "category": "'Furniture'", "rate": zero,
    }
    selects = []
    for line in (first, second):
        rated = second if last_line else line
        rate = rated["rate"]
        if canonical:
            rate = f"CASE WHEN {amount} > 0 THEN {line['discount_amount']} / {amount} ELSE 0 END"
        selects.append(f"""
          SELECT {UUID} AS order_id,
            CAST(l_shipdate AS VARCHAR) AS order_date, CAST(l_shipdate + INTERVAL 1 DAY AS VARCHAR) AS ship_date,
            CASE WHEN l_returnflag = 'R' THEN 'Estándar' ELSE 'Express' END AS ship_mode,
            'Peña & Co' AS customer_name, CAST(NULL AS VARCHAR) AS segment,
            coalesce(state, 'Otros Estados') AS country, CAST(NULL AS VARCHAR) AS market,
            {rated['category']} AS category, {line['sub_category']} AS sub_category,
            {line['product_name']} AS product_name, {amount} AS sales, {line['quantity']} AS quantity,
            {r4(line['discount_amount'])} AS discount_amount, {margin(rated['category'], amount)} AS profit,
            {zero} AS shipping_cost, 'Media' AS order_priority,
            {zero} AS {'loss' if canonical else 'perdida'}, {r4(rate)} AS discount_rate,
            CASE WHEN l_returnflag = 'R' THEN 'PPD' ELSE 'PUE' END
              AS {'payment_method' if canonical else 'metodo_pago'}
            {", 'xml' AS source" if canonical else ''}
          FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN st ON prefix = {KEY}""")
    return f"WITH {STATES} " + " UNION ALL ".join(selects)


XML = f"""
  '<?xml version="1.0" encoding="UTF-8"?><cfdi:Comprobante xmlns:cfdi="http://www.sat.gob.mx/cfd/4" Fecha="'
  || {iso('l_shipdate')} || '" LugarExpedicion="' || {KEY} || '500"'
  || CASE l_returnflag WHEN 'N' THEN '' WHEN 'A' THEN ' MetodoPago="PUE"' ELSE ' MetodoPago="PPD"' END
  || '><cfdi:Receptor Nombre="Peña &amp; Co"/><cfdi:Conceptos><cfdi:Concepto ClaveProdServ="' || {KEY} || '0101"'
  || ' Cantidad="' || CAST(l_quantity AS VARCHAR) || '" Descripcion="' || p_name
  || '" Importe="' || printf('%.2f', l_extendedprice)
  || '" Descuento="' || printf('%.4f', l_extendedprice * l_discount) || '"/>'
  || '<cfdi:Concepto ClaveProdServ="56101500" ClaveUnidad="' || p_brand
  || '" Importe="' || printf('%.2f', l_extendedprice) || '"/></cfdi:Conceptos><cfdi:Complemento>'
  || '<t:TimbreFiscalDigital xmlns:t="urn:t" UUID="'
  || {UUID}
  || '"/></cfdi:Complemento></cfdi:Comprobante>'"""

JSON = f"""
  '{{"Fecha": "' || {iso('l_shipdate')} || '", "LugarExpedicion": "' || {KEY} || '500"'
  || CASE l_returnflag WHEN 'N' THEN '' WHEN 'A' THEN ', "MetodoPago": "PUE"' ELSE ', "MetodoPago": "PPD"' END
  || ', "Receptor": {{"Nombre": "Pe\\u00f1a & Co"}}, "Conceptos": {{"Concepto": [{{"ClaveProdServ": "' || {KEY}
  || '0101", "Cantidad": "' || CAST(l_quantity AS VARCHAR) || '", "Descripcion": "' || p_name
  || '", "Importe": "' || printf('%.2f', l_extendedprice)
  || '", "Descuento": "' || printf('%.4f', l_extendedprice * l_discount)
  || '"}}, {{"ClaveProdServ": "56101500", "ClaveUnidad": "' || p_brand
  || '", "Importe": "' || printf('%.2f', l_extendedprice) || '"}}]}}, "Complemento": {{"TimbreFiscalDigital": '
  || '{{"UUID": "' || {UUID} || '"}}}}}}'"""

# Lines as documents of their order, numbered in intake order.
DOCUMENTS = """d AS (SELECT CAST(l_shipdate AS VARCHAR) AS archive, CAST(l_linenumber AS BIGINT) AS member_no,
    concat_ws('-', l_partkey, l_suppkey, l_extendedprice) AS member, CAST(l_orderkey AS VARCHAR) AS order_id,
    o_orderstatus = 'F' AS stored
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY archive, member_no, member) AS turn FROM d)"""

NOTES = """notes AS (SELECT o_orderpriority AS page_name, 'order ' || o_orderkey AS content,
    'customer ' || o_custkey AS updated_by_name, o_orderdate AS updated_at FROM orders),
newest AS (SELECT * FROM notes QUALIFY row_number() OVER (
    PARTITION BY page_name ORDER BY updated_at DESC, content DESC, updated_by_name DESC) = 1)"""

ORACLES = {
    "kpis": with_tx(
        f"""SELECT {two('s1')} AS gross_revenue, {two('a')} AS avg_order,
            {shortest('p1 / s1 * 100')} || '%' AS profit_margin,
            {trend('s1', 's0')} AS sales_trend, {trend('n1', 'n0')} AS order_trend,
            y AS current_year FROM f, o""",
        TWO_YEARS,
    ),
    "monthly_seasonality": with_tx(
        f"""SELECT month(order_date) AS month, {MONTHS}[month(order_date)] AS date, {r4('sum(sales)')} AS sales,
            {r4("avg(date_diff('day', order_date, ship_date))")} AS days_to_ship
            FROM tx WHERE ship_date IS NOT NULL GROUP BY month(order_date)"""
    ),
    "category_performance": with_tx(
        f"""SELECT category, {r4('sum(sales)')} AS sales, {r4('sum(profit)')} AS profit,
            {r4('abs(sum(loss))')} AS discount_value FROM tx WHERE ship_date IS NOT NULL GROUP BY category"""
    ),
    "subcategory_ranking": with_tx(
        f"""SELECT sub_category, {r4('sum(sales)')} AS sales, {r4('sum(profit)')} AS profit
            FROM tx, years WHERE year(order_date) = y GROUP BY sub_category""",
        YEARS,
    ),
    "previous_year_rows": with_tx(
        """SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, sales
           FROM tx, years WHERE year(order_date) = y - 1""",
        YEARS,
    ),
    "product_totals": with_tx(
        f"SELECT product_name, {r4('pr')} AS profit, {r4('s')} AS sales FROM p", PRODUCTS
    ),
    "product_discounts": with_tx(
        f"SELECT product_name, {r4('s')} AS sales, {r4('pr')} AS profit, {r4('d')} AS discount_value FROM p", PRODUCTS
    ),
    "top_shipping": with_tx(
        f"""SELECT substr(product_name, 1, 20) || '...' AS name, product_name AS full_name,
            {r4('shipping_cost')} AS shipping_cost, {r4('profit')} AS profit, order_id
            FROM (SELECT * FROM tx ORDER BY shipping_cost DESC, product_name, order_id, profit LIMIT 300)"""
    ),
    "top_losses": with_tx(
        f"""SELECT substr(product_name, 1, 20) || '...' AS name, product_name AS full_name,
            {r4('pr')} AS loss_amount, {r4('s')} AS sales
            FROM (SELECT * FROM p WHERE pr < 0 ORDER BY pr, product_name LIMIT 20)""",
        PRODUCTS,
    ),
    "bottom_products": with_tx(
        f"""SELECT substr(product_name, 1, 20) || '...' AS name, product_name AS full_name, {r4('s')} AS sales
            FROM (SELECT * FROM p ORDER BY s, product_name LIMIT 20)""",
        PRODUCTS,
    ),
    "top_discounts": with_tx(
        f"""SELECT substr(product_name, 1, 25) || '...' AS name, product_name AS full_name,
            {two('d')} AS discount_value, {two('pr')} AS profit
            FROM (SELECT * FROM p ORDER BY d DESC, product_name LIMIT 25)""",
        PRODUCTS,
    ),
    "discount_band_loss": bands("loss", "wide_rate"),
    "discount_band_profit": bands("profit", "wide_rate"),
    "discount_band_profit_empty_bands": bands("profit", "discount_rate"),
    "discount_band_profit_float32": bands("profit", "CAST(CAST(discount_rate AS FLOAT) AS DOUBLE)"),
    "discount_band_leak_loss": leak("loss"),
    "discount_band_leak_profit": leak("profit"),
    "discount_impact": with_tx(
        f"""SELECT CAST(band_ord AS BIGINT) AS band_ord, band, {two('coalesce(l, 0)')} AS loss,
            {two('coalesce(p, 0)')} AS profit FROM t""",
        f"""{BAND_ROWS}, t AS (SELECT band_ord, band, sum(loss) AS l, sum(profit) AS p
            FROM b LEFT JOIN tx ON wide_rate > lo AND wide_rate <= hi GROUP BY band_ord, band)""",
    ),
    "discount_bands_by_row": with_tx(
        "SELECT band, count(*) AS lines FROM tx LEFT JOIN b ON wide_rate > lo AND wide_rate <= hi GROUP BY band",
        BAND_ROWS,
    ),
    "customer_totals": with_tx(
        f"SELECT name, {r4('s')} AS sales, {r4('p')} AS profit, orders FROM c", CUSTOMERS
    ),
    "customer_list": with_tx(
        f"SELECT name, {two('s')} AS sales, {two('p')} AS profit, orders FROM c", CUSTOMERS
    ),
    "top_profit_customers": ranking("p", "DESC"),
    "top_revenue_customers": ranking("s", "DESC"),
    "bottom_profit_customers": ranking("p", "ASC"),
    "bottom_revenue_customers": ranking("s", "ASC"),
    "vip_customers": with_tx(in_both("DESC"), CUSTOMERS),
    "critical_customers": with_tx(in_both("ASC"), CUSTOMERS),
    "segment_customers": with_tx(
        f"""SELECT name, {r4('s')} AS sales, {r4('p')} AS profit, orders,
            CASE WHEN name IN (SELECT name FROM v) THEN 'vip' WHEN name IN (SELECT name FROM w) THEN 'critical'
              WHEN p < 0 THEN 'loss' ELSE 'regular' END AS segment FROM c""",
        f"{CUSTOMERS}, v AS ({in_both('DESC')}), w AS ({in_both('ASC')})",
    ),
    "country_totals": with_tx(
        f"SELECT country, {r4('s')} AS sales, {r4('p')} AS profit, {r4('h')} AS shipping_cost, n AS orders FROM g",
        COUNTRIES,
    ),
    "shipping_margin": with_tx(
        f"SELECT country, {two('h / n')} AS avg_shipping, {two('p / s * 100')} AS profit_margin FROM g", COUNTRIES
    ),
    "market_leader": with_tx(
        f"""SELECT country, {r4('s')} AS sales, {r4('p')} AS profit, n AS orders
            FROM g ORDER BY s DESC, country LIMIT 1""",
        COUNTRIES,
    ),
    "market_bubble": with_tx(
        f"""SELECT country, {r4('s')} AS sales, {r4('p')} AS profit, n AS orders
            FROM g ORDER BY s DESC, country LIMIT 50 OFFSET 1""",
        COUNTRIES,
    ),
    "bottom_countries": with_tx(
        f"SELECT country, {r4('p')} AS profit FROM g ORDER BY p, country LIMIT 15", COUNTRIES
    ),
    "critical_geography": with_tx(
        """SELECT country, count(*) AS count FROM (
             SELECT customer_name, country, sum(profit) AS p FROM tx GROUP BY customer_name, country)
           WHERE p < 0 GROUP BY country ORDER BY count DESC, country LIMIT 15"""
    ),
    "search_any": with_tx(
        f"""SELECT {ROWS} FROM tx WHERE product_name ILIKE '%red w%' OR country LIKE '%\\_24' ESCAPE '\\'
            OR regexp_matches(CAST(order_date AS VARCHAR), '1999-0[1-3]-1')"""
    ),
    "filter_columns": with_tx(
        f"""SELECT {ROWS} FROM tx WHERE (customer_name LIKE '%0001%' OR customer_name LIKE '%0002%')
            AND country LIKE 'NATION@_1%' ESCAPE '@'"""
    ),
    "sorted_page": with_tx(
        f"""SELECT {ROWS} FROM (SELECT * FROM tx
            ORDER BY sales, order_id, tx.order_date, customer_name, country, product_name LIMIT 100 OFFSET 200)"""
    ),
    "deep_page": with_tx(
        f"SELECT {ROWS} FROM (SELECT * FROM tx ORDER BY tx.order_date DESC, {ROW_ORDER} LIMIT 50 OFFSET 5000)"
    ),
    "deep_page_by_name": with_tx(
        f"""SELECT {ROWS} FROM (SELECT * FROM tx
            ORDER BY customer_name, order_id, tx.order_date, country, product_name, sales LIMIT 50 OFFSET 4500)"""
    ),
    "page_after": """SELECT o_orderkey AS row_id, CAST(o_orderdate AS VARCHAR) AS order_date, o_totalprice
        FROM (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-12-31'
          OR (o_orderdate = TIMESTAMP '1998-12-31' AND o_orderkey > 100)
          ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 500)""",
    "page_info": with_tx(
        """SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages
           FROM tx WHERE product_name ILIKE '%widget%'"""
    ),
    "page_info_literal": with_tx("SELECT count(*) AS total, count(*) // 100 + 1 AS pages FROM tx"),
    "explore_rows": with_tx(
        f"""SELECT {ROWS} FROM (SELECT * FROM tx WHERE {FOUND}
            ORDER BY tx.order_date DESC, {ROW_ORDER} LIMIT 50 OFFSET 50)"""
    ),
    "explore_counts": with_tx(
        f"""SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM tx WHERE {FOUND}"""
    ),
    "audit_export": with_tx(
        f"""SELECT '-' AS "Row ID", CASE order_id WHEN '0' THEN '-' ELSE order_id END AS "Order ID",
            {iso('order_date')} AS "Fecha", customer_name AS "Cliente",
            category AS "Categoría", sub_category AS "Sub-Categoría", product_name AS "Producto",
            country AS "Estado / Región", {r4('sales')} AS "Ventas", {r4('profit')} AS "Utilidad",
            {r4('loss')} AS "Pérdida", {r4('discount_amount')} AS "Monto Descuento",
            printf('%.2f%%', discount_rate * 100) AS "Tasa Descuento", '-' AS "Método de Pago",
            {iso('ship_date')} AS "Fecha de Envío", '-' AS "Modo de Envío", order_priority AS "Prioridad",
            'Sin datos XML' AS "Metadata XML" FROM tx"""
    ),
    "audit_export_documents": with_tx(
        f"""SELECT CASE order_id WHEN '0' THEN '-' ELSE order_id END AS "Order ID", {r4('sales')} AS "Ventas",
            CASE WHEN quantity % 2 = 0 THEN 'PPD' ELSE '-' END AS "Método de Pago",
            CASE WHEN quantity IN (7, 8, 9) THEN 'Sin datos XML' ELSE
              '{{"Folio":"' || order_id || '","Receptor":{{"Nombre":"say \\"' || customer_name ||
              '\\""}},"Conceptos":{{"Concepto":[{{"Cantidad":"' || quantity || '"}}]}}}}' END AS "Metadata XML" FROM tx"""
    ),
    "document_fields": with_tx(
        """SELECT order_id, CASE WHEN quantity NOT IN (7, 8, 9) THEN 'say "' || customer_name || '"' END AS receiver,
            CASE WHEN quantity NOT IN (7, 8, 9) THEN quantity END AS quantity, CAST(NULL AS VARCHAR) AS issuer FROM tx"""
    ),
    "date_functions": with_tx(
        f"""SELECT order_id, date_diff('day', order_date, ship_date) AS lead_days,
            {MONTHS}[month(order_date)] AS month_label,
            CAST(order_date + INTERVAL 1 DAY AS VARCHAR) AS estimated,
            strftime(order_date, '%-d/%-m/%Y') AS short_date, {iso('ship_date')} AS date_text FROM tx"""
    ),
    "event_times": """SELECT event_id,
        strftime(timezone('America/Mexico_City', timezone('UTC', ts)), '%d/%m/%Y %I:%M %p') AS mexico_time,
        replace(CAST(ts AS VARCHAR), ' ', 'T') AS date_text,
        CAST(floor((epoch_us(date_trunc('year', ts)) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS lead_days,
        substr(props, 1, 6) || '...' AS preview FROM events""",
    "label_functions": f"""SELECT c_custkey, substr(c_name, 1, 12) || '...' AS label,
        {sized(cleaned_name(), 20)} AS cut_name, {sized(cleaned_name(), 60)} AS whole_name FROM customer""",
    "number_functions": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
        CAST(printf('%.2f', l_extendedprice * l_discount) AS DOUBLE) + 0.0 AS rounded,
        printf('%.2f%%', l_discount * l_tax * 100) AS percent,
        CASE WHEN CAST(l_extendedprice * 1000 AS VARCHAR) LIKE '%.%' THEN CAST(l_extendedprice * 1000 AS VARCHAR)
          ELSE CAST(l_extendedprice * 1000 AS VARCHAR) || '.0' END AS text,
        '$' || format('{{:,}}', CAST(printf('%.0f', -l_extendedprice) AS BIGINT)) || ' USD' AS usd,
        CASE WHEN l_discount * 100 - 5 >= 0 THEN '+' ELSE '' END
          || regexp_replace(printf('%.2f', l_discount * 100 - 5), '0$', '') || '%' AS trend,
        {r4('l_extendedprice * l_discount / l_extendedprice')} AS rate,
        {r4('l_extendedprice * l_discount')} AS amount FROM lineitem""",
    "catalogue_lookups": f"""WITH {STATES} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
        coalesce(state, 'Otros Estados') AS state, {CATEGORY} AS category,
        {margin(CATEGORY, 'l_extendedprice')} AS profit,
        {r4(line_rate('l_extendedprice', 'l_extendedprice * l_discount'))} AS rate,
        CASE WHEN l_returnflag = 'A' THEN 'Express' ELSE 'Estándar' END AS mode,
        CAST(l_quantity AS BIGINT) AS quantity FROM lineitem LEFT JOIN st ON prefix = {KEY}""",
    "sanitized_measures": with_tx(
        f"""SELECT order_id, CAST(quantity AS BIGINT) AS quantity,
            CASE WHEN quantity > 40 THEN 0 ELSE {r4('sales')} END AS sales,
            CASE WHEN quantity < 10 THEN 0 ELSE {r4('profit')} END AS profit,
            CASE WHEN quantity = 25 THEN 0 ELSE {r4('shipping_cost')} END AS shipping_cost,
            quantity >= 10 AND profit < 0 AS is_loss FROM tx"""
    ),
    "narrow_measures": with_tx(
        f"""SELECT order_id, {r4('CAST(CAST(sales AS FLOAT) AS DOUBLE)')} AS sales,
            {r4('CAST(CAST(profit AS FLOAT) AS DOUBLE)')} AS profit,
            {r4('CAST(CAST(discount_rate AS FLOAT) AS DOUBLE)')} AS discount_rate FROM tx"""
    ),
    "csv_round_trip": with_tx(
        f"""SELECT order_id, CAST(order_date AS VARCHAR) AS order_date,
            CASE WHEN quantity = 14 THEN NULL ELSE CAST(ship_date AS VARCHAR) END AS ship_date,
            order_priority, customer_name, segment, country, market, category, sub_category,
            'say "' || product_name || '", twice' AS product_name, {r4('sales')} AS sales, {r4('profit')} AS profit,
            {r4('shipping_cost')} AS shipping_cost, {r4('loss')} AS loss, CAST(quantity AS BIGINT) AS quantity,
            {r4('discount_rate')} AS discount_rate, {r4('sales * discount_rate')} AS discount_amount, 'csv' AS source
            FROM tx WHERE quantity <> 13"""
    ),
    "parse_invoices": invoices(),
    "parse_invoices_last_line": invoices(last_line=True),
    "invoice_json": f"""SELECT CAST(l_orderkey AS VARCHAR) AS archive, CAST(l_linenumber AS BIGINT) AS member_no,
        {MEMBER} AS member, {JSON} AS invoice_json
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "invoice_archives": f"""SELECT concat_ws('/', l_orderkey, l_linenumber, {MEMBER})
          || '.xml' AS member, CAST(octet_length(encode({XML})) AS BIGINT) AS bytes, md5({XML}) AS digest
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "canonical_invoices": invoices(canonical=True),
    "consolidated_sources": with_tx(
        f"""SELECT 'csv' AS source, category, count(*) AS rows, CAST(0 AS BIGINT) AS with_payment,
            {r4('sum(sales)')} AS sales FROM tx GROUP BY category
            UNION ALL
            SELECT 'xml', category, count(*), count(*), {r4('sum(sales)')} FROM (
              SELECT {CATEGORY} AS category, l_extendedprice AS sales FROM lineitem
              UNION ALL SELECT 'Furniture', l_extendedprice FROM lineitem) GROUP BY category"""
    ),
    "suppress_duplicates": f"""WITH {DOCUMENTS}
        SELECT archive, member_no, member, order_id FROM n WHERE turn = 1 AND NOT stored""",
    "ingest_report": f"""WITH {DOCUMENTS} SELECT count(*) FILTER (turn = 1 AND NOT stored) AS records_inserted,
        count(*) FILTER (turn > 1 OR stored) AS invoices_skipped, CAST(0 AS BIGINT) AS documents_held FROM n""",
    "invoice_intake": f"""SELECT 2 * count(*) AS lines, 2 * count(*) AS ids, CAST(1 AS BIGINT) AS first_id,
        2 * count(*) AS last_id, count(*) AS invoices, {r4('2 * sum(l_extendedprice)')} AS sales FROM lineitem""",
    "delete_by_ids": """SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice,
        CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""",
    "deleted_count": """SELECT count(*) AS deleted_count FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""",
    "stored_delete": """SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice,
        CAST(o_orderdate AS VARCHAR) AS order_date, o_orderpriority, year(o_orderdate) AS order_year FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""",
    "replace_dataset": with_tx(
        f"""SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, sales, {r4('profit')} AS profit,
            year(order_date) AS order_year FROM tx"""
    ),
    "upsert_annotations": f"""WITH {NOTES} SELECT page_name, content, updated_by_name,
        CAST(updated_at AS VARCHAR) AS updated_at FROM newest""",
    "latest_annotation": f"""WITH {NOTES}, asked AS (SELECT r_name AS page_name FROM region
          UNION ALL SELECT DISTINCT o_orderpriority FROM orders)
        SELECT page_name, coalesce(content, 'Sin comentarios estratégicos registrados aún.') AS content,
          coalesce(updated_by_name, 'Sistema') AS updated_by_name FROM asked LEFT JOIN newest USING (page_name)""",
    "page_after_ties": with_tx(
        f"SELECT {ROWS} FROM (SELECT * FROM tx ORDER BY tx.order_date DESC, {ROW_ORDER} LIMIT 50 OFFSET 500)"
    ),
    "explore_far_page": with_tx(
        f"""SELECT {ROWS} FROM (SELECT * FROM tx
            ORDER BY tx.product_name, tx.order_id, tx.order_date, customer_name, country, sales LIMIT 50 OFFSET 5000)"""
    ),
    "named_batches": """SELECT l_returnflag, count(*) AS lines, count(*) AS ids, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY l_returnflag""",
    "upload_then_refresh": with_tx(
        f"""SELECT CASE WHEN quantity % 2 = 0 THEN 'csv' ELSE 'xml' END AS source, count(*) AS rows, count(*) AS ids,
            CAST(sum(quantity) AS BIGINT) AS quantity, {r4('sum(sales)')} AS sales FROM tx GROUP BY 1"""
    ),
    "delete_in_consolidated": with_tx(
        f"""SELECT CASE WHEN quantity % 2 = 0 THEN 'csv' ELSE 'xml' END AS source, count(*) AS rows, count(*) AS ids,
            CAST(sum(quantity) AS BIGINT) AS quantity, {r4('sum(sales)')} AS sales FROM tx
            WHERE quantity % 2 = 0 OR NOT regexp_matches(country, '(?i)nation_7$') GROUP BY 1"""
    ),
    "selection_outlives_refresh": with_tx(
        f"""SELECT CASE WHEN quantity % 2 = 0 THEN 'csv' ELSE 'xml' END AS source, count(*) AS rows, count(*) AS ids,
            CAST(sum(quantity) AS BIGINT) AS quantity, {r4('sum(sales)')} AS sales FROM tx
            WHERE quantity % 2 = 0 OR quantity >= 25 OR NOT regexp_matches(country, '(?i)nation_[78]$') GROUP BY 1"""
    ),
    "overlapping_intake": """SELECT 2 * count(*) AS lines, 2 * count(*) AS ids, count(*) AS invoices,
        2 * count(*) FILTER (l_linenumber > 4) AS records_inserted,
        count(*) FILTER (l_linenumber BETWEEN 3 AND 4) AS invoices_skipped, CAST(0 AS BIGINT) AS documents_held FROM lineitem""",
    "keyed_intake": f"""SELECT 2 * count(*) AS first_lines, CAST(0 AS BIGINT) AS second_lines, 2 * count(*) AS ids,
        count(*) AS invoices, {r4('2 * sum(l_extendedprice)')} AS sales FROM lineitem""",
    "stored_page_by_date": with_tx("SELECT CAST(order_date AS VARCHAR) AS order_date FROM tx ORDER BY tx.order_date DESC LIMIT 100 OFFSET 4000"),
    "stored_page_by_sales": with_tx("SELECT sales FROM tx ORDER BY sales LIMIT 100 OFFSET 4000"),
    "stored_page_by_name": with_tx("SELECT product_name FROM tx ORDER BY product_name LIMIT 100 OFFSET 4000"),
    "newest_first": "SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type FROM events ORDER BY events.ts DESC, event_id",
    "snapshot_changes": """SELECT o_orderkey AS id, o_custkey AS email,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'ELIMINACION_USUARIO' ELSE 'MODIFICACION_GOBERNANZA' END AS action,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'Usuario eliminado permanentemente por el administrador.'
          ELSE 'Status: ' || o_orderstatus || '->F | Role: ' || o_orderpriority || '->' || o_orderpriority END AS details
        FROM orders WHERE o_orderpriority = '5-LOW' OR (o_totalprice > 300000 AND o_orderstatus <> 'F')""",
    "record_count": with_tx("SELECT count(*) AS records FROM tx"),
    "numbered_rows": """SELECT count(*) AS rows, count(*) AS ids, CAST(1 AS BIGINT) AS first_id,
        count(*) AS last_id FROM lineitem""",
}
ORACLES["csv_mixed_headers"] = ORACLES["csv_round_trip"]
ORACLES["stored_annotations"] = ORACLES["latest_annotation"]
for _name in ("kpis", "customer_totals", "country_totals"):
    ORACLES[f"{_name}_from_partials"] = ORACLES[_name]

#: The query that gives each list of the dashboard.
LISTS = {
    "kpis": "kpis", "sales_over_time": "monthly_seasonality", "category_data": "category_performance",
    "subcategories": "subcategory_ranking", "shipping": "top_shipping", "top_losses": "top_losses",
    "bottom_20": "bottom_products", "top_discounts": "top_discounts", "discount_margin_impact": "discount_band_loss",
    "total_loss": "discount_band_leak_loss", "discount_margin_netimpact": "discount_band_profit",
    "total_net_loss": "discount_band_leak_profit", "topProfitable": "top_profit_customers",
    "topRevenue": "top_revenue_customers", "bottomProfitable": "bottom_profit_customers",
    "bottomRevenue": "bottom_revenue_customers", "segmentation": "customer_list", "outlier": "market_leader",
    "bubble_data": "market_bubble", "shipping_relation": "shipping_margin", "bottom_countries": "bottom_countries",
    "critical_geo": "critical_geography",
}


def listed(name, query):
    whole = "* EXCLUDE (profit_margin), profit_margin AS margin_text" if name == "kpis" else "*"
    fields = ", ".join(f'"{column}" AS "{field.lower()}"' for field, column in FIELDS.get(name, {}).items())
    return f"SELECT '{name}' AS list, {fields or whole} FROM ({ORACLES[query]})"


ORACLES["dashboard"] = " UNION ALL BY NAME ".join(listed(*pair) for pair in LISTS.items())
