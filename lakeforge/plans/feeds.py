"""Raw feeds as text, made from all rows of the star tables: one SQL text for Spark and for DuckDB.

Each feed has the columns and the faults of a source system: mixed date formats, decimal commas, blanks, orphans,
malformed numbers, rows delivered twice. Queries type them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeforge.plans.registry import table


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def vin(x: str) -> str:
    return f"'wvwzzz1kz' || lpad({s(x)}, 8, '0')"


def plus(day: str, n: str) -> str:
    return f"({day} + CAST({n} AS INT))"


def dec(x: str) -> str:
    return s(f"CAST({x} AS DECIMAL(18,2))")


def comma(x: str) -> str:
    return f"replace({dec(x)}, '.', ',')"


def dotted(day: str) -> str:
    return f"(substr({s(day)}, 9, 2) || '.' || substr({s(day)}, 6, 2) || '.' || substr({s(day)}, 1, 4))"


_O, _L = "CAST(o_orderdate AS DATE)", "CAST(l_shipdate AS DATE)"
_CUSTOMER = f"CASE WHEN o_orderkey % 331 = 0 THEN '' ELSE 'CUS' || {s('o_custkey')} END"
_SERVICE = "CASE o_orderkey % 9 WHEN 0 THEN 'maint' WHEN 1 THEN 'repair' WHEN 2 THEN 'WARRANTY' WHEN 3 THEN 'BODY' WHEN 4 THEN 'TYRE' WHEN 5 THEN 'RECALL' WHEN 6 THEN 'INSPECT' WHEN 7 THEN ' maint ' ELSE 'OTHER' END"
_CONTRACT = f"""SELECT 'C' || {s('o_orderkey')} AS contract_no, CASE WHEN o_orderkey % 50 = 7 THEN {dotted(_O)} ELSE {s(_O)} END AS contract_date,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE {s(plus(_O, 'o_orderkey % 40 - 2'))} END AS delivery_date, {s(_O)} AS invoice_date, CASE WHEN o_orderkey % 77 = 1 THEN '99.99.2024' ELSE {s(plus(_O, 'o_orderkey % 45'))} END AS registration_date,
 CASE WHEN o_orderkey % 97 = 0 THEN 'bad' || {s('o_orderkey')} ELSE {vin('o_custkey')} END AS vin, ' D' || {s('o_custkey % 12')} || ' ' AS dealer_code, 'E' || {s('o_orderkey % 30')} AS salesperson_id, {_CUSTOMER} AS customer_id,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'used' ELSE 'new' END AS sale_type, 'M' || {s('o_custkey % 6')} AS model_trim_code, '34  ABC ' || {s('100 + o_custkey % 900')} AS plate_number,
 CASE o_orderstatus WHEN 'F' THEN 'try' WHEN 'O' THEN 'USD' ELSE 'EUR' END AS currency_code, {comma('o_totalprice')} AS list_price, CASE WHEN o_orderkey % 499 = 0 THEN '-5,00' ELSE {comma('o_orderkey % 1000')} END AS discount_amount, {comma('o_totalprice')} AS net_sale_amount,
 CASE WHEN o_orderkey % 6 = 0 THEN {vin('o_custkey + 1')} ELSE '' END AS trade_in_vin, CASE WHEN o_orderkey % 6 = 0 THEN '100,50' ELSE '' END AS trade_in_amount,
 CASE o_orderkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'loan' ELSE 'lease' END AS payment_type, CASE WHEN o_orderkey % 2 = 0 THEN 'showroom' ELSE 'ONLINE' END AS channel, {s('o_orderkey % 2')} AS is_campaign, o_orderkey * 2 AS _ingest_ts FROM {{orders}}"""
_ORDER = f"""SELECT 'R' || {s('o_orderkey')} AS repair_order_no, 'D' || {s('o_custkey % 12')} AS dealer_code, CASE WHEN o_orderkey % 89 = 0 THEN ' ' WHEN o_orderkey % 53 = 0 THEN 'wvw' || {s('o_orderkey')} ELSE ' ' || {vin('o_custkey')} END AS vin, {_CUSTOMER} AS customer_id,
 'E' || {s('o_orderkey % 30')} AS service_advisor_id, 'E' || {s('o_orderkey % 23')} AS technician_id, {_SERVICE} AS service_type_code, {s('(o_orderkey * 7) % 200000')} AS odometer_km, {s('o_orderkey % 2')} AS is_warranty,
 CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'in_progress' ELSE 'waiting_parts' END AS status, CASE WHEN o_orderkey % 41 = 0 THEN '99 ABC 12' WHEN o_orderkey % 43 = 0 THEN '34ABC12' ELSE '34 ABC ' || {s('100 + o_custkey % 900')} END AS plate_number, {s(plus(_O, '-1'))} AS appointment_date,
 {s(_O)} || ' 08:00:00' AS checkin_ts, {s(_O)} || CASE WHEN o_orderkey % 211 = 0 THEN ' 07:00:00' ELSE ' 09:30:00' END AS inspection_ts,
 CASE WHEN o_orderkey % 3 = 0 THEN {s(_O)} || ' 10:00:00' ELSE '' END AS parts_wait_start_ts, CASE WHEN o_orderkey % 3 = 0 THEN {s(plus(_O, '2'))} || ' 10:15:00' ELSE '' END AS parts_ready_ts, {s(_O)} || 'T11:00:00' AS repair_start_ts,
 {s(plus(_O, 'o_orderkey % 5'))} || ' 16:45:00' AS repair_end_ts, {s(plus(_O, 'o_orderkey % 5'))} || ' 17:00:00' AS qc_ts, CASE WHEN o_orderstatus = 'P' THEN '' ELSE {s(plus(_O, 'o_orderkey % 5 + 1'))} || ' 09:00:00' END AS delivery_ts,
 {dec('o_totalprice')} AS total_labour_amount, {dec('o_orderkey % 700')} AS total_part_amount, {dec('(o_orderkey % 2) * 50')} AS total_warranty_amount, {dec('o_totalprice')} AS customer_payable_amount, o_orderkey AS _ingest_ts FROM {{orders}}"""
_MONTH = "CASE WHEN r_regionkey % 3 = 0 THEN 'vehicle_sales_count' WHEN r_regionkey % 3 = 1 THEN 'VEHICLE_SALES_AMOUNT' ELSE 'SERVICE_REVENUE_AMOUNT' END"

FEEDS = {
    "raw_fx": f"SELECT {s(plus("DATE '1992-02-01'", 'n_nationkey * 97'))} AS rate_date, CASE WHEN n_nationkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency_code, {s('CAST(1 + n_nationkey / 8.0 AS DECIMAL(18,6))')} AS rate_to_try, n_nationkey AS _ingest_ts FROM {{nation}}",
    # a contract in progress was delivered before, with another price
    "raw_contract": f"{_CONTRACT} UNION ALL SELECT 'C' || {s('o_orderkey')}, {s(_O)}, '', '', '', 'x', 'D1', 'E1', 'CUS1', 'new', 'M1', '', 'TRY', '1,00', '0,00', '1,00', '', '', 'cash', 'ONLINE', '0', o_orderkey * 2 - 1 FROM {{orders}} WHERE o_orderstatus = 'P' AND o_orderkey % 50 <> 7",
    "raw_order": _ORDER,
    "raw_line": f"""SELECT 'R' || {s('l_orderkey')} AS repair_order_no, {s('l_linenumber')} AS line_no, CASE WHEN l_linestatus = 'O' THEN 'part' ELSE 'labour' END AS line_type, CASE WHEN l_linestatus <> 'O' THEN '' WHEN l_partkey % 101 = 0 THEN 'PX' ELSE 'P' || {s('l_partkey')} END AS part_no,
 'OP' || {s('l_suppkey')} AS operation_code, '  wheel   and ' || l_returnflag AS description, {s('CAST(l_quantity AS DECIMAL(18,3))')} AS quantity, CASE WHEN l_linestatus = 'O' THEN '' WHEN l_linenumber = 7 THEN '-1.50' ELSE {dec('l_quantity * 3')} END AS labour_hours,
 {dec('l_extendedprice')} AS unit_price, '0.00' AS discount_amount, {dec('l_extendedprice')} AS line_amount, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN '9999999.00' WHEN l_returnflag = 'R' THEN '10.00' ELSE '0.00' END AS warranty_amount, {dec('l_extendedprice')} AS customer_amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS _ingest_ts FROM {{lineitem}}""",
    "raw_purchase": f"""SELECT 'PO' || {s('l_orderkey')} AS po_no, {s('l_linenumber')} AS po_line_no, {s(plus(_L, '-20'))} AS order_date, 'S' || {s('l_suppkey')} AS supplier_id, CASE WHEN l_partkey % 103 = 0 THEN 'PY' ELSE 'P' || {s('l_partkey')} END AS part_no, {s('CAST(l_quantity AS DECIMAL(18,3))')} AS ordered_quantity,
 CASE WHEN l_returnflag = 'R' THEN {s('CAST(l_quantity - 1 AS DECIMAL(18,3))')} ELSE {s('CAST(l_quantity AS DECIMAL(18,3))')} END AS received_quantity, {s(_L)} AS promised_date, CASE WHEN l_linestatus = 'O' THEN '' ELSE {s(plus(_L, 'l_orderkey % 7 - 2'))} END AS delivery_date,
 CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'received' END AS status, CASE l_returnflag WHEN 'A' THEN 'TRY' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency_code, {dec('l_extendedprice')} AS unit_cost, {dec('l_extendedprice')} AS line_amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS _ingest_ts FROM {{lineitem}}""",
    "raw_claim": f"""SELECT 'W' || {s('l_orderkey')} || '-' || {s('l_linenumber')} AS claim_no, 'R' || {s('l_orderkey')} AS repair_order_no, {vin('l_partkey')} AS vin, 'D' || {s('l_suppkey % 12')} AS dealer_code, 'WARRANTY' AS service_type_code, {s(_L)} AS claim_date,
 CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE {s(plus(_L, 'l_orderkey % 30'))} END AS decision_date, CASE WHEN l_orderkey % 4 = 0 THEN 'pending' WHEN l_orderkey % 4 = 1 THEN 'rejected' ELSE 'approved' END AS status, {dec('l_extendedprice')} AS claimed_amount,
 CASE WHEN l_orderkey % 4 >= 2 THEN {dec('l_extendedprice')} ELSE '' END AS approved_amount, CASE WHEN l_orderkey % 4 = 1 THEN ' not  covered' ELSE ' ' END AS rejection_reason, CAST(l_extendedprice AS DECIMAL(18,2)) AS _ingest_ts FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "raw_campaign": f"SELECT 'RC' || {s('n_nationkey')} AS campaign_code, n_name AS campaign_name, CASE WHEN n_regionkey % 2 = 0 THEN 'safety' ELSE 'software' END AS category, {s(plus("DATE '1994-01-01'", 'n_nationkey * 10'))} AS launch_date, '1990-01-01' AS production_from, '31/12/1993' AS production_to, {s('n_nationkey * 3')} AS affected_vehicle_count, n_nationkey AS _ingest_ts FROM {{nation}}",
    "raw_coverage": f"SELECT 'RC' || {s('c_nationkey')} AS campaign_code, {vin('c_custkey')} AS vin, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE {s(plus("DATE '1994-06-01'", 'c_custkey % 300'))} END AS notified_date, CASE WHEN c_acctbal > 0 THEN {s(plus("DATE '1994-06-01'", 'c_custkey % 300 + c_custkey % 90'))} ELSE '' END AS completed_date, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS is_completed, c_custkey AS _ingest_ts FROM {{customer}}",
    "raw_budget": f"SELECT 'D' || {s('s_suppkey')} AS dealer_code, '1995' AS budget_year, {s('r_regionkey + 1')} AS budget_month, {_MONTH} AS metric_code, {dec('100 + s_suppkey')} AS target_value, 'try' AS currency_code, s_suppkey AS _ingest_ts FROM {{supplier}} CROSS JOIN {{region}}",
    "raw_vehicle": f"""SELECT {vin('c_custkey')} AS vin, 'M' || {s('c_nationkey % 6')} AS model_trim_code, '1991' AS model_year, 'red' AS colour, {s(plus("DATE '1989-06-01'", 'c_custkey % 900'))} AS production_date, {s(plus("DATE '1992-01-15'", 'c_custkey % 500'))} AS arrival_date, 'D' || {s('c_custkey % 12')} AS stock_dealer_code, {comma('c_acctbal')} AS dealer_cost_try, 'EN' AS engine_no,
 'IN_STOCK' AS status, '34 ABC ' || {s('100 + c_custkey % 900')} AS plate_number, '' AS owner_customer_id, '1' AS is_active, '1992-03-01 10:00:00' AS last_modified_ts, 1 AS _ingest_ts FROM {{customer}}
 UNION ALL SELECT {vin('c_custkey')}, 'M' || {s('c_nationkey % 6')}, '1991', 'red', {s(plus("DATE '1989-06-01'", 'c_custkey % 900'))}, {s(plus("DATE '1992-01-15'", 'c_custkey % 500'))}, 'D' || {s('c_custkey % 12')}, {comma('c_acctbal')}, 'EN',
 CASE WHEN c_acctbal > 0 THEN 'SOLD' ELSE 'IN_STOCK' END, '34 ABC ' || {s('100 + c_custkey % 900')}, CASE WHEN c_acctbal > 0 THEN 'CUS' || {s('c_custkey')} ELSE '' END, '1', '1995-06-01 10:00:00', 2 FROM {{customer}}""",
    "raw_dealer": f"""SELECT 'D' || {s('s_suppkey')} AS dealer_code, s_name AS dealer_name, 'BOTH' AS dealer_type, '34' AS province_code, 'city ' || {s('s_nationkey')} AS city, 'north' AS region, 'street' AS address_line, '' AS phone, '4' AS workshop_bay_count, {s('440 + s_suppkey')} AS monthly_capacity_hours, '01.01.1990' AS opening_date, '1' AS is_active, '1991-01-01 00:00:00' AS last_modified_ts, 1 AS _ingest_ts FROM {{supplier}}
 UNION ALL SELECT 'D' || {s('s_suppkey')}, s_name, 'BOTH', '34', CASE WHEN s_nationkey % 2 = 0 THEN 'moved' ELSE 'city ' || {s('s_nationkey')} END, 'north', 'street', '', '4', {s('440 + s_suppkey')}, '01.01.1990', '1', '1995-06-17 00:00:00', 2 FROM {{supplier}}""",
    "raw_employee": f"SELECT 'E' || {s('n_nationkey')} AS employee_id, n_name AS first_name, 'X' AS last_name, n_name || ' X' AS full_name, 'D' || {s('n_regionkey')} AS dealer_code, 'TECHNICIAN' AS role_code, '' AS email, '1990-05-01' AS hire_date, '1' AS is_active, '1990-05-01 00:00:00' AS last_modified_ts, 1 AS _ingest_ts FROM {{nation}}",
    "raw_model": f"SELECT 'M' || {s('r_regionkey')} AS model_trim_code, 'brand' AS brand, r_name AS model_name, 'trim' AS trim_name, '1991' AS model_year, '1.234.567,89' AS list_price_try, '1' AS is_active, '1990-01-01 00:00:00' AS last_modified_ts, 1 AS _ingest_ts FROM {{region}}",
    "raw_part": f"SELECT 'P' || {s('p_partkey')} AS part_no, p_name AS part_name, p_brand AS part_group_code, p_type AS part_group_name, '1' AS is_genuine, '' AS supplier_id, 'AD' AS unit_of_measure, {dec('p_retailprice')} AS list_price_try, '1' AS is_active, '1991-06-01 00:00:00' AS last_modified_ts, p_partkey AS _ingest_ts FROM {{part}}",
    "raw_supplier": f"SELECT 'S' || {s('s_suppkey')} AS supplier_id, s_name AS supplier_name, CASE WHEN s_nationkey % 3 = 0 THEN 'TR' ELSE 'DE' END AS country_code, '7' AS lead_time_days, '' AS contact_email, '1' AS is_active, '1990-01-01 00:00:00' AS last_modified_ts, 1 AS _ingest_ts FROM {{supplier}}",
    "raw_xref": f"SELECT 'CUS' || {s('c_custkey')} AS customer_id, 'MST' || lpad({s('c_custkey')}, 8, '0') AS master_customer_id FROM {{customer}} WHERE c_acctbal > 0",
}
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def feed(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = FEEDS[name]
    return spark.sql(sql, **{t: table(spark, d, t) for t in TABLES if f"{{{t}}}" in sql})


def duck(name: str) -> str:
    return FEEDS[name].format(**{t: t for t in TABLES})
