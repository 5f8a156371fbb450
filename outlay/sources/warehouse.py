"""Adapter: order tables as the canonical transactions table, in Spark and as SQL for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions.text import canonical_id

CURRENCIES = ("AUD", "USD", "EUR", "GBP", "NZD", "SGD", "JPY", "CAD")
_TERMS = {0: 14, 1: 30, 2: 45, 3: 60, 4: 90}
_METHODS = {0: "GL_MAPPING", 1: "SUPPLIER_MAPPING", 2: "KEYWORD", 3: "EMBEDDING", 4: "MANUAL"}
_DECIMAL = "decimal(18,2)"


def _by_remainder(c: Column, values: dict) -> Column:
    out = F.when(c == -1, None)
    for k, v in values.items():
        out = out.when(c == k, v)
    return out


def _columns() -> dict[str, tuple[set[str], Column]]:
    """Each column with the tables besides ``lineitem`` that it needs."""
    c = F.col
    amount = (c("l_extendedprice").cast(_DECIMAL) * (F.lit(1).cast("int") - c("l_discount").cast("decimal(4,2)"))).cast(_DECIMAL)
    credit = (c("l_returnflag") == "R") & (c("l_linenumber") == 1)
    category = lambda v: F.when(c("l_partkey") % 40 != 0, v)
    text = [c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_linenumber"), *[c(x).cast(_DECIMAL) for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], c("l_returnflag"), c("l_linestatus"), c("l_shipdate").cast("date")]
    days = _by_remainder(c("l_suppkey") % 6, _TERMS)
    return {
        "transaction_id": (set(), F.md5(F.concat_ws("|", *[x.cast("string") for x in text]).cast("binary"))),
        "engagement_id": (set(), F.concat(F.lit("E"), (c("l_orderkey") % 3).cast("string"))),
        "invoice_number": (set(), F.concat(F.when(credit, "CN-").otherwise("INV-"), c("l_orderkey").cast("string"))),
        "invoice_date": (set(), c("l_shipdate").cast("date")),
        "raw_supplier_id": (set(), F.concat(F.lit("V-"), c("l_suppkey").cast("string"))),
        "raw_supplier_name": ({"supplier"}, F.when(c("l_orderkey") % 97 != 0, c("s_name"))),
        "canonical_supplier_id": ({"supplier"}, F.when(c("l_suppkey") % 50 != 49, canonical_id(F.lower("s_name")))),
        "canonical_supplier_name": ({"supplier"}, F.when(c("l_suppkey") % 50 != 49, c("s_name"))),
        "parent_company_name": (set(), F.when(c("l_suppkey") % 5 != 0, F.concat(F.lit("Parent "), (c("l_suppkey") % 4).cast("string")))),
        "base_amount": (set(), F.when(credit, -amount).otherwise(amount)),
        "original_currency": ({"supplier"}, F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]), (c("s_nationkey") % 8 + 1).cast("int"))),
        "payment_terms_days": (set(), days),
        "raw_payment_terms": (set(), F.concat(F.lit("Net "), days.cast("string"))),
        "po_number": (set(), F.when(c("l_orderkey") % 7 != 0, F.concat(F.lit("PO-"), c("l_orderkey").cast("string")))),
        "contract_id": (set(), F.when(c("l_suppkey") % 3 == 0, F.concat(F.lit("C-"), c("l_suppkey").cast("string")))),
        "is_on_contract": (set(), (c("l_suppkey") % 3 == 0).cast("int")),
        "category_l1": ({"part"}, category(c("p_type"))),
        "category_l2": ({"part"}, category(c("p_brand"))),
        "category_l3": ({"part"}, category(F.split("p_name", " ")[0])),
        "unspsc_code": ({"part"}, category((c("p_size") + 10).cast("string"))),
        "category_method": (set(), _by_remainder(c("l_partkey") % 6, _METHODS)),
        "category_confidence": (set(), F.when(c("l_partkey") % 6 != 5, ((c("l_partkey") * 37) % 101).cast("double") / 100)),
        "raw_line_description": ({"part"}, F.when(c("l_partkey") % 11 != 0, c("p_name"))),
        "gl_account": (set(), F.concat(F.lit("0"), (6000 + c("l_partkey") % 700).cast("string"))),
        "business_unit": ({"orders", "customer"}, F.when(c("o_custkey") % 30 != 0, c("c_mktsegment"))),
        "cost_centre": ({"orders"}, F.when(c("o_custkey") % 30 != 0, c("o_orderpriority"))),
        "plant_site": ({"orders"}, c("o_orderstatus")),
        "legal_entity": ({"orders", "customer", "customer_nation", "region"}, c("r_name")),
        "vendor_country": ({"supplier", "nation"}, c("n_name")),
        "is_intercompany": (set(), (c("l_suppkey") % 20 == 7).cast("int")),
        "is_tax_line": (set(), F.when(c("l_partkey") % 25 == 3, 1).when(c("l_partkey") % 2 == 0, 0)),
        "unit_price": (set(), F.when(c("l_partkey") % 3 != 0, F.round(c("l_extendedprice").cast(_DECIMAL) / c("l_quantity").cast(_DECIMAL), 2).cast(_DECIMAL))),
        "discount_percent": (set(), (c("l_discount") * 100).cast("decimal(5,2)")),
        "has_early_payment_discount": (set(), (c("l_discount").cast("decimal(4,2)") >= F.lit("0.05").cast("decimal(4,2)")).cast("int")),
        "ingested_at": ({"orders"}, c("o_orderdate")),
    }


def transactions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns (all, if none is named); only tables that they need are joined."""
    every = _columns()
    names = columns or tuple(every)
    needs = set().union(*[every[n][0] for n in names])
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = read("lineitem")
    # orders come first and bring what their customers have: where rows are shuffled, they are without the texts of suppliers and parts
    if "orders" in needs:
        orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        if "customer" in needs:
            orders = orders.join(read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        if "region" in needs:
            home = read("nation").select(F.col("n_nationkey").alias("h_nationkey"), F.col("n_regionkey").alias("h_regionkey")).join(read("region"), F.col("h_regionkey") == F.col("r_regionkey"))
            orders = orders.join(home.select("h_nationkey", "r_name"), F.col("c_nationkey") == F.col("h_nationkey"))
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if needs & {"supplier", "nation"}:
        out = out.join(read("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "nation" in needs:
        out = out.join(read("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    if "part" in needs:
        out = out.join(read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return out.select(*[every[n][1].alias(n) for n in names])


_CASE = lambda c, values: f"CASE {c} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in values.items()) + " END"
_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))"

#: The same table for DuckDB, as the common table expressions ``t`` and ``a`` (addressable rows).
TRANSACTIONS_SQL = f"""t AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::DECIMAL(18,2), l_extendedprice::DECIMAL(18,2), l_discount::DECIMAL(18,2), l_tax::DECIMAL(18,2), l_returnflag, l_linestatus, l_shipdate::DATE)) AS transaction_id,
    'E' || (l_orderkey % 3) AS engagement_id,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'CN-' ELSE 'INV-' END || l_orderkey AS invoice_number,
    l_shipdate::DATE AS invoice_date, 'V-' || l_suppkey AS raw_supplier_id,
    CASE WHEN l_orderkey % 97 <> 0 THEN s_name END AS raw_supplier_name,
    CASE WHEN l_suppkey % 50 <> 49 THEN substr(sha256(lower(s_name)), 1, 12) END AS canonical_supplier_id,
    CASE WHEN l_suppkey % 50 <> 49 THEN s_name END AS canonical_supplier_name,
    CASE WHEN l_suppkey % 5 <> 0 THEN 'Parent ' || (l_suppkey % 4) END AS parent_company_name,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -{_AMOUNT} ELSE {_AMOUNT} END AS base_amount,
    {list(CURRENCIES)!r}[s_nationkey % 8 + 1] AS original_currency,
    {_CASE("l_suppkey % 6", _TERMS)} AS payment_terms_days, 'Net ' || {_CASE("l_suppkey % 6", _TERMS)} AS raw_payment_terms,
    CASE WHEN l_orderkey % 7 <> 0 THEN 'PO-' || l_orderkey END AS po_number,
    CASE WHEN l_suppkey % 3 = 0 THEN 'C-' || l_suppkey END AS contract_id, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS is_on_contract,
    CASE WHEN l_partkey % 40 <> 0 THEN p_type END AS category_l1, CASE WHEN l_partkey % 40 <> 0 THEN p_brand END AS category_l2,
    CASE WHEN l_partkey % 40 <> 0 THEN split_part(p_name, ' ', 1) END AS category_l3,
    CASE WHEN l_partkey % 40 <> 0 THEN (p_size + 10)::VARCHAR END AS unspsc_code,
    {_CASE("l_partkey % 6", _METHODS)} AS category_method,
    CASE WHEN l_partkey % 6 <> 5 THEN ((l_partkey * 37) % 101)::DOUBLE / 100 END AS category_confidence,
    CASE WHEN l_partkey % 11 <> 0 THEN p_name END AS raw_line_description, '0' || (6000 + l_partkey % 700) AS gl_account,
    CASE WHEN o_custkey % 30 <> 0 THEN c_mktsegment END AS business_unit, CASE WHEN o_custkey % 30 <> 0 THEN o_orderpriority END AS cost_centre,
    o_orderstatus AS plant_site, r_name AS legal_entity, sn.n_name AS vendor_country,
    CASE WHEN l_suppkey % 20 = 7 THEN 1 ELSE 0 END AS is_intercompany, CASE WHEN l_partkey % 25 = 3 THEN 1 WHEN l_partkey % 2 = 0 THEN 0 END AS is_tax_line,
    CASE WHEN l_partkey % 3 <> 0 THEN round(l_extendedprice::DECIMAL(18,2)::DOUBLE / l_quantity::DECIMAL(18,2)::DOUBLE, 2)::DECIMAL(18,2) END AS unit_price,
    (l_discount * 100)::DECIMAL(5,2) AS discount_percent, CASE WHEN l_discount::DECIMAL(4,2) >= 0.05 THEN 1 ELSE 0 END AS has_early_payment_discount,
    o_orderdate AS ingested_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation hn ON c_nationkey = hn.n_nationkey JOIN region ON hn.n_regionkey = r_regionkey
), a AS (
  SELECT * FROM t WHERE coalesce(is_intercompany, 0) = 0 AND coalesce(is_tax_line, 0) = 0
)"""


#: Words that payment terms put behind a line's description, so that keyword rules find something.
SAID = {14: " toner cartridge", 30: " courier", 45: " legal fees", 60: " cloud hosting"}
FORMS = ("Pty Ltd", "P/L", "Inc.", "")


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as an export of texts in the default layout: names with legal forms, dates in three ways, empty texts for missing values."""
    c = F.col
    number = F.regexp_extract("raw_supplier_id", r"(\d+)", 1).cast("int")
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS]), number % len(FORMS) + 1)
    day, way = c("invoice_date"), F.regexp_extract("invoice_number", r"(\d+)", 1).cast("long") % 3
    texts = {
        "VENDOR_NAME": F.trim(F.concat("raw_supplier_name", F.lit(" "), form)), "VENDOR_NUM": c("raw_supplier_id"), "INV_NO": c("invoice_number"),
        "INV_DATE": F.when(way == 0, F.date_format(day, "yyyy-MM-dd")).when(way == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MMM-yyyy")),
        "LINE_DESC": F.concat("raw_line_description", _by_remainder(c("payment_terms_days"), SAID)), "AMT": c("base_amount").cast("string"), "CCY": c("original_currency"),
        "GL_CODE": c("gl_account"), "COST_CTR": c("cost_centre"), "PAY_TERMS": c("raw_payment_terms"), "PO_NUM": c("po_number"), "BUS_UNIT": c("business_unit"), "SITE": c("plant_site"),
    }
    names = ("raw_supplier_id", "raw_supplier_name", "invoice_number", "invoice_date", "raw_line_description", "payment_terms_days", "base_amount", "original_currency", "gl_account", "cost_centre", "raw_payment_terms", "po_number", "business_unit", "plant_site")
    return transactions(spark, sf_dir, *names).select(*[F.coalesce(v, F.lit("")).alias(k) for k, v in texts.items()])


#: The same export for DuckDB, as the common table expression ``x`` behind ``t``.
EXPORT_SQL = f"""x AS (
  SELECT coalesce(trim(raw_supplier_name || ' ' || {list(FORMS)!r}[regexp_extract(raw_supplier_id, '[0-9]+')::INT % {len(FORMS)} + 1]), '') AS VENDOR_NAME, raw_supplier_id AS VENDOR_NUM, invoice_number AS INV_NO,
    CASE regexp_extract(invoice_number, '[0-9]+')::BIGINT % 3 WHEN 0 THEN strftime(invoice_date, '%Y-%m-%d') WHEN 1 THEN strftime(invoice_date, '%d/%m/%Y') ELSE strftime(invoice_date, '%d-%b-%Y') END AS INV_DATE,
    coalesce(raw_line_description || {_CASE("payment_terms_days", SAID)}, '') AS LINE_DESC, base_amount::VARCHAR AS AMT, original_currency AS CCY, gl_account AS GL_CODE, coalesce(cost_centre, '') AS COST_CTR,
    coalesce(raw_payment_terms, '') AS PAY_TERMS, coalesce(po_number, '') AS PO_NUM, coalesce(business_unit, '') AS BUS_UNIT, plant_site AS SITE FROM t
)"""
