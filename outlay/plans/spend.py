"""Queries over the transactions table: cube, windows, key figures, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.config import DEFAULT
from outlay.operators import cube, filters, kpis, quality, segments
from outlay.plans.book import Book
from outlay.sources.warehouse import TRANSACTIONS_SQL, transactions

book = Book()
FLAGS = ("is_intercompany", "is_tax_line")
SPEND = ("base_amount", *FLAGS)
LINES = ("invoice_number", "po_number", "payment_terms_days", *SPEND)


def _add(name: str, columns: tuple[str, ...], operator, sql: str) -> None:
    book.add(name, lambda spark, sf_dir: operator(transactions(spark, sf_dir, *dict.fromkeys(columns))), f"WITH {TRANSACTIONS_SQL}{sql}")


_SUM = "coalesce(sum(base_amount), 0)::DOUBLE"
_MEASURES = f"{_SUM} AS total_spend, count(invoice_number) AS invoice_count, count(po_number) AS po_count, round(avg(payment_terms_days), 4) AS avg_payment_terms"
_BUCKET = "CASE WHEN payment_terms_days IS NULL OR payment_terms_days < 0 THEN 'Unknown' WHEN payment_terms_days <= 14 THEN '0-14' WHEN payment_terms_days <= 30 THEN '15-30' WHEN payment_terms_days <= 45 THEN '31-45' WHEN payment_terms_days <= 60 THEN '46-60' ELSE '60+' END"
_WIDE = "CASE WHEN payment_terms_days <= 30 THEN '0-30' WHEN payment_terms_days <= 60 THEN '31-60' WHEN payment_terms_days <= 90 THEN '61-90' ELSE '90+' END"
_MONTH = "strftime(invoice_date, '%Y-%m')"

# views of the cube
for _name, _keys in {"supplier": ("canonical_supplier_name", "parent_company_name"), "category": ("category_l1", "category_l2", "category_l3"), "bu": ("business_unit", "cost_centre")}.items():
    _add(f"cube_by_{_name}", (*_keys, *LINES), lambda df, name=f"by_{_name}": cube.cube(df)[name], f" SELECT {', '.join(_keys)}, {_MEASURES} FROM a GROUP BY {', '.join(_keys)}")
_add("cube_by_month", ("invoice_date", *LINES), lambda df: cube.cube(df)["by_month"], f" SELECT {_MONTH} AS invoice_month, {_MEASURES} FROM a GROUP BY 1")
_add("by_payment_terms_a", LINES, lambda df: cube.cube(df)["by_payment_terms"], f" SELECT {_BUCKET} AS payment_terms_bucket, {_MEASURES} FROM a GROUP BY 1")
_add("time_dimensions", ("invoice_date", *SPEND), lambda df: cube.with_time(df).groupBy("invoice_year", "invoice_quarter", "invoice_month").agg(F.count(F.lit(1)).alias("rows")), f" SELECT year(invoice_date)::INT AS invoice_year, year(invoice_date) || '-Q' || quarter(invoice_date) AS invoice_quarter, {_MONTH} AS invoice_month, count(*) AS rows FROM t GROUP BY ALL")

# pages
_add("overview_kpis", ("canonical_supplier_id", "category_l1", "invoice_date", "po_number", *SPEND), cube.overview, f"""
SELECT {_SUM} AS total_spend, count(*) AS invoice_count, count(DISTINCT canonical_supplier_id) AS supplier_count, count(DISTINCT category_l1) AS category_count,
  max(invoice_date) AS data_freshness, round(sum(CASE WHEN po_number IS NULL THEN base_amount ELSE 0 END)::DOUBLE / sum(base_amount)::DOUBLE, 4) AS maverick_spend_pct FROM a""")
_add("by_supplier_page", ("canonical_supplier_id", "canonical_supplier_name", "parent_company_name", "payment_terms_days", "invoice_date", *SPEND), lambda df: cube.supplier_page(df, limit=20, offset=5), f"""
SELECT *, (SELECT count(DISTINCT coalesce(canonical_supplier_id, '')) FROM a) AS total_count FROM (
  SELECT canonical_supplier_id, canonical_supplier_name, parent_company_name, {_SUM} AS total_spend, count(*) AS transaction_count, round(avg(payment_terms_days), 4) AS avg_payment_terms, max(invoice_date) AS last_invoice
  FROM a GROUP BY 1, 2, 3 ORDER BY total_spend DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 20 OFFSET 5)""")
_LINE = f"{_SUM} AS total_spend, count(*) AS transaction_count"
_add("by_category", ("category_l1", "category_l2", "category_l3", "unspsc_code", "canonical_supplier_id", *SPEND), cube.by_category, f" SELECT category_l1, category_l2, category_l3, unspsc_code, {_LINE}, count(DISTINCT canonical_supplier_id) AS supplier_count FROM a GROUP BY 1, 2, 3, 4")
_MONTHS = f"SELECT {_MONTH} AS invoice_month, {_LINE} FROM a WHERE invoice_date IS NOT NULL GROUP BY 1"
_add("by_month_rolling3", ("invoice_date", *SPEND), cube.by_month, f", m AS ({_MONTHS}) SELECT *, CASE WHEN count(*) OVER w = 3 THEN round(avg(total_spend) OVER w, 2) END AS rolling_3m FROM m WINDOW w AS (ORDER BY invoice_month ROWS 2 PRECEDING)")
_add("by_month_rolling3_partial", ("invoice_date", *SPEND), lambda df: cube.by_month(df, partial=True), f", m AS ({_MONTHS}) SELECT *, round(avg(total_spend) OVER w, 2) AS rolling_3m FROM m WINDOW w AS (ORDER BY invoice_month ROWS 2 PRECEDING)")
_add("by_payment_terms_b", ("payment_terms_days", *SPEND), cube.by_payment_terms, f""", b AS (
  SELECT {_WIDE} AS bucket, {_LINE} FROM t WHERE payment_terms_days IS NOT NULL AND coalesce(is_intercompany, 0) = 0 GROUP BY 1)
SELECT *, round(total_spend / sum(total_spend) OVER (), 4) AS spend_pct,
  round(greatest(0.0, (45 - CASE bucket WHEN '0-30' THEN 15 WHEN '31-60' THEN 46 WHEN '61-90' THEN 76 WHEN '90+' THEN 120 ELSE 45 END) / 365.0::DOUBLE * total_spend * 0.08::DOUBLE), 2) AS wc_opportunity FROM b""")
_add("by_bu", ("business_unit", "cost_centre", "canonical_supplier_id", *SPEND), cube.by_business_unit, f" SELECT business_unit, cost_centre, {_LINE}, count(DISTINCT canonical_supplier_id) AS supplier_count FROM t WHERE coalesce(is_intercompany, 0) = 0 GROUP BY 1, 2")
_add("by_legal_entity", ("legal_entity", "canonical_supplier_id", "category_l1", *SPEND), cube.by_legal_entity, f" SELECT legal_entity, {_LINE}, count(DISTINCT canonical_supplier_id) AS supplier_count, count(DISTINCT category_l1) AS category_count FROM a GROUP BY 1")
_add("by_currency", ("original_currency", *SPEND), cube.by_currency, f" SELECT original_currency, {_LINE}, sum(abs(base_amount))::DOUBLE AS gross_spend FROM a GROUP BY 1")
_add("by_country", ("vendor_country", "canonical_supplier_id", *SPEND), cube.by_country, f" SELECT vendor_country, {_LINE}, count(DISTINCT canonical_supplier_id) AS supplier_count, 'vendor' AS country_type FROM a WHERE vendor_country IS NOT NULL GROUP BY 1")
_QUALITY = ("transaction_id", "raw_supplier_name", "base_amount", "category_l1", "category_method", "category_confidence")
_add("cat_quality_totals", _QUALITY, cube.categorisation_totals, " SELECT count(*) AS total_transactions, count(*) FILTER (category_confidence >= 0.6) AS categorised_count, count(*) - count(*) FILTER (category_confidence >= 0.6) AS uncategorised_count, round(count(*) FILTER (category_confidence >= 0.6) / count(*), 4) AS categorised_pct FROM t")
_add("cat_quality_method", _QUALITY, cube.categorisation_methods, f" SELECT category_method AS method, count(*) AS count, {_SUM} AS spend, round(avg(category_confidence), 4) AS avg_confidence FROM t WHERE category_method IS NOT NULL GROUP BY 1")
_add("cat_quality_band", _QUALITY, cube.categorisation_bands, f" SELECT CASE WHEN category_confidence >= 0.85 THEN 'HIGH' WHEN category_confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS count, {_SUM} AS spend FROM t WHERE category_confidence IS NOT NULL GROUP BY 1")
_add("cat_quality_backlog", _QUALITY, cube.categorisation_backlog, " SELECT transaction_id, raw_supplier_name, base_amount::DOUBLE AS base_amount, category_l1, category_confidence FROM t WHERE category_confidence < 0.6 OR category_confidence IS NULL ORDER BY abs(base_amount) DESC, transaction_id LIMIT 50")
_add("summary_top10", ("canonical_supplier_name", *SPEND), lambda df: cube.largest(df, "canonical_supplier_name"), f" SELECT canonical_supplier_name, {_SUM} AS total_spend FROM a WHERE canonical_supplier_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def _by_view(df):
    df.createOrReplaceTempView("v_transactions")
    return df.sparkSession.sql("SELECT category_l1, business_unit, CAST(SUM(base_amount) AS DOUBLE) AS total_spend, COUNT(*) AS transaction_count FROM v_transactions WHERE COALESCE(is_intercompany, 0) = 0 AND COALESCE(is_tax_line, 0) = 0 GROUP BY category_l1, business_unit HAVING COUNT(*) > 1")


_add("sql_view_having", ("category_l1", "business_unit", *SPEND), _by_view, f" SELECT category_l1, business_unit, {_LINE} FROM a GROUP BY 1, 2 HAVING count(*) > 1")

# filters
_SPEC = filters.FilterSpec(date_from="1996-03-01", date_to="1999-12-31", business_units=("BUILDING", "MACHINERY"), category_l1s=("PROMO", "SMALL", "LARGE"), currencies=("AUD", "USD", "EUR"), supplier_text="#0000000", least_confidence=0.2, terms_buckets=("0-30", "31-60"))
_add("global_filters", ("invoice_date", "business_unit", "category_l1", "original_currency", "canonical_supplier_name", "category_confidence", "payment_terms_days", *SPEND), lambda df: cube.by(filters.apply_filters(df, _SPEC), ["category_l1"]), f"""
SELECT category_l1, {_LINE} FROM a WHERE invoice_date BETWEEN DATE '1996-03-01' AND DATE '1999-12-31' AND business_unit IN ('BUILDING', 'MACHINERY') AND category_l1 IN ('PROMO', 'SMALL', 'LARGE')
  AND original_currency IN ('AUD', 'USD', 'EUR') AND contains(lower(canonical_supplier_name), '#0000000') AND category_confidence >= 0.2 AND payment_terms_days <= 60 GROUP BY 1""")
_add("filter_options", ("category_l2",), lambda df: filters.options(df, "category_l2"), " SELECT DISTINCT category_l2 FROM t WHERE category_l2 IS NOT NULL")
_add("drill_down", ("category_l1", "category_l2", "category_l3", *SPEND), lambda df: cube.by(filters.apply_filters(df, filters.FilterSpec(category_l1s=("PROMO",), category_l2s=("Brand#4", "Brand#17"))), ["category_l3"]), f" SELECT category_l3, {_LINE} FROM a WHERE category_l1 = 'PROMO' AND category_l2 IN ('Brand#4', 'Brand#17') GROUP BY 1")
_add("confidence_split", ("category_confidence", "base_amount"), lambda df: filters.split_by_confidence(df)[0].agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("sure")).union(filters.split_by_confidence(df)[1].agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("review"))), " SELECT count(*) AS rows, CASE WHEN coalesce(category_confidence, 0) >= 0.6 THEN 'sure' ELSE 'review' END AS part FROM t GROUP BY 2")
_add("category_review_queue", ("category_confidence", "base_amount"), lambda df: df.where(filters.needs_category_review(with_nulls=False)).agg(F.count(F.lit(1)).alias("rows")), " SELECT count(*) AS rows FROM t WHERE category_confidence < 0.6")
for _check, _where in {
    "missing_supplier_name": "raw_supplier_name IS NULL", "unresolved_suppliers": "canonical_supplier_id IS NULL", "negative_reversal_lines": "base_amount < 0",
    "missing_contract_linkage": "po_number IS NULL AND contract_id IS NULL", "missing_bu_cost_centre": "business_unit IS NULL AND cost_centre IS NULL",
}.items():
    _add(f"problem_rows_{_check}", ("transaction_id", "raw_supplier_name", "canonical_supplier_id", "base_amount", "po_number", "contract_id", "business_unit", "cost_centre"), lambda df, c=_check: filters.problem_rows(df, c).select("transaction_id"), f" SELECT transaction_id FROM t WHERE {_where}")

# windows
_SUPPLIERS = "s AS (SELECT canonical_supplier_id, sum(base_amount) AS spend FROM a WHERE canonical_supplier_id IS NOT NULL GROUP BY 1)"
_TENANT = "s AS (SELECT engagement_id, canonical_supplier_id, sum(base_amount) AS spend FROM a WHERE canonical_supplier_id IS NOT NULL GROUP BY 1, 2)"
for _name, _ties in {"abc_rows": False, "abc_range": True}.items():
    _frame = "ORDER BY spend DESC" + ("" if _ties else ", canonical_supplier_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    _add(_name, ("engagement_id", "canonical_supplier_id", *SPEND), lambda df, t=_ties: segments.abc(df, t), f""", {_TENANT}, c AS (
  SELECT *, (sum(spend) OVER (PARTITION BY engagement_id {_frame}))::DOUBLE / (sum(spend) OVER (PARTITION BY engagement_id))::DOUBLE AS share FROM s)
SELECT engagement_id, canonical_supplier_id, spend::DOUBLE AS total_spend, round(share, 6) AS cumulative_pct, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_segment FROM c""")
_TAIL = f"""{_SUPPLIERS}, o AS (
  SELECT *, coalesce(sum(spend) OVER (ORDER BY spend DESC, canonical_supplier_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before, (sum(spend) OVER ())::DOUBLE AS everything, count(*) OVER () AS n FROM s
), f AS (SELECT canonical_supplier_id, spend::DOUBLE AS total_spend, CASE WHEN n < 10 THEN spend::DOUBLE < (SELECT median(spend::DOUBLE) FROM s) ELSE before / everything >= 0.8 END AS is_tail_spend FROM o)"""
_add("tail_flag", ("canonical_supplier_id", *SPEND), segments.tail, f", {_TAIL} SELECT * FROM f")
_TAIL_KPI = "SELECT round(sum(CASE WHEN is_tail_spend THEN base_amount ELSE 0 END)::DOUBLE / (SELECT sum(base_amount) FROM t)::DOUBLE, 4) AS tail_spend_pct, count(DISTINCT canonical_supplier_id) FILTER (is_tail_spend) AS tail_supplier_count FROM t LEFT JOIN f USING (canonical_supplier_id)"
_add("tail_kpi", ("canonical_supplier_id", *SPEND), kpis.tail_figures, f", {_TAIL} {_TAIL_KPI}")
_add("tail_share_page", ("canonical_supplier_id", *SPEND), segments.tail_share, """, s AS (SELECT canonical_supplier_id, sum(base_amount) AS spend FROM a GROUP BY 1), o AS (
  SELECT *, coalesce(sum(spend) OVER (ORDER BY spend DESC, canonical_supplier_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before, (sum(spend) OVER ())::DOUBLE AS everything FROM s)
SELECT round(coalesce(sum(spend) FILTER (before >= 0.8 * everything), 0)::DOUBLE / max(everything), 4) AS tail_spend_pct FROM o""")
_ORDERED = f"{_SUPPLIERS}, o AS (SELECT *, row_number() OVER w AS rank, (sum(spend) OVER w)::DOUBLE AS until, (sum(spend) OVER ())::DOUBLE AS everything FROM s WINDOW w AS (ORDER BY spend DESC, canonical_supplier_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_top = lambda n: f"round(coalesce(sum(spend) FILTER (rank <= {n}), 0)::DOUBLE / max(everything), 4) AS top_{n}_pct"
_add("concentration_hhi_pareto", ("canonical_supplier_id", *SPEND), segments.concentration, f", {_ORDERED} SELECT round(sum((spend::DOUBLE / everything) * (spend::DOUBLE / everything)) * 10000, 2) AS hhi, {_top(10)}, {_top(20)}, {_top(50)}, least(count(*) FILTER (until / everything < 0.8) + 1, count(*)) AS pareto_80_count FROM o")
_add("pareto_curve", ("canonical_supplier_id", *SPEND), segments.pareto_curve, f", {_ORDERED} SELECT rank, canonical_supplier_id, spend::DOUBLE AS total_spend, round(until / everything * 100, 4) AS cumulative_pct FROM o")
_add("top20_own_share", ("canonical_supplier_id", *SPEND), segments.top_with_share, f", {_SUPPLIERS}, k AS (SELECT * FROM s ORDER BY spend DESC, canonical_supplier_id LIMIT 20) SELECT canonical_supplier_id, spend::DOUBLE AS total_spend, round((sum(spend) OVER (ORDER BY spend DESC, canonical_supplier_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / (sum(spend) OVER ())::DOUBLE * 100, 4) AS cumulative_pct FROM k")
_add("tenant_share", ("engagement_id", "canonical_supplier_id", *SPEND), segments.tenant_share, f", {_TENANT} SELECT engagement_id, canonical_supplier_id, spend::DOUBLE AS total_spend, round(spend::DOUBLE / (sum(spend) OVER (PARTITION BY engagement_id))::DOUBLE, 6) AS share FROM s")

# key figures
_KPI = ("canonical_supplier_id", "invoice_number", "is_on_contract", "po_number", "payment_terms_days", *SPEND)
_FIGURES = f"""SELECT {_SUM} AS total_spend, count(DISTINCT canonical_supplier_id) AS total_suppliers, count(DISTINCT invoice_number) AS total_invoices,
  round(sum(base_amount)::DOUBLE / count(DISTINCT invoice_number), 4) AS avg_transaction_size,
  round(coalesce(sum(base_amount) FILTER (is_on_contract = 1), 0)::DOUBLE / sum(base_amount)::DOUBLE, 4) AS contract_coverage_pct,
  round(coalesce(sum(base_amount) FILTER (po_number IS NULL AND coalesce(is_on_contract, 0) <> 1), 0)::DOUBLE / sum(base_amount)::DOUBLE, 4) AS maverick_spend_pct,
  round(sum(base_amount * payment_terms_days)::DOUBLE / (sum(base_amount) FILTER (payment_terms_days IS NOT NULL))::DOUBLE, 2) AS weighted_avg_payment_terms,
  round(count(*) FILTER (payment_terms_days IS NULL) / count(*), 4) AS pct_missing_payment_terms FROM a"""
_add("spend_figures", _KPI, kpis.spend_figures, f" {_FIGURES}")
_WC = "SELECT round(coalesce(sum(greatest(0.0, (45 - terms) / 365.0::DOUBLE * spend::DOUBLE * 0.08::DOUBLE)), 0.0), 2) AS working_capital_opportunity FROM (SELECT canonical_supplier_id, sum(base_amount) AS spend, avg(payment_terms_days) AS terms FROM a WHERE payment_terms_days IS NOT NULL AND canonical_supplier_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"
_add("wc_opportunity_top50", ("canonical_supplier_id", "payment_terms_days", *SPEND), kpis.working_capital, f" {_WC}")
_add("accounts_summary", ("canonical_supplier_id", "po_number", "payment_terms_days", "invoice_date", *SPEND), kpis.accounts_summary, f"""
SELECT round(coalesce(sum(base_amount) FILTER (po_number IS NOT NULL), 0)::DOUBLE / sum(base_amount)::DOUBLE, 4) AS po_coverage_pct, count(DISTINCT canonical_supplier_id) FILTER (payment_terms_days < 30) AS short_terms_suppliers,
  round(sum(abs(base_amount) * payment_terms_days)::DOUBLE / (sum(abs(base_amount)) FILTER (payment_terms_days IS NOT NULL))::DOUBLE, 2) AS gross_weighted_terms, round(sum(base_amount)::DOUBLE / count(DISTINCT {_MONTH}), 2) AS mean_month FROM a""")

# quality
_CHECKED = ("raw_supplier_name", "canonical_supplier_id", "category_l1", "base_amount", "payment_terms_days", "invoice_number", "raw_line_description", "po_number", "contract_id", "business_unit", "cost_centre")
_WEAK = "raw_line_description IS NULL OR lower(trim(raw_line_description)) IN ('misc', 'miscellaneous', 'services', 'payment', 'invoice', 'charges') OR "


def _checks(weak: str, names: str) -> str:
    spend = lambda c: f"coalesce(sum(abs(base_amount)) FILTER ({c}), 0)::DOUBLE"
    values = {
        "missing_supplier_name": ("count(*) FILTER (raw_supplier_name IS NULL)", "n", 1.0, 5.0), "uncategorised_spend": (spend("category_l1 IS NULL"), "spend", 5.0, 15.0),
        "unresolved_suppliers": (names, "names", 10.0, 25.0), "missing_payment_terms": (spend("payment_terms_days IS NULL"), "spend", 10.0, 30.0),
        "duplicate_invoice_risk": ("(SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM t WHERE invoice_number IS NOT NULL GROUP BY invoice_number, base_amount HAVING count(*) > 1))", "n", 0.5, 2.0),
        "negative_reversal_lines": ("count(*) FILTER (base_amount < 0)", "n", 3.0, 8.0), "weak_descriptions": (f"count(*) FILTER ({weak})", "n", 15.0, 30.0),
        "missing_contract_linkage": (spend("po_number IS NULL AND contract_id IS NULL"), "spend", 30.0, 60.0), "missing_bu_cost_centre": ("count(*) FILTER (business_unit IS NULL AND cost_centre IS NULL)", "n", 5.0, 15.0),
    }
    of = {"n": "count(*)", "spend": "sum(abs(base_amount))::DOUBLE", "names": "count(DISTINCT raw_supplier_name)"}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v})::DOUBLE AS v, ({of[o]})::DOUBLE AS whole, {a} AS first, {b} AS second FROM t" for k, (v, o, a, b) in values.items())
    return f""", v AS ({rows}), p AS (SELECT "check", round(v, 2) AS value, CASE WHEN whole = 0 THEN 0.0 ELSE round(v / whole * 100, 2) END AS pct, first, second FROM v), d AS (
  SELECT "check", value, pct, CASE WHEN "check" = 'negative_reversal_lines' THEN CASE WHEN pct < first THEN 'INFO' WHEN pct < second THEN 'WARN' ELSE 'ALERT' END WHEN pct < first THEN 'GREEN' WHEN pct < second THEN 'AMBER' ELSE 'RED' END AS status FROM p)"""


_BY_WORDS = _checks(_WEAK + r"len(string_split_regex(trim(raw_line_description), '\s+')) < 5", "max((SELECT count(*) FROM (SELECT raw_supplier_name FROM t WHERE raw_supplier_name IS NOT NULL GROUP BY 1 HAVING max(canonical_supplier_id) IS NULL)))")
_BY_CHARS = _checks(_WEAK + "length(trim(raw_line_description)) < 20", "max((SELECT count(DISTINCT raw_supplier_name) FROM t WHERE canonical_supplier_id IS NULL))")
_add("diagnostics_a", _CHECKED, quality.diagnose, f'{_BY_WORDS} SELECT * FROM d')
_add("diagnostics_sql", _CHECKED, lambda df: quality.diagnose(df, by_words=False), f'{_BY_CHARS} SELECT * FROM d')
_SCORE = "CASE WHEN status IN ('GREEN', 'INFO') THEN 100.0 WHEN status IN ('AMBER', 'WARN') THEN 50.0 ELSE 0.0 END"
_add("scorecard_score", _CHECKED, lambda df: quality.scorecard(df).select("overall_score"), f"{_BY_WORDS} SELECT round(avg({_SCORE}), 1) AS overall_score FROM d")
_KPI_SCORE = "SELECT round(avg(CASE status WHEN 'GREEN' THEN 100.0 WHEN 'AMBER' THEN 60.0 WHEN 'RED' THEN 20.0 ELSE 0.0 END), 1) AS data_quality_score FROM d"
_add("kpi_row", tuple(dict.fromkeys((*_KPI, *_CHECKED))), kpis.kpis, f"""{_BY_WORDS}, {_TAIL}, r AS (SELECT *, row_number() OVER w AS rank, (sum(total_spend::DECIMAL(18,2)) OVER w)::DOUBLE AS until, (sum(total_spend::DECIMAL(18,2)) OVER ())::DOUBLE AS everything FROM f WINDOW w AS (ORDER BY total_spend DESC, canonical_supplier_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM ({_FIGURES}), ({_TAIL_KPI}), (SELECT round(sum((total_spend / everything) * (total_spend / everything)) * 10000, 2) AS hhi, round((sum(total_spend::DECIMAL(18,2)) FILTER (rank <= 10))::DOUBLE / max(everything), 4) AS top_10_supplier_pct, least(count(*) FILTER (until / everything < 0.8) + 1, count(*)) AS pareto_80_supplier_count FROM r), ({_WC}), ({_KPI_SCORE})""")
_add("duplicate_rows", ("transaction_id", "invoice_number", "base_amount"), lambda df: quality.occurrences(df).where("occurrences > 1").select("transaction_id", "occurrences"), " SELECT transaction_id, n AS occurrences FROM (SELECT transaction_id, count(*) OVER (PARTITION BY invoice_number, base_amount) AS n FROM t WHERE invoice_number IS NOT NULL AND base_amount IS NOT NULL) WHERE n > 1")
_add("problem_rows_duplicates", ("transaction_id", "invoice_number", "base_amount"), lambda df: filters.problem_rows(df, "duplicate_invoice_risk").select("transaction_id", "occurrences"), " SELECT transaction_id, n AS occurrences FROM (SELECT transaction_id, count(*) OVER (PARTITION BY invoice_number, base_amount) AS n FROM t WHERE invoice_number IS NOT NULL AND base_amount IS NOT NULL) WHERE n > 1")


# the summary page, all from one pass
_SUMMED = ("canonical_supplier_id", "canonical_supplier_name", "category_l1", "category_l2", "invoice_date", "po_number", "payment_terms_days", *SPEND)
_WIDE = "CASE WHEN payment_terms_days <= 30 THEN '0-30' WHEN payment_terms_days <= 60 THEN '31-60' WHEN payment_terms_days <= 90 THEN '61-90' ELSE '90+' END"
for _frame, _sql in {
    "kpis": f" SELECT {_SUM} AS total_spend, count(*) AS invoice_count, max(invoice_date) AS data_freshness, count(DISTINCT canonical_supplier_id) AS supplier_count, count(DISTINCT category_l1) AS category_count, round_even(sum(CASE WHEN po_number IS NULL THEN base_amount ELSE 0 END)::DOUBLE / sum(base_amount)::DOUBLE, 4) AS maverick_spend_pct FROM a",
    "by_month": f", m AS ({_MONTHS}) SELECT *, CASE WHEN count(*) OVER w = 3 THEN round_even(avg(total_spend) OVER w, 2) END AS rolling_3m FROM m WINDOW w AS (ORDER BY invoice_month ROWS 2 PRECEDING)",
    "top_suppliers": f" SELECT canonical_supplier_id, canonical_supplier_name, {_LINE}, avg(payment_terms_days) AS avg_payment_days FROM a GROUP BY 1, 2 ORDER BY total_spend DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 10",
    "by_category": f" SELECT category_l1, category_l2, {_LINE}, count(DISTINCT canonical_supplier_id) AS supplier_count FROM a WHERE category_l1 IS NOT NULL GROUP BY 1, 2",
    "by_payment_terms": f""", b AS (SELECT {_WIDE} AS bucket, {_LINE} FROM a WHERE payment_terms_days IS NOT NULL GROUP BY 1)
SELECT *, round_even(total_spend / sum(total_spend) OVER (), 4) AS spend_pct, round_even(greatest(0, ({DEFAULT.target_payment_days} - CASE bucket WHEN '0-30' THEN 15 WHEN '31-60' THEN 46 WHEN '61-90' THEN 76 ELSE 120 END) / 365.0::DOUBLE * total_spend * {DEFAULT.wacc}::DOUBLE), 2) AS wc_opportunity FROM b""",
}.items():
    _add(f"summary_{_frame}", _SUMMED, lambda df, frame=_frame: cube.summary(df)[frame], _sql)
