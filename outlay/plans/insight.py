"""Queries behind pages and charts, and the savings rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.config import DEFAULT
from outlay.operators import presentation, recommend
from outlay.plans.book import Book
from outlay.plans.spend import _BUCKET, _CHECKED, _FIGURES, _KPI, _MONTH, _SUM, _TAIL, _TAIL_KPI, SPEND
from outlay.sources.scratch import stored
from outlay.sources.warehouse import TRANSACTIONS_SQL, transactions

book = Book()


def _add(name: str, columns: tuple[str, ...], operator, sql: str) -> None:
    book.add(name, lambda spark, sf_dir: operator(transactions(spark, sf_dir, *dict.fromkeys(columns))), f"WITH {TRANSACTIONS_SQL}{sql}")


# charts
_add("topn_other", ("canonical_supplier_name", *SPEND), lambda df: presentation.fold_tail(df, "canonical_supplier_name"), """, g AS (
  SELECT canonical_supplier_name AS name, sum(base_amount) AS spend, row_number() OVER (ORDER BY sum(base_amount) DESC, canonical_supplier_name) AS k FROM a WHERE canonical_supplier_name IS NOT NULL GROUP BY 1)
SELECT name, spend::DOUBLE AS total_spend, 0::BIGINT AS folded, '' AS folded_names FROM g WHERE k <= 8
UNION ALL SELECT 'Other', sum(spend)::DOUBLE, count(*), (SELECT string_agg(name, ', ' ORDER BY name) FROM g WHERE k BETWEEN 9 AND 38) FROM g WHERE k > 8 HAVING count(*) > 0""")
_UNITS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_cells = lambda key, values: ", ".join(f"coalesce(sum(base_amount) FILTER ({key} = '{v}'), 0)::DOUBLE AS \"{v}\"" for v in values)
_add("pivot_category_bu", ("category_l1", "business_unit", *SPEND), lambda df: presentation.pivot(df, "category_l1", "business_unit", list(_UNITS)), f" SELECT category_l1, {_cells('business_unit', _UNITS)} FROM a WHERE category_l1 IS NOT NULL AND business_unit IS NOT NULL GROUP BY 1")
_BANDS = ("0-14", "15-30", "31-45", "46-60", "60+", "Unknown")
_add("pivot_supplier_bucket", ("canonical_supplier_name", "payment_terms_days", *SPEND), presentation.supplier_bucket_pivot, f""", r AS (SELECT *, {_BUCKET} AS bucket FROM a WHERE canonical_supplier_name IS NOT NULL),
f AS (SELECT canonical_supplier_name FROM r GROUP BY 1 ORDER BY sum(base_amount) DESC, 1 LIMIT 20) SELECT canonical_supplier_name, {_cells('bucket', _BANDS)} FROM r JOIN f USING (canonical_supplier_name) GROUP BY 1""")
_add("terms_histogram", ("payment_terms_days", *SPEND), lambda df: presentation.histogram(df, "payment_terms_days"), f" SELECT (payment_terms_days // 5 * 5)::INT AS bin, count(*) AS rows, {_SUM} AS total_spend FROM a WHERE payment_terms_days IS NOT NULL GROUP BY 1")
_add("amount_bins", SPEND, lambda df: presentation.bins(df, "base_amount"), ", e AS (SELECT min(base_amount)::DOUBLE AS low, max(base_amount)::DOUBLE AS high FROM a) SELECT least(floor((base_amount::DOUBLE - low) / (high - low) * 20), 19)::INT AS bin, count(*) AS rows FROM a, e WHERE base_amount IS NOT NULL GROUP BY 1")
_add("boxplot_stats", ("category_l1", *SPEND), presentation.box_plot, """
SELECT category_l1, min(base_amount)::DOUBLE AS least, round(quantile_cont(base_amount::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(base_amount::DOUBLE, 0.5), 4) AS median, round(quantile_cont(base_amount::DOUBLE, 0.75), 4) AS q3,
  max(base_amount)::DOUBLE AS most, count(*) AS rows FROM a WHERE base_amount > 0 AND category_l1 IS NOT NULL GROUP BY 1""")
_OFTEN = "n AS (SELECT canonical_supplier_id, category_l1, row_number() OVER (PARTITION BY canonical_supplier_id ORDER BY count(*) DESC, category_l1) AS k FROM r WHERE category_l1 IS NOT NULL GROUP BY 1, 2)"
_add("terms_vs_category_median", ("canonical_supplier_id", "category_l1", "payment_terms_days", *SPEND), presentation.terms_against_median, f""", r AS (SELECT * FROM a WHERE payment_terms_days IS NOT NULL AND category_l1 IS NOT NULL AND canonical_supplier_id IS NOT NULL),
m AS (SELECT category_l1, median(payment_terms_days)::DOUBLE AS category_median FROM r GROUP BY 1), {_OFTEN}, e AS (SELECT canonical_supplier_id, round(avg(payment_terms_days), 4) AS mean_terms FROM r GROUP BY 1)
SELECT e.canonical_supplier_id, mean_terms, n.category_l1, category_median FROM e JOIN n ON n.canonical_supplier_id = e.canonical_supplier_id AND k = 1 JOIN m ON m.category_l1 = n.category_l1""")
_add("supplier_scatter_mode", ("canonical_supplier_id", "category_l1", "payment_terms_days", *SPEND), presentation.supplier_scatter, f""", r AS (SELECT * FROM a WHERE payment_terms_days IS NOT NULL AND canonical_supplier_id IS NOT NULL), {_OFTEN},
e AS (SELECT canonical_supplier_id, {_SUM} AS total_spend, round(avg(payment_terms_days), 4) AS mean_terms, count(*) AS rows FROM r GROUP BY 1) SELECT e.*, n.category_l1 FROM e LEFT JOIN n ON n.canonical_supplier_id = e.canonical_supplier_id AND k = 1""")
_later = lambda: F.when(F.col("po_number").isNull(), F.col("payment_terms_days") + 1).otherwise(F.col("payment_terms_days"))
_add("non_standard_terms", ("canonical_supplier_id", "po_number", "payment_terms_days", *SPEND), lambda df: presentation.non_standard_terms(df.withColumn("payment_terms_days", _later())), f"""
SELECT canonical_supplier_id, round(avg(payment_terms_days + 1), 4) AS mean_terms, {_SUM} AS total_spend, count(*) AS rows FROM a WHERE po_number IS NULL AND payment_terms_days IS NOT NULL AND canonical_supplier_id IS NOT NULL GROUP BY 1""")
_add("category_opportunity", ("category_l2", "canonical_supplier_id", *SPEND), presentation.category_opportunity, f" SELECT category_l2, {_SUM} AS total_spend, count(DISTINCT canonical_supplier_id) AS supplier_count, count(*) AS rows FROM a WHERE category_l2 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_supplier_id) >= 2")
_FRAGMENTED = "CASE WHEN supplier_count > 5 THEN 'Fragmented' WHEN supplier_count >= 3 THEN 'Moderate' ELSE 'Focused' END AS fragmentation"
_NAMED = "coalesce(category_l1, 'Uncategorised') AS l1, coalesce(category_l2, 'Uncategorised') AS l2"
_CATEGORIES = ("category_l1", "category_l2", "category_l3", "unspsc_code", "canonical_supplier_id", *SPEND)
_add("rollup_l1_l2", _CATEGORIES, presentation.category_rollup, f""", c AS (SELECT {_NAMED}, category_l3, unspsc_code, category_l1 AS c1, category_l2 AS c2, sum(base_amount) AS spend, count(*) AS n, count(DISTINCT canonical_supplier_id) AS s FROM a GROUP BY ALL),
r AS (SELECT l1, l2, sum(spend)::DOUBLE AS total_spend, sum(s)::BIGINT AS supplier_count, sum(n)::BIGINT AS transaction_count FROM c GROUP BY ROLLUP (l1, l2)) SELECT *, {_FRAGMENTED} FROM r WHERE l1 IS NOT NULL""")
_add("rollup_l1_l2_distinct", _CATEGORIES, lambda df: presentation.category_rollup(df, add_counts=False), f""", c AS (SELECT {_NAMED}, base_amount, canonical_supplier_id FROM a),
r AS (SELECT l1, l2, {_SUM} AS total_spend, count(DISTINCT canonical_supplier_id) AS supplier_count, count(*) AS transaction_count FROM c GROUP BY ROLLUP (l1, l2)) SELECT *, {_FRAGMENTED} FROM r WHERE l1 IS NOT NULL""")
_add("parent_groups", ("parent_company_name", "canonical_supplier_id", *SPEND), presentation.by_parent, f" SELECT coalesce(parent_company_name, 'Independent') AS parent, parent_company_name IS NULL AS independent, {_SUM} AS total_spend, count(DISTINCT canonical_supplier_id) AS supplier_count FROM a GROUP BY 1, 2")
_add("working_capital_table", ("canonical_supplier_id", "payment_terms_days", *SPEND), presentation.working_capital_table, """, e AS (SELECT canonical_supplier_id, sum(abs(base_amount))::DOUBLE AS gross_spend, avg(payment_terms_days) AS terms FROM a WHERE payment_terms_days IS NOT NULL AND canonical_supplier_id IS NOT NULL GROUP BY 1)
SELECT canonical_supplier_id, gross_spend, round(terms, 4) AS mean_terms, round(greatest(0.0::DOUBLE, (45 - terms) / 365.0::DOUBLE * gross_spend * 0.08::DOUBLE), 2) AS opportunity FROM e""")
_add("risk_flags", ("canonical_supplier_id", "category_l1", "po_number", *SPEND), presentation.risk_flags, """, e AS (
  SELECT canonical_supplier_id, sum(base_amount) AS spend, count(DISTINCT category_l1) AS categories, coalesce(sum(base_amount) FILTER (po_number IS NOT NULL), 0) AS with_po FROM a WHERE canonical_supplier_id IS NOT NULL GROUP BY 1)
SELECT canonical_supplier_id, spend::DOUBLE / (sum(spend) OVER ())::DOUBLE > 0.20 AS large_share, categories = 1 AS one_category, with_po::DOUBLE / spend::DOUBLE < 0.5 AS few_orders FROM e""")
_add("lever_flags", ("canonical_supplier_id", "category_l1", "po_number", "payment_terms_days", *SPEND), presentation.lever_flags, """, e AS (
  SELECT category_l1, canonical_supplier_id, sum(base_amount) AS spend FROM a WHERE category_l1 IS NOT NULL GROUP BY 1, 2), m AS (
  SELECT category_l1, max(spend) FILTER (canonical_supplier_id IS NOT NULL) AS largest FROM e GROUP BY 1), g AS (
  SELECT category_l1, count(DISTINCT canonical_supplier_id) AS n, sum(base_amount)::DOUBLE AS spend, coalesce(sum(base_amount) FILTER (po_number IS NULL), 0)::DOUBLE AS maverick, avg(payment_terms_days) AS terms FROM a WHERE category_l1 IS NOT NULL GROUP BY 1)
SELECT category_l1, n > 5 AS many_suppliers, maverick / spend > 0.15 AS maverick, coalesce(terms < 30, false) AS short_terms, coalesce(largest::DOUBLE / spend, 0) > 0.60 AS one_large_supplier FROM g JOIN m USING (category_l1)""")
_add("first_known_dimension", ("business_unit", "plant_site", "cost_centre", *SPEND), presentation.first_known_dimension, f" SELECT business_unit AS dimension, {_SUM} AS total_spend FROM a WHERE business_unit IS NOT NULL GROUP BY 1")
_add("split_donut", ("po_number", *SPEND), presentation.split_donut, f" SELECT CASE WHEN po_number IS NULL THEN 'No PO' ELSE 'PO' END AS label, {_SUM} AS total_spend FROM a GROUP BY 1")
_add("category_trend", ("category_l1", "invoice_date", *SPEND), lambda df: presentation.trend(df, "category_l1", "PROMO"), f" SELECT {_MONTH} AS invoice_month, {_SUM} AS total_spend FROM a WHERE category_l1 = 'PROMO' AND invoice_date IS NOT NULL GROUP BY 1")
_add("supplier_options", ("canonical_supplier_name", *SPEND), presentation.supplier_options, f", e AS (SELECT canonical_supplier_name, {_SUM} AS total_spend FROM a WHERE canonical_supplier_name IS NOT NULL GROUP BY 1) SELECT canonical_supplier_name || ' (' || format('{{:,}}', round_even(total_spend, 0)::BIGINT) || ')' AS label, total_spend FROM e")
_add("freshness", ("ingested_at",), presentation.freshness, " SELECT strftime(max(ingested_at), '%-d %B %Y') AS data_freshness FROM t")

# savings rules: what they find and what it is worth; their texts are tested apart
_RULE = ("type", "context", "estimated_impact", "confidence", "baseline_spend", "addressability_pct", "saving_pct", "addressable_baseline")
_LEVEL2 = ("canonical_supplier_id", "canonical_supplier_name", "category_l2", *SPEND)
_BY_CATEGORY = """k AS (SELECT category_l2 AS c, canonical_supplier_id AS s, sum(base_amount) AS spend FROM a WHERE category_l2 IS NOT NULL GROUP BY 1, 2),
g AS (SELECT c, count(s) AS n, sum(spend)::DOUBLE AS spend, (max(spend) FILTER (s IS NOT NULL))::DOUBLE AS top_spend FROM k GROUP BY 1)"""


def _found(type_: str, context: str, impact: str, baseline: str, share: float, saving: str, base: str, source: str, confidence: str = "'HIGH'") -> str:
    return f"SELECT '{type_}' AS type, {context} AS context, round({impact}, 2) AS estimated_impact, {confidence} AS confidence, round({baseline}, 2) AS baseline_spend, {share}::DOUBLE AS addressability_pct, {saving}::DOUBLE AS saving_pct, round({base}, 2) AS addressable_baseline FROM {source}"


def _saved(type_: str, share: float, saving: float, source: str, confidence: str = "'HIGH'") -> str:
    return _found(type_, "c", f"spend * {share}::DOUBLE * {saving}::DOUBLE", "spend", share, str(saving), f"spend * {share}::DOUBLE", source, confidence)


_NAME = "coalesce(name, s)"
_RULES = {
    "consolidation": (_LEVEL2, recommend.consolidation, "", _saved("SUPPLIER_CONSOLIDATION", 0.7, 0.08, "g WHERE n > 5 AND spend > 0")),
    "term_extension": (("canonical_supplier_id", "canonical_supplier_name", "payment_terms_days", *SPEND), recommend.term_extension,
        "te AS (SELECT canonical_supplier_id AS s, sum(base_amount)::DOUBLE AS spend, avg(payment_terms_days) AS terms, min(canonical_supplier_name) AS name FROM a WHERE payment_terms_days IS NOT NULL AND canonical_supplier_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)",
        _found("PAYMENT_TERM_EXTENSION", _NAME, "(45 - terms) / 365.0::DOUBLE * (spend * 0.8::DOUBLE) * 0.08::DOUBLE", "spend", 0.8, "NULL", "spend * 0.8::DOUBLE", "te WHERE terms < 45 AND (45 - terms) / 365.0::DOUBLE * (spend * 0.8::DOUBLE) * 0.08::DOUBLE > 10000")),
    "tail": ((*_KPI, *_CHECKED), lambda df: recommend.tail_rationalisation(recommend.portfolio_figures(df)), f"{_TAIL}, tk AS ({_TAIL_KPI}), fg AS ({_FIGURES}), tp AS (SELECT 'Portfolio' AS c, total_spend * tail_spend_pct AS spend FROM tk, fg WHERE tail_spend_pct > 0.05)", _saved("TAIL_SPEND_RATIONALISATION", 0.5, 0.1, "tp", "'MEDIUM'")),
    "compliance": ((*_KPI, *_CHECKED), lambda df: recommend.contract_compliance(recommend.portfolio_figures(df)), "mp AS (SELECT 'Portfolio' AS c, total_spend * maverick_spend_pct AS spend FROM (" + _FIGURES + ") WHERE maverick_spend_pct > 0.15)", _saved("CONTRACT_COMPLIANCE", 0.75, 0.05, "mp", "'MEDIUM'")),
    "tender": (_LEVEL2, recommend.competitive_tender, "", _saved("COMPETITIVE_TENDER", 0.65, 0.07, "g WHERE n = 1 AND spend > 50000")),
    "coverage_gap": (("category_l1", "is_on_contract", *SPEND), recommend.coverage_gap,
        "cg AS (SELECT *, covered / spend AS cover, spend * (1.0::DOUBLE - covered / spend) AS open FROM (SELECT category_l1 AS c, sum(base_amount)::DOUBLE AS spend, coalesce(sum(base_amount) FILTER (is_on_contract = 1), 0)::DOUBLE AS covered FROM a WHERE category_l1 IS NOT NULL GROUP BY 1))",
        _found("CONTRACT_COVERAGE_GAP", "c", "open * 0.8::DOUBLE * 0.05::DOUBLE", "spend", 0.8, "0.05", "open * 0.8::DOUBLE", "cg WHERE spend > 20000 AND cover < 0.5", "'MEDIUM'")),
    "concentration": (_LEVEL2, recommend.concentration_risk, "", _saved("SPEND_CONCENTRATION_RISK", 0.7, 0.04, "g WHERE n > 1 AND spend > 50000 AND top_spend / spend > 0.8", "'MEDIUM'")),
    "discount": (("canonical_supplier_id", "canonical_supplier_name", "has_early_payment_discount", "discount_percent", *SPEND), recommend.discount_capture,
        "dc AS (SELECT canonical_supplier_id AS s, sum(base_amount)::DOUBLE AS spend, (sum(base_amount * discount_percent)::DOUBLE / 100) AS gain, min(canonical_supplier_name) AS name FROM a WHERE has_early_payment_discount = 1 AND discount_percent > 0 AND canonical_supplier_id IS NOT NULL GROUP BY 1)",
        _found("EARLY_PAYMENT_DISCOUNT_CAPTURE", _NAME, "gain * 0.85::DOUBLE", "spend", 0.85, "NULL", "gain", "dc WHERE gain * 0.85::DOUBLE > 1000")),
    "best_price": (("canonical_supplier_id", "category_l2", "category_l3", "unit_price", *SPEND), recommend.best_price,
        "bp AS (SELECT category_l3 AS c, count(*) FILTER (unit_price > 0) AS n, count(DISTINCT canonical_supplier_id) FILTER (unit_price > 0) AS suppliers, (min(unit_price) FILTER (unit_price > 0))::DOUBLE AS best, (sum(unit_price) FILTER (unit_price > 0))::DOUBLE / count(*) FILTER (unit_price > 0) AS mean, coalesce(sum(base_amount), 0)::DOUBLE AS spend FROM a WHERE category_l3 IS NOT NULL GROUP BY 1)",
        _found("BEST_PRICE_EXTRAPOLATION", "c", "(mean - best) / mean * (spend * 0.75::DOUBLE)", "spend", 0.75, "NULL", "spend * 0.75::DOUBLE", "bp WHERE n >= 5 AND suppliers >= 2 AND mean > best AND spend > 0", "CASE WHEN n >= 20 THEN 'HIGH' ELSE 'MEDIUM' END")),
}
for _name, (_columns, _rule, _before, _sql) in _RULES.items():
    _cte = _BY_CATEGORY if _columns is _LEVEL2 else _before
    _add(f"rule_{_name}", _columns, lambda df, rule=_rule: rule(df).select(*_RULE), f", {_cte} {_sql}")

#: What cells are made of; columns that none of the rules looks at would bring orders and customers with them.
_EVERY = tuple(dict.fromkeys(c for columns, *_ in _RULES.values() for c in columns if c in recommend.READ))
_ALL = ", ".join(x for x in (_BY_CATEGORY, *[before for _, _, before, _ in _RULES.values()]) if x)
_UNION = " UNION ALL ".join(f"SELECT *, {i} AS rule_order FROM ({sql})" for i, (*_, sql) in enumerate(_RULES.values()))
_GROUPS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in recommend.reference.EXCLUSIVE.items())
_ALLOCATED = f"""{_ALL}, u AS ({_UNION}), p AS (SELECT *, CASE type {_GROUPS} END AS grp FROM u), q AS (
  SELECT *, row_number() OVER (PARTITION BY grp, CASE WHEN grp LIKE 'PORTFOLIO%' THEN 'PORTFOLIO' ELSE coalesce(context, '') END ORDER BY estimated_impact DESC, rule_order) AS k FROM p),
z AS (SELECT * FROM q WHERE k = 1 AND estimated_impact <> 0)"""


def _allocated(df):
    return recommend.allocate(recommend.generate(df))


def _portfolio(df):
    df = stored(recommend.cells(df), "cells")
    return recommend.portfolio(_allocated(df), df)


_add("allocate_recommendations", _EVERY, lambda df: _allocated(df).select(*_RULE), f", {_ALLOCATED} SELECT {', '.join(_RULE)} FROM z")
_add("savings_figures", _EVERY, lambda df: recommend.figures(_allocated(df)), f", {_ALLOCATED} SELECT round(coalesce(sum(estimated_impact), 0), 2) AS impact, count(*) AS count, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium FROM z")
_add("savings_portfolio", _EVERY, lambda df: _portfolio(df), f""", {_ALLOCATED}, y AS (SELECT {_SUM} AS total_spend, (SELECT round(coalesce(sum(estimated_impact), 0), 2) FROM z) AS total_savings, (SELECT count(*) FROM z) AS recommendations FROM a)
SELECT *, round(total_savings / total_spend, 4) AS savings_pct, round(total_savings / total_spend, 4) <= {DEFAULT.savings_limit} AS plausible FROM y""")
_add("priority_matrix", _EVERY, lambda df: recommend.priority_matrix(_allocated(df)), f", {_ALLOCATED} SELECT type, context, CASE confidence WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.6 ELSE 0.3 END::DOUBLE AS certainty, estimated_impact, greatest(baseline_spend / 1000, 100.0::DOUBLE) AS size FROM z")
