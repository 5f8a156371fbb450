"""Savings recommendations: nine rules, their rates, and the allocation of spend among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import reference
from outlay.config import DEFAULT, Settings
from outlay.functions import numbers
from outlay.operators.filters import addressable_rows
from outlay.operators.prefix import with_running
from outlay.operators.segments import flag_tail
from outlay.sources.scratch import stored

COLUMNS = ("type", "context", "evidence", "estimated_impact", "confidence", "action", "lever", "baseline_spend", "addressability_pct", "saving_pct", "addressable_baseline")
_MONEY = "decimal(18,2)"


def rates(lever: str, category: Column | None = None) -> tuple[Column, Column]:
    """(saving, addressable share): the category's row, else the lever's, else none and a fixed share. Rows are taken whole."""
    default = next(((s, a) for k, s, a in reference.SAVINGS if k == lever), (None, reference.ADDRESSABLE_OTHERWISE))
    saving, share = (F.lit(x).cast("double") for x in default)
    if category is None:
        return saving, share
    own = [(c, s, a) for c, k, s, a in reference.CATEGORY_SAVINGS if k == lever]
    for c, s, a in own:
        saving, share = F.when(category == c, F.lit(s).cast("double")).otherwise(saving), F.when(category == c, F.lit(a).cast("double")).otherwise(share)
    return saving, share


def _whole(c: Column) -> Column:
    """1,234,567."""
    return F.format_number(F.bround(c, 0), 0)


def _pct(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(F.bround(c * 100, digits), digits), F.lit("%"))


def _said(*parts: str | Column) -> Column:
    """Words and values in turn, as one text."""
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _finish(rows: DataFrame, type_: str, confidence, lever: str, context: Column, evidence: Column, impact: Column, action: Column, baseline: Column, share: Column, saving: Column, addressable_: Column) -> DataFrame:
    return rows.select(
        F.lit(type_).alias("type"), context.cast("string").alias("context"), evidence.alias("evidence"), F.round(impact, 2).alias("estimated_impact"),
        (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), action.alias("action"), F.lit(lever).alias("lever"), F.round(baseline, 2).alias("baseline_spend"),
        share.alias("addressability_pct"), saving.cast("double").alias("saving_pct"), F.round(addressable_, 2).alias("addressable_baseline"),
    )


#: What each rule pulls, by type.
LEVERS = {
    "SUPPLIER_CONSOLIDATION": "Supplier Consolidation",
    "PAYMENT_TERM_EXTENSION": "Working Capital",
    "COMPETITIVE_TENDER": "Competitive Sourcing",
    "CONTRACT_COVERAGE_GAP": "Contract Coverage",
    "SPEND_CONCENTRATION_RISK": "Supply Risk Management",
    "EARLY_PAYMENT_DISCOUNT_CAPTURE": "Early Payment Discount",
    "BEST_PRICE_EXTRAPOLATION": "Best Price Extrapolation",
    "TAIL_SPEND_RATIONALISATION": "Tail Spend Rationalisation",
    "CONTRACT_COMPLIANCE": "Contract Compliance",
}
_KEYS = ("canonical_supplier_id", "category_l1", "category_l2", "category_l3")
#: All columns that ``cells`` looks at.
READ = (*_KEYS, "canonical_supplier_name", "is_intercompany", "is_tax_line", "base_amount", "unit_price", "payment_terms_days", "has_early_payment_discount", "discount_percent", "is_on_contract", "po_number")


def cells(df: DataFrame) -> DataFrame:
    """Transactions summed up by supplier, its name and category: all that the rules need, in one pass; cells are returned as they are.
    The name is a key, as the least of texts would sort all rows; what reads cells sums several of one supplier.

    Keys and sums whose columns ``df`` lacks are left out, and with them the rules that need them.
    """
    if "cell_rows" in df.columns:
        return df
    have, c = set(df.columns), F.col
    rows = addressable_rows()
    amount = c("base_amount").cast(_MONEY)
    priced = rows & (c("unit_price") > 0)
    known = rows & c("payment_terms_days").isNotNull()
    offered = rows & (c("has_early_payment_discount") == 1) & (c("discount_percent") > 0)
    off_contract = F.coalesce(c("is_on_contract"), F.lit(0)) != 1 if "is_on_contract" in have else F.lit(True)
    price, percent = c("unit_price").cast(_MONEY), c("discount_percent").cast("decimal(7,4)")
    sums: dict[str, tuple[set[str], Column]] = {
        "cell_rows": (set(), F.count_if(rows)),
        "spend": (set(), F.sum(F.when(rows, amount))),
        "all_spend": (set(), F.sum(amount)),
                "covered": ({"is_on_contract"}, F.sum(F.when(rows & (c("is_on_contract") == 1), amount))),
        "maverick": ({"po_number"}, F.sum(F.when(rows & c("po_number").isNull() & off_contract, amount))),
        "terms_rows": ({"payment_terms_days"}, F.count_if(known)),
        "terms_sum": ({"payment_terms_days"}, F.sum(F.when(known, c("payment_terms_days")))),
        "terms_spend": ({"payment_terms_days"}, F.sum(F.when(known, amount))),
        "discount_rows": ({"has_early_payment_discount", "discount_percent"}, F.count_if(offered)),
        "discount_sum": ({"has_early_payment_discount", "discount_percent"}, F.sum(F.when(offered, percent))),
        "discount_spend": ({"has_early_payment_discount", "discount_percent"}, F.sum(F.when(offered, amount))),
        "gain": ({"has_early_payment_discount", "discount_percent"}, F.sum(F.when(offered, amount * percent / 100))),
        "priced_rows": ({"unit_price"}, F.count_if(priced)),
        "price_sum": ({"unit_price"}, F.sum(F.when(priced, price))),
        "best_price": ({"unit_price"}, F.min(F.when(priced, price))),
    }
    out = df.groupBy(*[k for k in (*_KEYS, "canonical_supplier_name") if k in have]).agg(*[v.alias(k) for k, (needs, v) in sums.items() if needs <= have])
    return out.withColumnRenamed("canonical_supplier_name", "name")


def _by_name(rows: DataFrame, keys: list, sums: dict[str, str], name: bool) -> DataFrame:
    """Sums by ``keys`` and the least name: by name too first, by hashing, so that only a few rows a key are sorted."""
    if not name:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.lit(None).cast("string").alias("name"))
    first = rows.groupBy(*keys, "name").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    again = [k if isinstance(k, str) else "category" for k in keys]
    return first.groupBy(*again).agg(*[F.sum(k).alias(k) for k in sums], F.min("name").alias("name"))


def _double(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("double")


def _by_category(df: DataFrame, category: str) -> DataFrame:
    """Each category with its suppliers' number, spend and largest supplier."""
    rows = cells(df).where((F.col("cell_rows") > 0) & F.col(category).isNotNull())
    each = _by_name(rows, [F.col(category).alias("category"), "canonical_supplier_id"], {"spend": "spend"}, "name" in rows.columns)
    known = F.col("canonical_supplier_id").isNotNull()
    top = F.max_by(F.struct("spend", F.coalesce("name", "canonical_supplier_id").alias("name")), F.when(known, F.struct("spend", "canonical_supplier_id")))
    out = each.groupBy("category").agg(F.count("canonical_supplier_id").alias("suppliers"), F.sum("spend").cast("double").alias("spend"), top.alias("top"))
    return out.select("category", "suppliers", "spend", F.col("top.name").alias("top_name"), F.col("top.spend").cast("double").alias("top_spend"))


def portfolio_figures(df: DataFrame) -> DataFrame:
    """One row: the key figures that rules over the whole portfolio look at (see ``kpis``)."""
    known = cells(df).groupBy("canonical_supplier_id").agg(F.sum("cell_rows").alias("rows"), F.sum("spend").alias("spend"), F.sum("all_spend").alias("all_spend"), F.sum("maverick").alias("maverick"))
    known = stored(known, "suppliers")
    running = with_running(known.where("canonical_supplier_id is not null and rows > 0").select("canonical_supplier_id", "spend", "all_spend"), "spend", "canonical_supplier_id")
    tail = flag_tail(running).where("is_tail_spend").agg(F.sum("all_spend").alias("tail"), F.count(F.lit(1)).alias("tail_supplier_count"))
    whole = known.agg(_double("spend").alias("total_spend"), _double("all_spend").alias("everything"), _double("maverick").alias("maverick"))
    share = lambda a, b: F.round(numbers.ratio(F.coalesce(a, F.lit(0)), b), 4)
    return whole.join(F.broadcast(tail)).select(
        "total_spend", share(F.col("maverick"), F.col("total_spend")).alias("maverick_spend_pct"), share(F.col("tail"), F.col("everything")).alias("tail_spend_pct"), "tail_supplier_count"
    )


def consolidation(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    rows = _by_category(df, "category_l2").where((F.col("suppliers") > s.consolidation_above) & (F.col("spend") > 0))
    c, spend = F.col("category"), F.col("spend")
    saving, share = rates("SUPPLIER_CONSOLIDATION", c)
    n = F.col("suppliers").cast("string")
    evidence = _said("suppliers", n, "share of the largest", _pct(F.col("top_spend") / spend, 1), "addressable", _pct(share))
    action = _said("Keep two or three of", n, "suppliers for", c)
    return _finish(rows, "SUPPLIER_CONSOLIDATION", "HIGH", "Supplier Consolidation", c, evidence, spend * share * saving, action, spend, share, saving, spend * share)


def term_extension(df: DataFrame, s: Settings = DEFAULT, top: int = 50) -> DataFrame:
    rows = cells(df).where("terms_rows > 0 and canonical_supplier_id is not null")
    rows = _by_name(rows, ["canonical_supplier_id"], {c: c for c in ("terms_spend", "terms_sum", "terms_rows")}, "name" in rows.columns)
    rows = rows.select("canonical_supplier_id", F.coalesce("terms_spend", F.lit(0)).cast("double").alias("spend"), (F.col("terms_sum") / F.col("terms_rows")).alias("terms"), "name")
    rows = rows.orderBy(F.desc("spend"), "canonical_supplier_id").limit(top).where(F.col("terms") < s.target_payment_days)
    _, share = rates("PAYMENT_TERM_EXTENSION")
    base = F.col("spend") * share
    impact = (s.target_payment_days - F.col("terms")) / 365.0 * base * s.wacc
    name, days = F.coalesce("name", "canonical_supplier_id"), F.format_number(F.bround("terms", 0), 0)
    evidence = _said("days now", days, "days wanted", F.lit(str(s.target_payment_days)))
    action = _said("Ask", name, "to be paid after", F.lit(str(s.target_payment_days)), "days, not", days)
    return _finish(rows.where(impact > s.least_working_capital), "PAYMENT_TERM_EXTENSION", "HIGH", "Working Capital", name, evidence, impact, action, F.col("spend"), share, F.lit(None), base)


def _portfolio(figures: DataFrame, column: str, alert: float, type_: str, lever: str, evidence: Column, action: Column) -> DataFrame:
    rows = figures.where(F.col(column) > alert)
    saving, share = rates(type_)
    spend = F.col("total_spend") * F.col(column)
    return _finish(rows, type_, "MEDIUM", lever, F.lit("Portfolio"), evidence, spend * share * saving, action, spend, share, saving, spend * share)


def tail_rationalisation(figures: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``figures`` is the row of key figures."""
    n = F.col("tail_supplier_count").cast("string")
    evidence = _said("suppliers in the tail", n, "their share of spend", _pct(F.col("tail_spend_pct"), 1))
    return _portfolio(figures, "tail_spend_pct", s.tail_alert, "TAIL_SPEND_RATIONALISATION", "Tail Spend Rationalisation", evidence, _said("Move the orders of", n, "small suppliers to larger ones", F.lit("where there are any")))


def contract_compliance(figures: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    evidence = _said("share of spend with neither order nor contract", _pct(F.col("maverick_spend_pct"), 1))
    return _portfolio(figures, "maverick_spend_pct", s.maverick_alert, "CONTRACT_COMPLIANCE", "Contract Compliance", evidence, F.lit("Pay only what has an order or a contract"))


def competitive_tender(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    rows = _by_category(df, "category_l2").where((F.col("suppliers") == 1) & (F.col("spend") > s.tender_spend))
    c, spend, name = F.col("category"), F.col("spend"), F.col("top_name")
    saving, share = rates("COMPETITIVE_TENDER", c)
    evidence = _said("only supplier", name, "spend", _whole(spend), "addressable", _pct(share))
    action = _said("Ask others than", name, "for offers in", c)
    return _finish(rows, "COMPETITIVE_TENDER", "HIGH", "Competitive Sourcing", c, evidence, spend * share * saving, action, spend, share, saving, spend * share)


def coverage_gap(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A table without ``is_on_contract`` has no cover."""
    rows = cells(df)
    covered = F.col("covered") if "covered" in rows.columns else F.lit(0)
    rows = rows.where((F.col("cell_rows") > 0) & F.col("category_l1").isNotNull()).groupBy(F.col("category_l1").alias("category"))
    rows = rows.agg(_double("spend").alias("spend"), F.coalesce(F.sum(covered), F.lit(0)).cast("double").alias("covered"))
    rows = rows.where(F.col("spend") > s.coverage_spend).withColumn("cover", F.col("covered") / F.col("spend")).where(F.col("cover") < s.coverage_share)
    c, spend, open_ = F.col("category"), F.col("spend"), F.col("spend") * (1.0 - F.col("cover"))
    saving, share = rates("CONTRACT_COVERAGE_GAP", c)
    evidence = _said("under contract", _pct(F.col("cover")), "spend", _whole(spend), "addressable of the rest", _pct(share))
    action = _said("Agree on contracts for most of", c)
    return _finish(rows, "CONTRACT_COVERAGE_GAP", "MEDIUM", "Contract Coverage", c, evidence, open_ * share * saving, action, spend, share, saving, open_ * share)


def concentration_risk(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    rows = _by_category(df, "category_l2").where((F.col("suppliers") > 1) & (F.col("spend") > s.tender_spend))
    part = F.col("top_spend") / F.col("spend")
    rows = rows.where(part > s.concentration_share)
    c, spend, name = F.col("category"), F.col("spend"), F.col("top_name")
    saving, share = rates("SPEND_CONCENTRATION_RISK", c)
    evidence = _said("share of", name, "is", _pct(part), "suppliers", F.col("suppliers").cast("string"), "addressable", _pct(share))
    action = _said("Buy part of", c, "from others than", name)
    return _finish(rows, "SPEND_CONCENTRATION_RISK", "MEDIUM", "Supply Risk Management", c, evidence, spend * share * saving, action, spend, share, saving, spend * share)


def discount_capture(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    rows = cells(df).where("discount_rows > 0 and canonical_supplier_id is not null")
    rows = _by_name(rows, ["canonical_supplier_id"], {c: c for c in ("discount_spend", "discount_sum", "discount_rows", "gain")}, "name" in rows.columns)
    none = F.lit(0)
    rows = rows.select("canonical_supplier_id", F.coalesce("discount_spend", none).cast("double").alias("spend"), (F.col("discount_sum").cast("double") / F.col("discount_rows")).alias("mean_pct"), F.coalesce("gain", none).cast("double").alias("gain"), "name")
    _, share = rates("EARLY_PAYMENT_DISCOUNT_CAPTURE")
    impact, name = F.col("gain") * share, F.coalesce("name", "canonical_supplier_id")
    evidence = _said("mean discount", F.concat(F.format_number(F.bround("mean_pct", 1), 1), F.lit("%")), "spend with a discount", _whole(F.col("spend")), "worth a year", _whole(impact))
    action = _said("Pay", name, "early enough for", F.lit("the discount"))
    return _finish(rows.where(impact > s.least_discount), "EARLY_PAYMENT_DISCOUNT_CAPTURE", "HIGH", "Early Payment Discount", name, evidence, impact, action, F.col("spend"), share, F.lit(None), F.col("gain"))


def best_price(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """By level-3 category, or by level 2 if no priced row has a level 3; one look decides, inside the plan."""
    rows = cells(df).where("cell_rows > 0")
    deep = rows.agg(F.coalesce(F.max(F.col("category_l3").isNotNull() & (F.col("priced_rows") > 0)), F.lit(False)).alias("_deep"))
    # ``deep`` has one row
    rows = rows.join(F.broadcast(deep)).withColumn("category", F.when(F.col("_deep"), F.col("category_l3")).otherwise(F.col("category_l2"))).where("category is not null")
    rows = rows.groupBy("category").agg(
        F.sum("priced_rows").alias("n"), F.countDistinct(F.when(F.col("priced_rows") > 0, F.col("canonical_supplier_id"))).alias("suppliers"), F.min("best_price").cast("double").alias("best"),
        (F.sum("price_sum").cast("double") / F.sum("priced_rows")).alias("mean"), _double("spend").alias("spend"),
    )
    rows = rows.where((F.col("n") >= s.least_priced_rows) & (F.col("suppliers") >= 2) & (F.col("mean") > F.col("best")) & (F.col("spend") > 0))
    _, share = rates("BEST_PRICE_EXTRAPOLATION")
    gap, base, c = (F.col("mean") - F.col("best")) / F.col("mean"), F.col("spend") * share, F.col("category")
    money = lambda x: F.format_string("%.2f", F.bround(x, 2))
    evidence = _said("best price", money(F.col("best")), "mean price", money(F.col("mean")), "gap", _pct(gap, 1), "suppliers", F.col("suppliers").cast("string"), "priced rows", F.col("n").cast("string"))
    action = _said("Buy", c, "at the best price", F.lit("seen"))
    confidence = F.when(F.col("n") >= s.many_priced_rows, "HIGH").otherwise("MEDIUM")
    return _finish(rows, "BEST_PRICE_EXTRAPOLATION", confidence, "Best Price Extrapolation", c, evidence, gap * base, action, F.col("spend"), share, F.lit(None), base)


def generate(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All rules' recommendations with the order of the rules, which decides between equal impacts. The transactions are read once, into stored cells."""
    df = df if "cell_rows" in df.columns else stored(cells(df), "cells")
    figures = portfolio_figures(df)
    parts = [consolidation(df, s), term_extension(df, s), tail_rationalisation(figures, s), contract_compliance(figures, s), competitive_tender(df, s), coverage_gap(df, s), concentration_risk(df, s), discount_capture(df, s), best_price(df, s)]
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("rule_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def allocate(recommendations: DataFrame) -> DataFrame:
    """Of recommendations that claim the same spend only the one with the largest impact stays.

    Those of a portfolio group share one pool, others a pool per context; unknown types claim
    nothing. Equal impacts: the rule that comes first, then the context. Without impact none stays.
    """
    group = F.lit(None).cast("string")
    for type_, name in reference.EXCLUSIVE.items():
        group = F.when(F.col("type") == type_, name).otherwise(group)
    pool = F.when(group.startswith("PORTFOLIO"), F.lit("PORTFOLIO")).otherwise(F.coalesce("context", F.lit("")))
    rows = recommendations.withColumns({"_group": group, "_pool": pool})
    first = rows.where("_group is not null").groupBy("_group", "_pool").agg(F.max_by(F.struct(*recommendations.columns), F.struct("estimated_impact", -F.col("rule_order"), F.col("evidence"))).alias("r")).select("r.*")
    return first.unionByName(rows.where("_group is null").select(*recommendations.columns)).where("estimated_impact <> 0")


def portfolio(allocated: DataFrame, df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row: total spend and savings, their ratio, and whether it is plausible. ``df``: transactions or their cells."""
    spend = cells(df).agg(_double("spend").alias("total_spend"))
    savings = allocated.agg(F.round(F.coalesce(F.sum("estimated_impact"), F.lit(0.0)), 2).alias("total_savings"), F.count(F.lit(1)).alias("recommendations"))
    out = spend.join(F.broadcast(savings)).withColumn("savings_pct", F.round(numbers.ratio(F.col("total_savings"), F.col("total_spend")), 4))
    return out.withColumn("plausible", F.col("savings_pct") <= s.savings_limit)


def figures(allocated: DataFrame) -> DataFrame:
    return allocated.agg(F.round(F.coalesce(F.sum("estimated_impact"), F.lit(0.0)), 2).alias("impact"), F.count(F.lit(1)).alias("count"), F.count_if(F.col("confidence") == "HIGH").alias("high"), F.count_if(F.col("confidence") == "MEDIUM").alias("medium"))


def by_lever(allocated: DataFrame) -> DataFrame:
    return allocated.groupBy("lever").agg(F.round(F.sum("estimated_impact"), 2).alias("impact"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("impact"), "lever")


def priority_matrix(allocated: DataFrame) -> DataFrame:
    """Certainty, impact and size of each recommendation, for plotting."""
    c = F.col("confidence")
    certainty = F.when(c == "HIGH", 0.9).when(c == "MEDIUM", 0.6).otherwise(0.3)
    return allocated.select("type", "context", certainty.alias("certainty"), "estimated_impact", F.greatest(F.col("baseline_spend") / 1000, F.lit(100.0)).alias("size"))
