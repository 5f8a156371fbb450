"""Thresholds of the engine; every operator takes them as an argument."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    base_currency: str = "AUD"
    fuzzy_auto: float = 88.0
    fuzzy_review: float = 70.0
    vector_auto: float = 0.90
    vector_review: float = 0.80
    same_city: int = 5
    same_postcode: int = 8
    same_abn: int = 20
    supplier_review_below: float = 0.60
    confidence_high: float = 0.85
    confidence_medium: float = 0.60
    category_similarity: float = 0.80
    category_ambiguous: float = 0.05
    category_ambiguous_above: float = 0.70
    tail_share: float = 0.80
    consolidation_above: int = 5
    target_payment_days: int = 45
    wacc: float = 0.08
    least_working_capital: float = 10_000.0
    tail_alert: float = 0.05
    maverick_alert: float = 0.15
    tender_spend: float = 50_000.0
    coverage_spend: float = 20_000.0
    coverage_share: float = 0.50
    concentration_share: float = 0.80
    least_discount: float = 1_000.0
    least_priced_rows: int = 5
    many_priced_rows: int = 20
    savings_limit: float = 0.20

    def overlaid(self, overrides: dict[str, Any] | None) -> Settings:
        """With a tenant's overrides; names that are no setting are ignored, null values too."""
        known = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in (overrides or {}).items() if k in known and v is not None})


DEFAULT = Settings()
