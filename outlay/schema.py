"""Column types of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = """transaction_id source_system source_file document_type invoice_number raw_supplier_name raw_supplier_id raw_line_description
cleaned_description original_currency base_currency gl_account cost_centre business_unit plant_site legal_entity vendor_country plant_country
raw_payment_terms harmonised_payment_term po_number contract_id canonical_supplier_id canonical_supplier_name parent_company_id
parent_company_name category_l1 category_l2 category_l3 unspsc_code category_method categorisation_status spend_type addressability
managed_status review_status reviewer review_notes abc_segment unit_of_measure raw_data source_row_hash engagement_id""".split()
_NUMBER = """original_amount fx_rate base_amount canonical_supplier_confidence category_confidence discount_percent
payment_term_confidence unit_price""".split()
_WHOLE = "source_row_number payment_terms_days discount_days".split()
_FLAG = """is_credit_note is_intercompany is_tax_line is_freight_line is_duplicate is_on_contract manual_override_flag
ai_classification_flag has_early_payment_discount""".split()

#: The wide fact table: one row per invoice line. Flags are 0, 1 or null.
TRANSACTION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in _NUMBER]
    + [T.StructField(c, T.IntegerType()) for c in _WHOLE + _FLAG]
    + [T.StructField(c, T.DateType()) for c in ("invoice_date", "review_date")]
    + [T.StructField(c, T.TimestampType()) for c in ("ingested_at", "last_modified_at")]
)
LANDING_SCHEMA = "source_row_hash string, engagement_id string, batch_id string, raw_supplier_name string, raw_supplier_id string, raw_line_description string, gl_account string, base_amount double, raw_data string, status string, ingested_at timestamp"
BATCH_SCHEMA = "batch_id string, engagement_id string, source_file string, rows long, new_rows long, duplicate_rows long, status string"
MATCH_LOG_SCHEMA = "raw_supplier_name string, raw_supplier_id string, canonical_supplier_id string, match_method string, confidence double, evidence string, review_status string"
MASTER_SCHEMA = "canonical_supplier_id string, canonical_name string, normalised_name string, parent_company_id string, parent_name string, identifiers string"
OVERRIDE_SCHEMA = "canonical_supplier_id string, gl_account string, override_l1 string, override_l2 string, override_l3 string, unspsc_code string, reviewer string, reason string, override_order long"
AUDIT_SCHEMA = "entity string, entity_id string, action string, before string, after string, actor string, at timestamp"

# The allowed values of the enumerated columns.
ENUMS = {
    "document_type": ("INVOICE", "CREDIT_NOTE"),
    "category_method": ("MANUAL", "GL_MAPPING", "SUPPLIER_MAPPING", "KEYWORD", "EMBEDDING", "LLM"),
    "review_status": ("PENDING", "APPROVED", "REJECTED", "OVERRIDDEN"),
    "confidence_band": ("HIGH", "MEDIUM", "LOW"),
    "abc_segment": ("A", "B", "C"),
    "raw_status": ("queued", "processed", "review_required"),
}
