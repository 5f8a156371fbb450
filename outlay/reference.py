"""Reference data that results depend on, as plain values, and readers for reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that stand for nothing.
NULL_TOKENS = ("", "N/A", "n/a", "NULL", "null", "None", "-", "#N/A", "nan")

# Words that mark a line.
INTERCOMPANY = ("INTERCOMPANY", "INTER-COMPANY", "INTRA-COMPANY", "INTERNAL -", "IC - ")
TAX = ("gst", "vat", "tax adj", "tax adjustment", "withholding tax")
FREIGHT = ("freight", "shipping charge", "delivery charge", "courier fee")
WEAK_DESCRIPTIONS = ("misc", "miscellaneous", "services", "payment", "invoice", "charges")

# Legal forms that are cut off the end of a supplier's name.
LEGAL_FORMS = (
    "pty ltd", "pty. ltd.", "pty. ltd", "p/l", "p.l.", "llc", "l.l.c.", "inc", "inc.", "incorporated", "ltd", "ltd.", "limited",
    "gmbh", "ag", "s.a.", "s.a.s.", "b.v.", "n.v.", "plc", "corp", "corp.", "corporation", "co", "co.", "company", "trust", "pty",
)

# Abbreviations in a supplier's name and what they stand for.
ABBREVIATIONS = {
    "aust": "australia", "intl": "international", "svcs": "services", "mgt": "management", "mgmt": "management", "dept": "department",
    "govt": "government", "tech": "technology", "eng": "engineering", "mfg": "manufacturing", "distrib": "distribution",
    "comms": "communications", "corp": "corporation", "assoc": "association", "fndtn": "foundation", "natl": "national",
    "fed": "federal", "qld": "queensland", "nsw": "new south wales", "vic": "victoria", "sa": "south australia",
    "wa": "western australia", "tas": "tasmania", "act": "australian capital territory", "nt": "northern territory",
    "soln": "solution", "solns": "solutions", "sys": "systems", "ops": "operations", "proc": "procurement",
    "admin": "administration", "fin": "finance", "hr": "human resources", "it": "information technology", "mktg": "marketing",
    "purch": "purchasing", "supp": "supplier", "dev": "development", "impl": "implementation",
}

# Keyword rules as (pattern, level 1, level 2, UNSPSC segment, confidence), in the order in which ties are decided.
KEYWORD_RULES = (
    ("toner|cartridge|ink cartridge|drum unit", "Office Supplies", "Print Consumables", "44", 0.82),
    ("printer|copier|multifunction device|mfd", "Office Supplies", "Equipment", "44", 0.78),
    ("stationery|office supply|office supplies|paper reams|envelopes|folders", "Office Supplies", "Stationery", "44", 0.82),
    ("catering|canteen|meal|lunch|breakfast|corporate dining|hospitality food", "Facilities", "Catering", "90", 0.82),
    ("vending machine|vending service", "Facilities", "Catering", "90", 0.78),
    ("cleaning|janitorial|housekeeping|sanitation services", "Facilities", "Cleaning", "47", 0.78),
    ("waste management|waste removal|recycling|rubbish collection", "Facilities", "Cleaning", "47", 0.75),
    ("security guard|guard services|patrol|manned guarding|security services", "Facilities", "Security", "92", 0.80),
    ("access control|cctv|electronic security|alarm system", "Facilities", "Security", "92", 0.78),
    ("hvac|air conditioning|plumbing|building maintenance|facilities maintenance", "Facilities", "Building Maintenance", "72", 0.80),
    ("electrical maintenance|electrician|switchboard", "Facilities", "Building Maintenance", "72", 0.78),
    ("electricity|electric bill|power bill|energy supply", "Facilities", "Utilities", "83", 0.80),
    ("gas supply|natural gas|lpg", "Facilities", "Utilities", "83", 0.80),
    ("water supply|water usage|water bill|utility|utilities", "Facilities", "Utilities", "83", 0.80),
    ("freight|shipping|sea freight|air freight|road freight|haulage", "Logistics", "Freight", "78", 0.82),
    ("courier|delivery|express delivery|parcel|despatch", "Logistics", "Courier", "78", 0.82),
    ("warehouse|warehousing|storage facility|3pl|third.party logistics|pick.and.pack", "Logistics", "Warehousing", "78", 0.78),
    ("fuel|petrol|diesel|vehicle fuel|bowser", "Logistics", "Fleet", "25", 0.78),
    ("fleet lease|vehicle lease|car lease|novated lease|fleet management", "Logistics", "Fleet", "25", 0.80),
    ("mobile phone|handset|telecom|telecommunications|phone fleet|sim card|data plan", "IT", "Telecoms", "43", 0.80),
    ("fixed line|landline|pbx|voip|internet service|broadband|isp", "IT", "Telecoms", "43", 0.80),
    ("laptop|desktop|workstation|computer hardware|notebook pc", "IT", "Hardware", "43", 0.80),
    ("server|rack|storage array|nas|san|networking hardware|switch|router", "IT", "Hardware", "43", 0.80),
    ("software licence|software license|subscription|saas|annual licence|microsoft licence", "IT", "Software", "43", 0.80),
    ("cloud|aws|azure|google cloud|gcp|cloud hosting|cloud infrastructure", "IT", "Cloud Services", "43", 0.82),
    ("managed service|helpdesk|service desk|it support|it consulting", "IT", "IT Services", "43", 0.78),
    ("legal|solicitor|barrister|law firm|legal fees|legal services", "Professional Services", "Legal", "80", 0.80),
    ("consulting|advisory|management consulting|strategy consulting|business advisory", "Professional Services", "Consulting", "80", 0.78),
    ("engineering services|civil engineering|structural engineering|environmental consulting", "Professional Services", "Engineering", "81", 0.78),
    ("market research|survey|focus group|feasibility study|research services", "Professional Services", "Research", "80", 0.75),
    ("recruit|recruitment agency|staffing agency|temp labour|job board|executive search", "HR", "Recruitment", "80", 0.78),
    ("labour hire|on-hire|contingent worker|contractor placement", "HR", "Temp Labour", "80", 0.80),
    ("training|workshop|learning and development|l&d|e-learning|online learning|certification", "HR", "Training", "86", 0.78),
    ("superannuation|salary packaging|employee assistance|eap|health insurance benefit", "HR", "Benefits", "84", 0.82),
    ("bank fee|bank charges|merchant fee|transaction fee|fx services|foreign exchange", "Finance", "Banking", "84", 0.80),
    ("insurance|professional indemnity|public liability|workers compensation|product liability", "Finance", "Insurance", "84", 0.82),
    ("audit|external audit|internal audit|accounting services|assurance services", "Finance", "Audit", "84", 0.80),
    ("tax advisory|corporate tax|gst advisory|transfer pricing|tax compliance", "Finance", "Tax Advisory", "84", 0.78),
    ("advertising|media buy|ad campaign|billboard|print advertisement", "Marketing", "Advertising", "80", 0.80),
    ("conference|event management|exhibition|sponsorship|trade show", "Marketing", "Events", "80", 0.78),
    ("signage|banner|display graphics|brochure|flyer|leaflet|marketing print", "Marketing", "Print", "44", 0.80),
    ("seo|sem|search engine|social media marketing|digital marketing|email marketing", "Marketing", "Digital", "43", 0.78),
    ("raw material|steel|aluminium|aluminum|plastic resin|chemical|copper", "Direct Materials", "Raw Materials", "11", 0.78),
    ("packaging|pallet|carton|corrugated|shrink wrap|flexible packaging|box", "Direct Materials", "Packaging", "31", 0.80),
    ("electronic component|circuit board|pcb|mechanical part|assembly|sub-assembly", "Direct Materials", "Components", "31", 0.80),
    ("capital equipment|manufacturing equipment|laboratory equipment|heavy machinery|plant purchase", "CAPEX", "Equipment", "40", 0.78),
    ("fit.out|fitout|refurbishment|office renovation|retail fitout|leasehold improvement", "CAPEX", "Fit-out", "72", 0.80),
    ("network infrastructure|server room|data centre|data center|end user computing|it infrastructure", "CAPEX", "IT Infrastructure", "43", 0.82),
)

# Fixed values: (lever, saving, addressable share), and the same by level-1 category.
SAVINGS = (
    ("SUPPLIER_CONSOLIDATION", 0.08, 0.70),
    ("COMPETITIVE_TENDER", 0.07, 0.65),
    ("CONTRACT_COVERAGE_GAP", 0.05, 0.80),
    ("TAIL_SPEND_RATIONALISATION", 0.10, 0.50),
    ("CONTRACT_COMPLIANCE", 0.05, 0.75),
    ("PAYMENT_TERM_EXTENSION", None, 0.80),
    ("SPEND_CONCENTRATION_RISK", 0.04, 0.70),
    ("EARLY_PAYMENT_DISCOUNT_CAPTURE", 1.0, 0.85),
    ("BEST_PRICE_EXTRAPOLATION", 1.0, 0.75),
)
CATEGORY_SAVINGS = (
    ("Information Technology", "SUPPLIER_CONSOLIDATION", 0.12, 0.65),
    ("Information Technology", "COMPETITIVE_TENDER", 0.10, 0.60),
    ("Professional Services", "SUPPLIER_CONSOLIDATION", 0.10, 0.55),
    ("Professional Services", "COMPETITIVE_TENDER", 0.08, 0.50),
    ("Facilities Management", "SUPPLIER_CONSOLIDATION", 0.07, 0.72),
    ("Marketing and Communications", "SUPPLIER_CONSOLIDATION", 0.12, 0.60),
    ("Logistics and Transport", "COMPETITIVE_TENDER", 0.09, 0.70),
)
#: Where neither table has a lever: no saving, this share addressable.
ADDRESSABLE_OTHERWISE = 0.70

# Rules that may not claim the same spend twice share a group.
EXCLUSIVE = {
    "SUPPLIER_CONSOLIDATION": "SOURCING",
    "COMPETITIVE_TENDER": "SOURCING",
    "CONTRACT_COVERAGE_GAP": "COVERAGE",
    "PAYMENT_TERM_EXTENSION": "WORKING_CAPITAL",
    "TAIL_SPEND_RATIONALISATION": "PORTFOLIO_TAIL",
    "CONTRACT_COMPLIANCE": "PORTFOLIO_COMPLIANCE",
    "SPEND_CONCENTRATION_RISK": "SOURCING_CONCENTRATION",
    "EARLY_PAYMENT_DISCOUNT_CAPTURE": "EARLY_PAYMENT",
    "BEST_PRICE_EXTRAPOLATION": "PRICE_BENCHMARK",
}

# Columns of a raw export, and the fields that must be there.
COLUMN_MAPPINGS = {
    "DEFAULT": {
        "VENDOR_NAME": "raw_supplier_name", "VENDOR_NUM": "raw_supplier_id", "INV_NO": "invoice_number", "INV_DATE": "invoice_date",
        "LINE_DESC": "raw_line_description", "AMT": "original_amount", "CCY": "original_currency", "GL_CODE": "gl_account",
        "COST_CTR": "cost_centre", "PAY_TERMS": "raw_payment_terms", "PO_NUM": "po_number", "BUS_UNIT": "business_unit", "SITE": "plant_site",
    }
}
REQUIRED_FIELDS = ("invoice_number", "original_amount", "original_currency", "invoice_date", "raw_supplier_name")

FX_SCHEMA = "year_month string, from_ccy string, to_ccy string, rate double"
SEED_SCHEMA = "mapping_type string, source_value string, internal_category_l1 string, internal_category_l2 string, internal_category_l3 string, unspsc_segment_code string, confidence double, position long"
HIERARCHY_SCHEMA = "l1_code string, l1_name string, l2_code string, l2_name string, l3_code string, l3_name string, unspsc_segment_code string, unspsc_segment_name string"


def fx_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=FX_SCHEMA, header=True)


def seed_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Seed mappings from one small file; ``position`` is their order in it."""
    rows = spark.read.csv(path, schema=SEED_SCHEMA.rpartition(",")[0], header=True)
    return rows.withColumn("position", F.monotonically_increasing_id())


def category_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=HIERARCHY_SCHEMA, header=True)


def overrides(spark: SparkSession, table: str) -> DataFrame:
    """The override table; empty, with its columns, where there is no such table."""
    from outlay.schema import OVERRIDE_SCHEMA

    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], OVERRIDE_SCHEMA)
