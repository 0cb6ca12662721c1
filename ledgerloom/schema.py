"""The data model: tables of nodes, reified edges, long-form facts and aliases, and the work queue."""

from __future__ import annotations

# The vocabularies of the model.
NODE_KINDS = ("company", "stock", "sector", "region", "segment", "customer", "period", "metric", "group", "person")
PREDICATES = ("HAS_SEGMENT", "SELLS_TO", "EXPOSED_TO", "IN_SECTOR", "ISSUES_STOCK", "BELONGS_TO_GROUP", "SUB_SECTOR_OF", "OWNS_STAKE_IN")
SOURCE_TYPES = ("dart_api", "dart_report", "social", "llm", "manual")
METHODS = ("api", "llm", "manual")
FISCAL_PERIODS = ("FY", "Q1", "H1", "Q3")
FS_DIVS = ("CFS", "OFS")
METRIC_KEYS = ("revenue", "operating_income", "net_income", "assets", "liabilities", "equity", "eps", "cf_operating", "cf_investing", "cf_financing", "shares_outstanding")
FLOW_METRICS = ("revenue", "operating_income", "net_income", "eps", "cf_operating", "cf_investing", "cf_financing")
STOCK_METRICS = ("assets", "liabilities", "equity")
QUEUE_STATES = ("pending", "in_progress", "done", "skipped", "failed")

QUALIFIER = "struct<share_pct: double, tier: string, buyer_raw: string, stake_pct: double, shares: long, relation: string, is_largest: boolean, affiliation_type: string, purpose: string>"
NODES = "id string, kind string, label string, attrs map<string, string>"
EDGES = f"subject_id string, predicate string, object_id string, period string, qualifier {QUALIFIER}, source_type string, source_ref string, method string, confidence double, extracted_at timestamp_ntz"
FACTS = "company_id string, bsns_year string, fiscal_period string, fs_div string, metric_key string, amount decimal(22,2), currency string, source_type string, source_ref string, method string, confidence double"
ALIASES = "alias_norm string, node_id string, source string, confidence double"
REPORTS = "rcept_no string, corp_code string, period string"
QUEUE = "id long, corp_code string, period string, status string, attempts int, last_attempt_at timestamp_ntz, last_error string, rcept_no string, escalation_level string, input_chars long, cost_estimate_usd decimal(8,4)"
STATEMENT_ROWS = "rcept_no string, bsns_year string, sj_div string, account_id string, account_nm string, thstrm_amount string, frmtrm_amount string, bfefrmtrm_amount string, fs_div string"
SHAREHOLDER_ROWS = "corp_code string, nm string, relate string, stock_knd string, trmend_posesn_stock_co string, trmend_posesn_stock_qota_rt string"
INVESTMENT_ROWS = "corp_code string, inv_prm string, invstmnt_purps string, trmend_blce_qy string, trmend_blce_qota_rt string"
EXTRACTION = "struct<period: string, segments: array<struct<name_ko: string, share_pct: double, description: string, products: array<string>>>, customers: array<struct<name_raw: string, revenue_share_pct: double, tier: string>>, geographic: array<struct<region_code: string, share_pct: double>>>"
