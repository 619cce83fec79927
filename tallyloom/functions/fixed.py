"""Fixed values that results depend on: formats, patterns, word lists and lookup tables.

All of them are data, in the order in which they are tried.
"""

# Date formats, Spark notation (single letters also take two digits), tried in this order.
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "d-MMM-yyyy", "d-M-yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy")
SHORT_DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "d-M-yyyy")

# The same with the month before the day.
MONTH_FIRST_FORMATS = ("M/d/yyyy", "yyyy-M-d", "d/M/yyyy", "d-MMM-yyyy", "d-M-yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy")

# What counts as a number after prefixes and separators are gone.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Urdu script: Arabic, Arabic Supplement, Presentation Forms A and B.
URDU = "[\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"

# Personal data in the order in which it is searched. (?U): digits and word ends of any script.
PII_PATTERNS = {
    "CNIC": r"(?U)\b\d{5}-\d{7}-\d\b",
    "PHONE": r"(?U)(?<!\d)(\+92|0092|92)?[-.\s]?(3\d{2})[-.\s]?\d{7}|\b0\d{2,3}[-.\s]?\d{6,7}\b",
    "EMAIL": r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "IBAN": r"(?U)\bPK\d{2}[A-Z]{4}\d{16}\b",
    "ACCOUNT_NO": r"(?U)(?<!\d)\d{8,16}(?!\d)",
    "ADDRESS": r"(?Ui)\b(house|h\.?\s*no\.?|street|st\.|block|sector|phase|plot|flat|floor|apartment|apt\.?|road|rd\.|avenue|ave\.|lane|gali|mohalla|muhalla|locality|colony|town|city)\b",
}
#: Texts of which every match of a pattern holds one.
PII_SCREENS = {"CNIC": ("-",), "PHONE": ("0", "3"), "EMAIL": ("@",), "IBAN": ("PK",)}
# Masks of the silver step and of the file-to-gold job, in order: type, pattern, mark.
SILVER_MASKS = (
    ("cnic", r"(?U)\b\d{5}-\d{7}-\d\b", "*****-*******-*"),
    ("phone", r"(?U)(\+92|0)\d{10}", "***PHONE***"),
    ("email", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "***EMAIL***"),
)
PIPELINE_MASKS = (
    ("CNIC", r"(?U)\d{5}-\d{7}-\d", "[CNIC]"),
    ("PHONE", r"(?U)03\d{9}", "[PHONE]"),
    ("PHONE", r"(?U)\+92\d{10}", "[PHONE]"),
)
PII_FIELDS = ("description", "party_name", "reference")

# Canonical columns and their aliases; the first alias present wins.
COLUMN_ALIASES = {
    "txn_date": ("date", "txn_date", "transaction_date", "posting_date", "post_date", "value_date", "trans_date", "tarikh", "dated"),
    "description": ("description", "desc", "narration", "memo", "details", "particulars", "remarks", "note", "notes", "transaction_details"),
    "party_name": ("party", "party_name", "vendor", "customer", "payee", "name", "supplier", "client", "beneficiary", "payer"),
    "reference": ("reference", "ref", "ref_no", "voucher", "voucher_no", "invoice", "invoice_no", "bill_no", "doc_no", "check_no", "cheque_no"),
    "amount": ("amount", "amt", "total", "value", "transaction_amount", "net_amount"),
    "debit": ("debit", "dr", "dr_amount", "out", "withdrawal", "paid", "payment"),
    "credit": ("credit", "cr", "cr_amount", "in", "deposit", "received", "receipt"),
    "currency": ("currency", "ccy", "curr"),
}
REQUIRED_COLUMNS = ("txn_date", "description")
CANONICAL = ("txn_date", "description", "party_name", "reference", "amount", "direction", "currency")

# Keys under which the silver step looks for a field of a raw row.
DATE_KEYS = ("date", "transaction_date", "txn_date", "trans_date", "posting_date", "value_date", "dated")
AMOUNT_KEYS = ("amount", "debit", "credit", "dr", "cr", "withdrawal", "deposit", "payment", "receipt")
DEBIT_KEYS = ("debit", "dr", "withdrawal", "payment", "amount_debit")
CREDIT_KEYS = ("credit", "cr", "deposit", "receipt", "amount_credit")
DESCRIPTION_KEYS = ("description", "desc", "narration", "narrative", "details", "particulars", "memo", "remarks")
VENDOR_KEYS = ("vendor", "payee", "merchant", "party", "beneficiary", "sender", "receiver", "name")

# Parts of keys under which the file-to-gold job looks for a field, by priority.
DATE_PARTS = ("date", "tarikh", "taareekh", "تاریخ")
DESCRIPTION_PARTS = ("description", "narration", "particulars", "tafseelat", "تفصیل", "تفصیلات")
VENDOR_PARTS = ("vendor", "party", "name", "naam", "نام")
AMOUNT_PARTS = ("amount", "raqam", "رقم")
TYPE_PARTS = ("type", "txn_type", "transaction_type")

# Currency spellings.
CURRENCIES = {
    "PKR": "PKR", "RS": "PKR", "RS.": "PKR", "RUPEE": "PKR", "RUPEES": "PKR", "PAK": "PKR", "PK": "PKR",
    "USD": "USD", "US$": "USD", "DOLLAR": "USD", "DOLLARS": "USD", "$": "USD",
    "EUR": "EUR", "EURO": "EUR", "GBP": "GBP", "POUND": "GBP", "AED": "AED", "DIRHAM": "AED", "SAR": "SAR", "RIYAL": "SAR",
}

# Names that belong to the engine, and texts that a spreadsheet would run.
RESERVED_NAMES = (
    "bronze_id", "silver_id", "transaction_id", "gold_version", "quality_score", "embedding_text", "qdrant_indexed", "processing_status", "ingestion_batch_id",
    "source_file_hash", "pii_masked", "pii_types_found", "normalised_at", "promoted_at", "pipeline_audit_log", "is_duplicate", "duplicate_of",
)
FORMULAS = (r"(?i)=\s*(HYPERLINK|IMPORTXML|IMPORTDATA|IMPORTRANGE|IMAGE)", r"(?i)=\s*CMD\s*\(", r"(?i)=\s*EXEC\s*\(", r"\|.*\|")
FORMULA_MARK = "FORMULA_REMOVED:"
MAX_FILE_BYTES, MAX_ROWS, MAX_CELL = 100 * 1024 * 1024, 500_000, 10_000
NO_AMOUNT = ("n/a", "nil", "-", "—", "null", "none")

# Words that mark a summary row at the foot of a file.
SUMMARY_WORDS = ("total", "grand total", "sum", "kul", "majmua", "کل", "مجموعہ")

# Keywords of a description, in order: category and whether tax applies.
KEYWORD_CATEGORIES = (
    ("rent", "Rental Income / Expense", True),
    ("salary", "Salary / Wages", True),
    ("electricity", "Utilities", True),
    ("gas", "Utilities", True),
    ("water", "Utilities", True),
    ("internet", "Utilities", True),
    ("phone", "Utilities", True),
    ("food", "Food & Beverages", False),
    ("travel", "Travel & Conveyance", True),
    ("fuel", "Travel & Conveyance", True),
    ("office", "Office Supplies", True),
    ("stationery", "Office Supplies", True),
    ("sale", "Sales Revenue", True),
    ("purchase", "Purchases", True),
    ("insurance", "Insurance", True),
    ("medical", "Medical Expense", True),
    ("tax", "Tax Payment", False),
    ("commission", "Commission", True),
    ("advertising", "Advertising", True),
    ("repair", "Repair & Maintenance", True),
    ("maintenance", "Repair & Maintenance", True),
)

# Tax class by words contained in a category, in order.
TAX_CLASSES = (
    (("rent",), "Section 155 - Rent"),
    (("salary", "wages"), "Section 149 - Salary"),
    (("fuel", "supplies", "goods"), "Section 153 - Goods"),
    (("consulting", "legal", "services"), "Section 153 - Services"),
)

# Withholding sections: key, section, name, rate of filers, rate of non-filers, label of the annex (null: Other).
SECTIONS = (
    ("149", "149", "Salary", 0.0, 0.0, "Salary/Wages"),
    ("150", "150", "Dividends", 0.15, 0.30, "Dividend income"),
    ("151", "151", "Profit on Debt (Bank Interest)", 0.15, 0.30, "Profit on debt"),
    ("153_services", "153", "Services", 0.08, 0.16, "Services rendered/provided"),
    ("153_goods", "153", "Supply of Goods", 0.04, 0.08, "Supply of goods"),
    ("153_contracts", "153", "Contracts/Execution", 0.07, 0.14, "Execution of contract"),
    ("155", "155", "Rent of Property", 0.10, 0.20, "Property rent"),
    ("156", "156", "Prize/Winnings", 0.20, 0.20, None),
    ("231A", "231A", "Cash Withdrawal > 50K", 0.006, 0.012, None),
    ("236G", "236G", "Sales (Retail)", 0.0, 0.02, None),
)

# Categories of each section, in order; those of the last, without a section, are exempt.
SECTION_CATEGORIES = (
    ("153_services", ("consulting", "legal", "accounting", "audit", "advertising", "marketing", "it services", "software", "maintenance", "repair", "cleaning", "security", "transport", "courier", "freight", "commission", "brokerage", "professional fees")),
    ("153_goods", ("supplies", "stationery", "fuel", "petrol", "diesel", "raw materials", "inventory", "stock", "purchases", "goods", "office supplies", "electrical", "hardware", "food", "beverages")),
    ("153_contracts", ("construction", "renovation", "contract", "project", "civil work")),
    ("155", ("rent", "office rent", "shop rent", "warehouse rent", "property rent", "godown")),
    ("149", ("salary", "wages", "bonus", "overtime", "payroll", "staff salary")),
    ("150", ("dividend", "profit distribution")),
    ("151", ("bank interest", "profit on savings", "markup", "interest income", "interest expense")),
    (None, ("utilities", "electricity", "water", "gas", "internet", "telephone", "mobile", "insurance", "health insurance", "vehicle insurance")),
)

# Software by file name: pattern (case ignored), software, confidence; the first match wins.
SOFTWARE = (
    (r"tally\s*prime", "tally", 0.90),
    (r"tally", "tally", 0.85),
    (r"daybook", "tally", 0.75),
    (r"vch[_\s]?type", "tally", 0.70),
    (r"quickbooks?[\s_\-]*online", "quickbooks_online", 0.90),
    (r"quickbooks?[\s_\-]*desktop", "quickbooks_desktop", 0.90),
    (r"quickbooks?", "quickbooks_desktop", 0.85),
    (r"qb[_\s]?export", "quickbooks_desktop", 0.80),
    (r"ledgermax", "ledgermax", 0.95),
    (r"xero", "xero", 0.90),
    (r"moneypex", "moneypex", 0.95),
    (r"odoo", "odoo", 0.90),
    (r"erpnext", "erpnext", 0.90),
    (r"sage\s*50", "sage50", 0.90),
    (r"sage", "sage50", 0.75),
    (r"hbl.*statement|statement.*hbl", "bank_pdf_hbl", 0.90),
    (r"habib\s*bank", "bank_pdf_hbl", 0.85),
    (r"ubl.*statement|statement.*ubl", "bank_pdf_ubl", 0.90),
    (r"united\s*bank", "bank_pdf_ubl", 0.85),
    (r"alfalah", "bank_pdf_alfalah", 0.90),
    (r"meezan", "bank_pdf_meezan", 0.90),
    (r"nbp.*statement|statement.*nbp", "bank_pdf_nbp", 0.90),
    (r"national\s*bank", "bank_pdf_nbp", 0.85),
    (r"askari", "bank_pdf_askari", 0.90),
    (r"mcb.*statement|statement.*mcb", "bank_pdf_mcb", 0.90),
    (r"faysal\s*bank", "bank_pdf_faysal", 0.90),
    (r"jazzcash", "bank_pdf_jazzcash", 0.85),
    (r"easypaisa", "bank_pdf_easypaisa", 0.85),
    (r"(account|bank)[\s_\-]*statement", "bank_pdf_generic", 0.75),
    (r"annex[_\s\-]?c", "fbr_annex_c", 0.90),
    (r"fbr", "fbr_generic", 0.80),
    (r"withholding[\s_\-]*tax|wht", "fbr_wht", 0.80),
    (r"eobi", "eobi_register", 0.85),
)
# Without a match: source type to software and confidence.
SOFTWARE_BY_TYPE = {"xlsx": ("manual_excel", 0.50), "csv": ("manual_csv", 0.50), "pdf": ("unknown_pdf", 0.30), "json": ("api_export", 0.40)}
EXTENSIONS = {".xlsx": "xlsx", ".xls": "xlsx", ".csv": "csv", ".pdf": "pdf", ".json": "json"}
IGNORED_EXTENSIONS = (".tmp", ".bak", ".swp", ".lock", ".log", ".pyc", ".pyo", ".ds_store")

# Columns that may not, and that may, leave the place where they were read.
LOCAL_ONLY = (
    "description", "narration", "party_name", "payee", "vendor", "customer", "reference", "ref_no", "voucher_no", "invoice_no", "check_no",
    "account_number", "iban", "cnic", "phone", "email", "address", "password", "password_hash", "raw_text", "ocr_text",
)
CLOUD_SAFE = (
    "totals", "averages", "trends", "categories", "top_parties", "transaction_count", "income", "expenses", "net", "pii_summary", "avg_transaction", "avg_income",
    "avg_expense", "month", "count", "total", "pii_types_detected", "flagged_columns", "rows_with_pii", "pii_percentage", "status", "rows_imported", "rows_skipped",
    "rows_failed", "rows_total", "file_sha256", "filename", "file_size_bytes", "mime_type", "created_at", "updated_at", "org_id",
)

# The header dictionary, in the order in which it is tried. Software, then header and target field.
SOFTWARE_HEADERS = {
    "tally": {"date": "transaction_date", "particulars": "description", "vch type": "voucher_type", "vch no.": "voucher_number", "vch no": "voucher_number", "debit": "amount_debit", "credit": "amount_credit", "ledger name": "account_name"},
    "quickbooks_desktop": {"date": "transaction_date", "txn date": "transaction_date", "name": "vendor", "memo": "description", "memo/description": "description", "num": "reference", "type": "voucher_type", "amount": "net_amount", "debit": "amount_debit", "credit": "amount_credit", "account": "account_name", "class": "category"},
    "quickbooks_online": {"date": "transaction_date", "transaction date": "transaction_date", "payee": "vendor", "description": "description", "ref no.": "reference", "transaction type": "voucher_type", "amount": "net_amount", "debit (pkr)": "amount_debit", "credit (pkr)": "amount_credit", "account": "account_name", "category": "category"},
    "ledgermax": {"transaction date": "transaction_date", "date": "transaction_date", "description": "description", "party name": "vendor", "reference": "reference", "dr amount": "amount_debit", "cr amount": "amount_credit", "net amount": "net_amount", "account": "account_name"},
    "xero": {"date": "transaction_date", "description": "description", "reference": "reference", "contact": "vendor", "debit": "amount_debit", "credit": "amount_credit", "account": "account_name", "tax rate": "category"},
    "bank_pdf_hbl": {"date": "transaction_date", "value date": "transaction_date", "description": "description", "narration": "description", "debit": "amount_debit", "credit": "amount_credit", "balance": "balance", "dr": "amount_debit", "cr": "amount_credit"},
    "bank_pdf_ubl": {"posting date": "transaction_date", "description": "description", "debit": "amount_debit", "credit": "amount_credit", "running balance": "balance"},
    "bank_pdf_meezan": {"date": "transaction_date", "description": "description", "withdrawal": "amount_debit", "deposit": "amount_credit", "balance": "balance"},
}
URDU_HEADERS = {
    "تاریخ": "transaction_date",
    "رقم": "net_amount",
    "تفصیل": "description",
    "بیان": "description",
    "نام": "vendor",
    "فروش": "vendor",
    "خریدار": "vendor",
    "حوالہ": "reference",
    "نمبر": "reference",
    "آمد": "amount_credit",
    "خرچ": "amount_debit",
    "جمع": "amount_credit",
    "نکاسی": "amount_debit",
    "بقایا": "balance",
    "قسم": "voucher_type",
    "زمرہ": "category",
    "کھاتہ": "account_name",
}
ROMAN_URDU_HEADERS = {
    "taareekh": "transaction_date",
    "tareekh": "transaction_date",
    "tarikh": "transaction_date",
    "raqam": "net_amount",
    "raqm": "net_amount",
    "tafseelat": "description",
    "tafsilat": "description",
    "bayaan": "description",
    "bayan": "description",
    "naam": "vendor",
    "hawala": "reference",
    "number": "reference",
    "aamad": "amount_credit",
    "kharcha": "amount_debit",
    "kharch": "amount_debit",
    "jama": "amount_credit",
    "nikaasi": "amount_debit",
    "baqaya": "balance",
    "qisam": "voucher_type",
    "zamra": "category",
    "khaata": "account_name",
}
GENERAL_HEADERS = (
    ("transaction_date", ("date", "txn_date", "txn date", "transaction_date", "transaction date", "posting_date", "posting date", "post_date", "value_date", "value date", "trans_date", "trans date", "dated", "dt")),
    ("description", ("description", "desc", "narration", "memo", "details", "particulars", "remarks", "note", "notes", "transaction_details", "transaction details")),
    ("vendor", ("vendor", "party", "party_name", "party name", "customer", "payee", "payer", "name", "supplier", "client", "beneficiary", "contact")),
    ("net_amount", ("amount", "amt", "total", "value", "transaction_amount", "transaction amount", "net_amount", "net amount", "net")),
    ("amount_debit", ("debit", "dr", "dr.", "dr_amount", "dr amount", "debit amount", "debit_amount", "withdrawal", "out", "paid", "payment", "expense")),
    ("amount_credit", ("credit", "cr", "cr.", "cr_amount", "cr amount", "credit amount", "credit_amount", "deposit", "in", "received", "receipt", "income")),
    ("reference", ("reference", "ref", "ref_no", "ref no", "ref no.")),
    ("voucher_number", ("voucher", "voucher_no", "voucher no", "voucher no.")),
    ("reference", ("invoice", "invoice_no", "invoice no", "bill_no", "bill no", "doc_no", "check_no", "cheque_no", "cheque no", "chq no")),
    ("voucher_type", ("type", "txn_type", "transaction_type", "transaction type", "vch type", "voucher type")),
    ("account_name", ("account", "account_name", "account name")),
    ("account_code", ("account_code", "account code")),
    ("account_name", ("ledger", "ledger_name", "ledger name")),
    ("account_code", ("gl_code",)),
    ("category", ("category", "class", "head", "expense_head", "expense head")),
    ("currency", ("currency", "ccy", "curr")),
    ("balance", ("balance", "running_balance", "running balance", "closing_balance", "closing balance")),
)
LAYER_CONFIDENCE = {"software": 0.95, "urdu": 0.90, "roman_urdu": 0.85, "general": 0.80, "normalised": 0.75}

# Default chart of accounts: code, name, type, parent.
CHART = (
    ("1000", "Assets", "asset", None),
    ("1010", "Cash in Hand", "asset", "1000"),
    ("1020", "Bank — Current Account", "asset", "1000"),
    ("1030", "Bank — Savings Account", "asset", "1000"),
    ("1100", "Accounts Receivable", "asset", "1000"),
    ("1200", "Inventory", "asset", "1000"),
    ("1300", "Advances to Suppliers", "asset", "1000"),
    ("1500", "Fixed Assets", "asset", "1000"),
    ("2000", "Liabilities", "liability", None),
    ("2010", "Accounts Payable", "liability", "2000"),
    ("2020", "Sales Tax Payable", "liability", "2000"),
    ("2030", "Income Tax Payable", "liability", "2000"),
    ("2040", "Salaries Payable", "liability", "2000"),
    ("2100", "Bank Loans", "liability", "2000"),
    ("3000", "Equity", "equity", None),
    ("3010", "Owner's Capital", "equity", "3000"),
    ("3020", "Retained Earnings", "equity", "3000"),
    ("4000", "Revenue", "revenue", None),
    ("4010", "Sales — Local", "revenue", "4000"),
    ("4020", "Sales — Export", "revenue", "4000"),
    ("4030", "Service Income", "revenue", "4000"),
    ("4900", "Other Income", "revenue", "4000"),
    ("5000", "Expenses", "expense", None),
    ("5010", "Cost of Goods Sold", "expense", "5000"),
    ("5100", "Salaries & Wages", "expense", "5000"),
    ("5110", "Rent", "expense", "5000"),
    ("5120", "Utilities", "expense", "5000"),
    ("5130", "Internet & Telecom", "expense", "5000"),
    ("5140", "Office Supplies", "expense", "5000"),
    ("5150", "Travel & Conveyance", "expense", "5000"),
    ("5160", "Marketing & Advertising", "expense", "5000"),
    ("5170", "Professional Fees", "expense", "5000"),
    ("5180", "Bank Charges", "expense", "5000"),
    ("5190", "Repairs & Maintenance", "expense", "5000"),
    ("5200", "Depreciation", "expense", "5000"),
    ("5900", "Miscellaneous Expense", "expense", "5000"),
)
