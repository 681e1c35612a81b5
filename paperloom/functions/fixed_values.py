"""Fixed values.

Everything here decides results and has to hold exactly these values: type
names, rules, patterns, masks, aliases, limits, thresholds and message formats.
They are data, kept together and in their natural order; the logic that uses
them lives elsewhere.
"""

# ---- document types and their rules (fixed values) -------------------------

DOCUMENT_TYPES = [
    "invoice",
    "receipt",
    "contract",
    "report",
    "letter",
    "form",
    "resume",
    "id_document",
    "medical_record",
    "financial_statement",
    "research_paper",
    "unknown",
]

DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
AMOUNT_PATTERN = r"^\d+\.?\d*$"
CODE_PATTERN = r"^[A-Z0-9-]+$"

# type -> (required fields, optional fields, field patterns)
DOCUMENT_RULES = {
    "invoice": (
        ["invoice_number", "date", "total_amount", "vendor_name"],
        ["line_items", "tax_amount", "due_date", "payment_terms", "billing_address",
         "shipping_address"],
        {"invoice_number": CODE_PATTERN, "date": DATE_PATTERN, "total_amount": AMOUNT_PATTERN},
    ),
    "receipt": (
        ["date", "total_amount", "merchant_name"],
        ["items", "payment_method", "tax_amount", "subtotal"],
        {"date": DATE_PATTERN, "total_amount": AMOUNT_PATTERN},
    ),
    "contract": (
        ["parties", "effective_date", "terms"],
        ["termination_date", "signatures", "governing_law", "amendments"],
        {"effective_date": DATE_PATTERN},
    ),
    "resume": (
        ["name", "contact_info"],
        ["education", "experience", "skills", "certifications", "summary"],
        {},
    ),
    "id_document": (
        ["name", "id_number", "issue_date"],
        ["expiry_date", "date_of_birth", "address", "photo", "issuing_authority"],
        {},
    ),
    "medical_record": (
        ["patient_name", "date", "provider"],
        ["diagnosis", "medications", "procedures", "notes", "lab_results"],
        {},
    ),
    "financial_statement": (
        ["period", "entity_name", "statement_type"],
        ["revenue", "expenses", "net_income", "assets", "liabilities", "equity"],
        {},
    ),
    "research_paper": (
        ["title", "authors"],
        ["abstract", "keywords", "institution", "publication_date", "doi", "references"],
        {},
    ),
}

# Amounts that must read as a number. An invoice is tested whenever the key is
# there, a receipt only when the value is truthy.
INVOICE_NUMERIC = ["total_amount"]
RECEIPT_NUMERIC = ["total_amount", "subtotal", "tax_amount"]

# Fields asked for by the extraction request; other types get the open request.
EXTRACTION_FIELDS = {
    "invoice": ["invoice_number", "date", "due_date", "vendor_name", "total_amount",
                "tax_amount", "line_items", "billing_address", "payment_terms"],
    "receipt": ["date", "merchant_name", "total_amount", "subtotal", "tax_amount",
                "payment_method", "items"],
    "contract": ["parties", "effective_date", "termination_date", "terms", "governing_law",
                 "signatures"],
    "resume": ["name", "contact_info", "summary", "education", "experience", "skills",
               "certifications"],
    "research_paper": ["title", "authors", "abstract", "keywords", "institution",
                       "publication_date", "doi", "references_count"],
}

# ---- personal data (fixed values) ------------------------------------------

# (type, pattern, capture group that holds the value); tried in this order,
# ignoring case, each pattern on its own.
PII_PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0),
    ("ssn", r"\b\d{3}\s\d{2}\s\d{4}\b", 0),
    ("ssn", r"\b\d{9}\b(?=.*(?:ssn|social|security))", 0),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
    ("phone", r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0),
    ("phone", r"\b\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0),
    ("phone", r"\b\d{3}[-.\s]\d{4}\b", 0),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0),
    ("credit_card", r"\b\d{16}\b", 0),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    ("date_of_birth",
     r"\b(?:DOB|Date of Birth|Born|Birthday)[:\s]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", 1),
    ("date_of_birth", r"\b(?:DOB|Date of Birth|Born)[:\s]*(\w+\s+\d{1,2},?\s+\d{4})\b", 1),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}\b", 0),
    ("drivers_license", r"\b[A-Z]{1,2}\d{6,8}\b", 0),
]

PATTERN_CONFIDENCE = 0.9
MODEL_CONFIDENCE = 0.8
CONTEXT_CHARS = 20

PII_MASKS = {
    "ssn": "***-**-****",
    "email": "[EMAIL REDACTED]",
    "phone": "[PHONE REDACTED]",
    "credit_card": "****-****-****-****",
    "ip_address": "[IP REDACTED]",
    "date_of_birth": "[DOB REDACTED]",
    "passport": "[PASSPORT REDACTED]",
    "drivers_license": "[DL REDACTED]",
    "name": "[NAME REDACTED]",
    "address": "[ADDRESS REDACTED]",
    "bank_account": "[BANK ACCOUNT REDACTED]",
    "medical_id": "[MEDICAL ID REDACTED]",
    "tax_id": "[TAX ID REDACTED]",
}
DEFAULT_MASK = "[REDACTED]"

# Names a model may give a type, looked up after lower-casing and turning blanks
# into underscores. Names with a blank in them can therefore never be found.
PII_ALIASES = {
    "ssn": "ssn",
    "social_security": "ssn",
    "email": "email",
    "email_address": "email",
    "phone": "phone",
    "phone_number": "phone",
    "telephone": "phone",
    "address": "address",
    "street_address": "address",
    "name": "name",
    "full_name": "name",
    "person_name": "name",
    "date_of_birth": "date_of_birth",
    "dob": "date_of_birth",
    "birthday": "date_of_birth",
    "credit_card": "credit_card",
    "bank_account": "bank_account",
    "passport": "passport",
    "passport_number": "passport",
    "drivers_license": "drivers_license",
    "ip_address": "ip_address",
    "medical_id": "medical_id",
    "tax_id": "tax_id",
}

# ---- files (fixed values) --------------------------------------------------

TEXT_SUFFIXES = ["txt", "text", "md", "csv", "json"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "gif", "bmp", "tiff"]
PDF_SUFFIXES = ["pdf"]
IMAGE_TEXT = "[Image content - OCR not available]"
MAX_DOCUMENT_MB = 10

# ---- requests and replies (fixed values) -----------------------------------


DEFAULT_CLASS_CONFIDENCE = 0.5
DEFAULT_REASONING = "No reasoning provided"
DEFAULT_FIELD_NAME = "unknown"
DEFAULT_FIELD_CONFIDENCE = 0.5
DEFAULT_DATA_TYPE = "string"
MAX_REPAIR_ATTEMPTS = 3
SUMMARY_CHARS = 500

# ---- reports (fixed values) ------------------------------------------------

AGENTS = {
    "classifier": "ClassifierAgent",
    "extractor": "ExtractorAgent",
    "validator": "ValidatorAgent",
    "redactor": "RedactorAgent",
    "reporter": "ReporterAgent",
}
# Percentile element of n sorted values: 0-based index n//2, int(n*0.95), int(n*0.99).
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
THRESHOLDS = {
    "extraction_accuracy": 0.90,
    "pii_recall": 0.95,
    "pii_precision": 0.90,
    "workflow_success": 0.90,
    "latency_p95": 4000.0,
}
