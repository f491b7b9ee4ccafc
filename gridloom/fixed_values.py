"""Enumerations, aliases, thresholds and texts that results depend on."""

from __future__ import annotations

# Enumerations.
ENTITY_TYPES = ("PRODUCT", "BOOKING", "TRAVELER", "GUIDE", "QUALIFICATION", "STAFFING_RULE")
SESSION_STATUSES = ("OPEN", "CLOSED", "ARCHIVED")
BATCH_STATUSES = (
    "UPLOADED", "EXTRACTING", "EXTRACTED", "NORMALIZING", "NORMALIZED", "MATCHING", "MATCHED",
    "IN_REVIEW", "READY", "PREVIEWED", "COMMITTING", "COMMITTED", "FAILED", "ROLLING_BACK",
    "ROLLED_BACK",
)
REVIEW_REASONS = ("VALIDATION_ERROR", "DUPLICATE", "LOW_CONFIDENCE", "CONFLICT")
REVIEW_RESOLUTIONS = ("ACCEPT", "REJECT", "REMAP", "MERGE", "EDIT")
PUBLISH_OPS = ("CREATE", "UPDATE", "LINK", "DEACTIVATE")

# Canonical fields of each entity, in schema order, with the header
# spellings that stand for them.
FIELD_ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "PRODUCT": {
        "name": ("name", "title", "product", "product name"),
        "sku": ("sku", "code", "product code"),
        "category": ("category", "type"),
        "price": ("price", "amount", "cost"),
        "currency": ("currency", "ccy"),
    },
    "BOOKING": {
        "reference": ("reference", "ref", "booking", "booking ref", "booking reference"),
        "productRef": ("product", "product ref", "product code", "sku"),
        "travelerRef": ("traveler", "traveller", "traveler email", "customer"),
        "startDate": ("start date", "startdate", "date", "departure", "departure date"),
    },
    "TRAVELER": {
        "fullName": ("full name", "name", "traveler", "traveller", "customer name"),
        "email": ("email", "e-mail", "mail"),
        "phone": ("phone", "mobile", "telephone", "tel"),
    },
    "GUIDE": {
        "fullName": ("full name", "name", "guide", "guide name"),
        "email": ("email", "e-mail", "mail"),
    },
    "QUALIFICATION": {
        "code": ("code", "qualification code", "qual code"),
        "name": ("name", "qualification", "title"),
        "guideRef": ("guide", "guide email", "guide name"),
    },
    "STAFFING_RULE": {
        "name": ("name", "rule", "rule name"),
        "productRef": ("product", "product code", "sku"),
        "qualificationRef": ("qualification", "qualification code", "qual"),
    },
}
NUMERIC_FIELDS = ("price",)
EMAIL_FIELDS = ("email",)
DATE_FIELDS = ("startDate",)

# Sheet and file names that reveal the entity type.
SHEET_NAMES: dict[str, str] = {
    "product": "PRODUCT",
    "products": "PRODUCT",
    "booking": "BOOKING",
    "bookings": "BOOKING",
    "traveler": "TRAVELER",
    "travelers": "TRAVELER",
    "traveller": "TRAVELER",
    "travellers": "TRAVELER",
    "guide": "GUIDE",
    "guides": "GUIDE",
    "qualification": "QUALIFICATION",
    "qualifications": "QUALIFICATION",
    "staffing rule": "STAFFING_RULE",
    "staffing rules": "STAFFING_RULE",
    "staffing_rule": "STAFFING_RULE",
    "staffing_rules": "STAFFING_RULE",
    "staffingrules": "STAFFING_RULE",
}

# Which canonical field feeds which match key.
KEY_FIELDS: dict[str, dict[str, str]] = {
    "PRODUCT": {"code": "sku", "name": "name"},
    "BOOKING": {"code": "reference", "name": "productRef", "date": "startDate"},
    "TRAVELER": {"email": "email", "name": "fullName"},
    "GUIDE": {"email": "email", "name": "fullName"},
    "QUALIFICATION": {"code": "code", "name": "name"},
    "STAFFING_RULE": {"name": "name"},
}

# Duplicate thresholds and wording.
FUZZY_THRESHOLD = 0.85
DUPLICATE_THRESHOLD = 0.97
ENTITY_LABELS = {
    "PRODUCT": "product",
    "BOOKING": "booking",
    "TRAVELER": "traveler",
    "GUIDE": "guide",
    "QUALIFICATION": "qualification",
    "STAFFING_RULE": "staffing rule",
}
EXACT_TEXT = 'Shares %s "%s" with an earlier %s in this upload — likely the same record.'
FUZZY_TEXT = 'Name "%s" is ~%s%% similar to "%s" on another %s row%s'
FUZZY_DUPLICATE_TAIL = " — likely a duplicate."
FUZZY_POSSIBLE_TAIL = " — possible duplicate, please confirm."
VALIDATION_TEXT = "This row has validation problems: %s."

# Validation messages (public schema-library defaults) and e-mail pattern.
MSG_REQUIRED = "Required"
MSG_TOO_SHORT = "String must contain at least 1 character(s)"
MSG_BAD_EMAIL = "Invalid email"
EMAIL_PATTERN = (
    r"(?i)^(?!\.)(?!.*\.\.)[A-Z0-9_'+\-.]*[A-Z0-9_+\-]@(?:[A-Z0-9][A-Z0-9\-]*\.)+[A-Z]{2,}$"
)

# Review priorities.
PRIORITY = {"VALIDATION_ERROR": 2, "DUPLICATE": 1, "LOW_CONFIDENCE": 0}

# Batch statuses each publish step may start from.
ALLOWED_FROM = {
    "preview": ("READY", "PREVIEWED"),
    "commit": ("READY", "PREVIEWED", "COMMITTING", "COMMITTED", "FAILED"),
    "rollback": ("COMMITTED", "FAILED", "ROLLING_BACK"),
}

# Import error codes and their status numbers.
ERROR_STATUS = {
    "invalid_request": 400,
    "unauthorized": 401,
    "not_found": 404,
    "conflict": 409,
    "validation_error": 422,
    "internal": 500,
}

# Mapping-suggestion confidences, sample size and page bounds.
DIRECT_CONFIDENCE = 0.95
ALIAS_CONFIDENCE = 0.8
SAMPLE_ROWS = 5
PAGE_DEFAULT = 50
PAGE_MAX = 200
SAFE_NAME_MAX = 120

# Characters removed by a full Unicode trim.
TRIM_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
