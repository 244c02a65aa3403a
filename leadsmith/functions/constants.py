"""Schemas, dictionaries and term lists.

Everything between the FIXED VALUES markers must equal the behaviour being
reproduced (field names, domain lists, term lists, rule orders); it is stated
plainly and in its natural order. Nothing here is data-sized.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Standard company schema, in output order (Source is appended after it).
COMPANY_FIELDS = [
    "Company Name",
    "Company Domain",
    "Company Description",
    "Company Industry",
    "Company Employee Count",
    "Company LinkedIn",
    "Year Founded",
    "Company Location",
]

# Standard people schema, in output order (Source is appended after it).
PEOPLE_FIELDS = [
    "First Name",
    "Last Name",
    "Full Name",
    "Job Title",
    "LinkedIn Profile",
    "Person Location",
    "Work Email",
    "Personal Email",
    "Phone Number",
    "Company Name",
    "Company Domain",
    "Company Description",
    "Company Industry",
    "Company Employee Count",
    "Company LinkedIn",
    "Year Founded",
    "Company Location",
]

# Person part of the people payload.
PAYLOAD_PERSON_FIELDS = [
    "First Name",
    "Last Name",
    "Full Name",
    "Job Title",
    "LinkedIn Profile",
    "Person Location",
    "Work Email",
    "Personal Email",
    "Phone Number",
]

# Personal e-mail domains (the rank of each comes from personal_rank_rule).
PERSONAL_DOMAINS = [
    "gmail.com", "yahoo.com", "yahoo.co.uk", "yahoo.fr", "yahoo.de",
    "hotmail.com", "hotmail.co.uk", "hotmail.fr", "hotmail.de", "outlook.com",
    "live.com", "aol.com", "icloud.com", "me.com", "mac.com", "mail.com",
    "protonmail.com", "proton.me", "yandex.com", "yandex.ru", "msn.com",
    "zoho.com", "gmx.com", "gmx.de", "web.de", "fastmail.com",
]

# Free providers never used as a company domain (a different list).
FREE_PROVIDERS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com",
    "aol.com", "live.com", "msn.com", "mail.com", "ymail.com",
    "rocketmail.com", "protonmail.com", "zoho.com",
]

# Suffixes dropped when a company name is generated from a domain.
NAME_TLDS = [".com", ".net", ".org", ".io", ".co", ".ai", ".app", ".tech",
             ".dev", ".biz", ".info", ".me", ".ly", ".vc"]

# Columns cleaned as integers (exact names).
INTEGER_FIELDS = [
    "Company Employee Count",
    "Year Founded",
    "Employee Count",
    "Founded Year",
    "Employees",
    "Team Size",
    "Staff Count",
]

# Composite dedup keys, in key order.
DEDUP_KEYS = {
    "people": ["Work Email", "Personal Email", "LinkedIn Profile", "Full Name", "Company Name"],
    "company": ["Company Name", "Company Domain", "Company LinkedIn"],
}

# Fuzzy record dedup: key fields, and least score of a fuzzy header match (0 to 100).
FUZZY_KEYS = {
    "people": ["Full Name", "Company Name"],
    "company": ["Company Name", "Company Domain"],
}
FUZZY_HEADER_LEAST = 85

# Variant consolidation rules: target -> variants, matched case-insensitively, in order.
CONSOLIDATION_RULES = {
    "company": [
        ("Company LinkedIn", [
            "LinkedIn Profile", "Linkedin Profile", "LinkedIn Url", "Linkedin Url",
            "Company LinkedIn Url", "Company Linkedin Url", "LinkedIn URL",
            "Company Linked In", "Linked In", "LinkedIn", "linkedin_url",
            "LinkedIn Account", "Linkedin Account", "LinkedIn Username",
            "linkedin_account", "company linkedin url", "company linkedin URL",
            "Linkedin profile", "linkedin profile", "company Linked In Handle",
            "Linked In Handle",
        ]),
        ("Company Domain", ["Domain", "Website", "Company Website", "domain_url", "Final Domain"]),
        ("Company Name", ["merchant_name", "Merchant Name", "Name", "Business Name"]),
        ("Company Employee Count", ["employee_count", "Employee Count", "Employees", "Staff Size"]),
    ],
    "people": [
        ("LinkedIn Profile", [
            "LinkedIn Url", "Linkedin Url", "LinkedIn URL", "LinkedIn",
            "Linked In Profile", "LinkedIn Profile Url", "linkedin_url",
            "Linkedin profile", "linkedin profile", "Linked In",
        ]),
        ("Company LinkedIn", [
            "Company LinkedIn Url", "Company Linkedin Url", "Company Linked In",
            "linkedin_url", "linkedin_account",
        ]),
    ],
}

# Alias dictionary (standard header -> header synonyms); first match wins.
ALIASES = {
    "company": {
        "Company Name": ["company name", "business name", "organization", "company", "firm", "corp", "enterprise"],
        "Company Domain": ["domain", "website", "url", "web site", "company domain", "site", "company website"],
        "Company Description": ["description", "about", "company description", "business description", "company info"],
        "Company Industry": ["industry", "sector", "business type", "category", "vertical", "field", "company industry"],
        "Company Employee Count": ["employees", "employee count", "employee_count", "staff size", "staff_size",
                                   "team size", "team_size", "headcount", "company size", "company_size"],
        "Company LinkedIn": ["linkedin", "linkedin url", "linkedin_url", "company linkedin", "linkedin page",
                             "li url", "linkedin_account", "linkedin account"],
        "Year Founded": ["founded", "year founded", "established", "inception", "started", "founding year"],
        "Company Location": ["location", "address", "city", "headquarters", "hq", "company location"],
    },
    "people": {
        "First Name": ["first name", "fname", "given name", "first", "firstname", "f name"],
        "Last Name": ["last name", "lname", "surname", "family name", "last", "lastname", "l name"],
        "Full Name": ["full name", "name", "contact name", "person name", "fullname", "complete name"],
        "Job Title": ["title", "job title", "position", "role", "designation", "job", "occupation"],
        "LinkedIn Profile": ["linkedin", "linkedin profile", "linkedin_profile", "linkedin url", "linkedin_url",
                             "profile", "li url", "li_url", "li profile", "li_profile"],
        "Person Location": ["location", "city", "address", "person location", "based in", "lives in"],
        "Work Email": ["work email", "work_email", "business email", "business_email", "company email",
                       "company_email", "corporate email", "corporate_email", "email", "e-mail",
                       "work e-mail", "business e-mail"],
        "Personal Email": ["personal email", "personal_email", "private email", "private_email", "home email",
                           "home_email", "personal", "email personal", "email_personal", "personal e-mail"],
        "Phone Number": ["phone", "telephone", "mobile", "cell", "contact number", "contact_number",
                         "phone number", "phone_number", "tel"],
        "Company Name": ["company", "company name", "organization", "employer", "workplace", "firm"],
        "Company Domain": ["domain", "website", "url", "web site", "company domain", "site", "company website"],
        "Company Description": ["company description", "about company", "description", "company info"],
        "Company Industry": ["industry", "sector", "business type", "category", "vertical", "field",
                             "company industry"],
        "Company Employee Count": ["employees", "company size", "company_size", "employee count",
                                   "employee_count", "staff size", "staff_size", "headcount"],
        "Company LinkedIn": ["linkedin", "linkedin url", "linkedin_url", "company linkedin", "linkedin page",
                             "li url", "linkedin_account", "linkedin account"],
        "Year Founded": ["founded", "year founded", "established", "inception", "started", "founding year"],
        "Company Location": ["company location", "company address", "company city", "hq", "headquarters"],
    },
}

# Tokens a CSV reader turns into a missing value (exact match, no trim).
NA_TOKENS = [
    "", "NA", "N/A", "n/a", "NULL", "null", "None", "nan", "NaN", "-nan",
    "-NaN", "<NA>", "#NA", "#N/A", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN",
    "-1.#QNAN",
]

# Junk-column filter terms.
ID_TERMS = ["_id", "/id", "uid", "guid", "uuid"]
BOOLEANISH_SAMPLES = ["", "false", "true", "0", "1", "none", "null"]
IMPORTANT_TERMS = [
    "verified", "active", "current", "primary", "valid",
    "email", "e-mail", "mail",
    "phone", "telephone", "mobile", "cell",
    "name", "title", "position", "role",
    "company", "organization", "domain", "website",
    "linkedin", "twitter", "facebook", "instagram", "youtube", "tiktok",
]
TRACKING_TERMS = ["tracking", "metadata", "internal", "system", "debug", "test_"]
UNWANTED_TERMS = [
    "avatar", "photo", "picture", "image", "pic", "logo", "profile_pic", "headshot",
    "funding", "revenue", "valuation", "investment", "funding_round", "investors",
    "annual_revenue", "total_funding", "series_a", "series_b", "seed_funding",
    "postal_code", "zip_code", "zip", "postcode", "street_address", "address_line",
    "latitude", "longitude", "coords", "coordinates", "timezone",
    "keywords", "tags", "categories", "labels", "hashtags", "topics",
    "status", "flag", "is_active", "is_verified", "is_deleted", "is_published",
    "archived", "suspended", "blocked", "banned",
    "created_at", "updated_at", "modified_at", "timestamp", "date_added", "last_seen", "last_login",
    "version", "revision", "checksum",
    "facebook_likes", "twitter_followers", "instagram_followers", "youtube_views",
    "social_score", "klout_score", "influence_score",
    "utm_source", "utm_medium", "utm_campaign", "referrer", "source_campaign", "tracking_code",
    "pixel_id", "analytics_id",
    "api_url", "webhook_url", "callback_url", "redirect_url", "canonical_url", "short_url",
    "permalink", "slug",
    "score", "rating", "rank", "ranking", "grade", "confidence_score", "quality_score",
    "spam_score", "trust_score",
    "technologies", "skills", "certifications", "awards", "languages_spoken",
    "lead_source", "pipeline_stage", "deal_stage", "opportunity_value", "conversion_rate",
    "engagement_score",
    "birthday", "age", "birth_date", "personal_phone", "home_address", "marital_status",
    "family_members",
]

# Hash-like sample values (checked only when the value has >= 10 characters).
HASH_PATTERNS = [
    r"^[a-f0-9]{24}$",
    r"^[a-f0-9]{32}$",
    r"^[a-f0-9]{40}$",
    r"^[a-f0-9]{64}$",
    r"^[A-Za-z0-9_-]{20,}$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
]

# Delivery: attempts, back-off base, 429 pause, throttled rate, throttle trigger.
DELIVERY_MAX_ATTEMPTS = 3
DELIVERY_BACKOFF_BASE_S = 1.0
DELIVERY_JITTER = (0.8, 1.2)
DELIVERY_429_PAUSE_S = 0.5
DELIVERY_DEFAULT_RATE = 10
DELIVERY_THROTTLED_RATE = 5
DELIVERY_THROTTLE_AFTER_429 = 3
DELIVERY_RESPONSE_TEXT_CHARS = 500
PAYLOAD_SOURCE_LABEL = "CSV Merger"

# Messages of the failure log, and of status updates while sending.
LOG_FAILURE_MESSAGE = "Webhook failed for record %d after %d attempts: HTTP %d"
LOG_EXCEPTION_MESSAGE = "Webhook exception for record %d after %d attempts: %s"
STATUS_SENDING_MESSAGE = "Sent record %d of %d"

# Name of a processed export.
EXPORT_NAME = "{table_type}_leads_processed_{stamp}.csv"
EXPORT_STAMP = "%Y-%m-%d_%H-%M"

# Logs: retention and default query window.
LOG_RETENTION_DAYS = 7
LOG_DEFAULT_LIMIT = 1000

# Progress band used while delivering, and ETA window.
PROGRESS_BASE = 80
PROGRESS_SPAN = 20
ETA_MIN_SAMPLES = 3
ETA_WINDOW = 10

# Stuck-progress detection thresholds (polls, seconds).
STUCK_MIN_POLLS = 10
STUCK_WARN_S = 120
STUCK_ALERT_S = 300

# Rows of the composite-sample scan (a sampling operator).
PROFILE_SAMPLE_ROWS = 1000

# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------


def personal_rank_rule(domain: str) -> int:
    """Rank of a personal domain: gmail 4, yahoo 3, outlook/live 2, hotmail 1, else 0."""
    d = domain.lower()
    if "gmail" in d:
        return 4
    if "yahoo" in d:
        return 3
    if "outlook" in d or "live" in d:
        return 2
    if "hotmail" in d:
        return 1
    return 0


PERSONAL_RANKS = {d: personal_rank_rule(d) for d in PERSONAL_DOMAINS}


def standard_fields(table_type: str) -> list[str]:
    """Standard headers for a table type, without Source."""
    if table_type == "people":
        return list(PEOPLE_FIELDS)
    if table_type == "company":
        return list(COMPANY_FIELDS)
    raise ValueError(f"table_type must be 'people' or 'company', got {table_type!r}")
