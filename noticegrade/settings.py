"""Defaults shared by the operators. Each is also a keyword parameter."""

from __future__ import annotations

# ---- fixed values: naming signals --------------------------------------------
SUSPICIOUS_TOKENS = (
    "stream", "live", "hd", "sport", "sports", "futbol",
    "foot", "match", "tv", "watch", "free",
)
RISKY_SUFFIXES = ("xyz", "ru", "su", "top", "cc", "sbs", "club", "online", "stream")

# ---- fixed values: thresholds and budgets ------------------------------------
ACTION_THRESHOLD = 0.5
CUTOFF_DATE = "2024-09-01"
BUDGET_MINUTES = 60
COST_MINUTES = 3
PRECISION_KS = (10, 25, 50)
SEED = 42
SAMPLE_ROWS = 200_000
BURST_WINDOW_MINUTES = 15

# ---- fixed values: source headers and the columns they become -----------------
REQUEST_COLUMNS = {
    "Request ID": "request_id",
    "Date": "date",
    "Lumen URL": "lumen_url",
    "Copyright owner ID": "copyright_owner_id",
    "Copyright owner name": "copyright_owner",
    "Reporting organization ID": "reporting_org_id",
    "Reporting organization name": "reporting_org",
    "URLs removed": "urls_removed",
    "URLs that were not in Google's search index": "urls_not_in_index",
    "URLs for which we took no action": "urls_no_action",
    "URLs pending review": "urls_pending",
    "From Abuser": "from_abuser",
}
DOMAIN_COLUMNS = {
    "Request ID": "request_id",
    "Domain": "domain",
    "URLs removed": "urls_removed",
    "URLs that were not in Google's search index": "urls_not_in_index",
    "URLs for which we took no action": "urls_no_action",
    "URLs pending review": "urls_pending",
    "From Abuser": "from_abuser",
}
URL_COUNTS = ("urls_removed", "urls_not_in_index", "urls_no_action", "urls_pending")
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# ---- fixed values: the model's feature columns, in order ----------------------
FEATURES = (
    "request_urls_log1p",
    "request_not_in_index_ratio",
    "request_no_action_ratio",
    "request_dow",
    "request_month",
    "request_org_historical_hit_rate",
    "request_owner_historical_hit_rate",
    "domain_has_suspicious_token",
    "suspicious_token_count",
    "tld_is_risky",
    "domain_length",
    "digit_ratio",
    "hyphen_count",
    "domain_historical_hit_rate",
)
# Known only once a request has been decided; left out where outcomes are hidden.
OUTCOME_FEATURES = ("request_not_in_index_ratio", "request_no_action_ratio")

# ---- fixed values: a starter set of public suffixes ---------------------------
# Pass a fuller list to the suffix functions where one is at hand: ``read_suffixes`` reads
# the public list's file.
PUBLIC_SUFFIXES = (
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "name", "pro",
    "xyz", "top", "club", "online", "stream", "site", "live", "tv", "app", "dev",
    "shop", "store", "blog", "news", "sbs", "icu", "vip", "fun", "space", "website",
    "ac", "ae", "ai", "am", "ar", "at", "au", "be", "bg", "br", "by", "ca", "cc",
    "ch", "cl", "cn", "co", "cz", "de", "dk", "ee", "es", "eu", "fi", "fm", "fr",
    "gg", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "io", "ir", "is", "it",
    "jp", "ke", "kr", "kz", "la", "li", "lt", "lu", "lv", "ly", "me", "mx", "my",
    "nl", "no", "nu", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "sa",
    "se", "sg", "sh", "si", "sk", "su", "th", "to", "tr", "tw", "ua", "uk", "us",
    "uy", "vn", "ws", "za",
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au",
    "com.br", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za", "com.ar",
    "com.cn", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "co.id", "co.il", "co.in", "co.th",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kawasaki.jp", "!city.kawasaki.jp",
    "*.kh", "*.mm", "*.np", "*.pg",
)
