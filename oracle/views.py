"""SQL twins of ``noticegrade.sources.views``, as WITH clauses that can be combined."""

from __future__ import annotations

CUTOFF = "2000-09-01"

_RATE = "CASE WHEN {s} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {r}::DOUBLE / {s})) END"


def _outcomes(source: str) -> str:
    spec = "urls_removed::BIGINT + urls_not_in_index + urls_no_action + urls_pending"
    return (
        f"SELECT *, {_RATE.format(s='urls_specified', r='urls_removed')} AS removal_rate "
        f"FROM (SELECT *, ({spec})::BIGINT AS urls_specified FROM ({source}))"
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` holding the named views and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered) + "\n"


view("counts_v", (), """
SELECT l_orderkey AS request_id, domain,
  sum(CASE WHEN l_returnflag='A' OR (l_returnflag='N' AND pirate) THEN q ELSE 0 END)::INT AS urls_removed,
  sum(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN q ELSE 0 END)::INT AS urls_not_in_index,
  sum(CASE WHEN l_returnflag='N' AND NOT pirate THEN q ELSE 0 END)::INT AS urls_no_action,
  sum(CASE WHEN l_returnflag='R' AND l_linestatus='O' THEN q ELSE 0 END)::INT AS urls_pending
FROM (
  SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity::INT AS q, p_partkey % 6 < 3 AS pirate,
    concat(replace(p_name, ' ', '-'),
      CASE p_partkey % 6 WHEN 0 THEN '-live' WHEN 1 THEN '-stream' WHEN 2 THEN 'hd'
        WHEN 3 THEN '-news' WHEN 4 THEN '-blog' ELSE '' END,
      p_size::VARCHAR, '.',
      CASE p_type WHEN 'ECONOMY' THEN 'xyz' WHEN 'LARGE' THEN 'com' WHEN 'MEDIUM' THEN 'ru'
        WHEN 'PROMO' THEN 'co.uk' WHEN 'SMALL' THEN 'net' ELSE 'stream' END) AS domain
  FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY ALL""")

view("domains_v", ("counts_v",), _outcomes("SELECT *, false AS from_abuser FROM counts_v"))

view("requests_v", ("counts_v",), _outcomes("""
SELECT o_orderkey AS request_id, o_orderdate::DATE AS date, c_nationkey::BIGINT AS reporting_org_id,
  n_name AS reporting_org, o_custkey AS copyright_owner_id, c_name AS copyright_owner,
  o_orderstatus = 'P' AS from_abuser, concat('https://notices.example/', o_orderkey) AS lumen_url,
  coalesce(s.urls_removed, 0) AS urls_removed, coalesce(s.urls_not_in_index, 0) AS urls_not_in_index,
  coalesce(s.urls_no_action, 0) AS urls_no_action, coalesce(s.urls_pending, 0) AS urls_pending
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT request_id, sum(urls_removed)::INT AS urls_removed,
    sum(urls_not_in_index)::INT AS urls_not_in_index, sum(urls_no_action)::INT AS urls_no_action,
    sum(urls_pending)::INT AS urls_pending FROM counts_v GROUP BY 1) s ON s.request_id = o_orderkey"""))

_COUNT = (
    "CASE WHEN request_id % 97 = 0 THEN 'n/a' WHEN request_id % 7 = 0 "
    "THEN '1,' || lpad({c}::VARCHAR, 3, '0') ELSE {c}::VARCHAR END"
)
view("requests_raw_v", ("requests_v",), f"""
SELECT request_id::VARCHAR AS request_id,
  CASE WHEN request_id % 101 = 0 THEN 'bad' ELSE strftime(date, '%Y-%m-%d') || 'T00:00:00Z' END AS date,
  lumen_url,
  CASE WHEN request_id % 211 = 0 THEN NULL ELSE copyright_owner_id::VARCHAR END AS copyright_owner_id,
  CASE WHEN request_id % 53 = 0 THEN '  ' WHEN request_id % 5 = 0 THEN upper(copyright_owner)
    WHEN request_id % 5 = 1 THEN '  ' || replace(copyright_owner, '#', '  #') || ' '
    ELSE copyright_owner END AS copyright_owner,
  reporting_org_id::VARCHAR AS reporting_org_id, reporting_org,
  {_COUNT.format(c='urls_removed')} AS urls_removed,
  {_COUNT.format(c='urls_not_in_index')} AS urls_not_in_index,
  CASE WHEN request_id % 89 = 0 THEN '-5' ELSE {_COUNT.format(c='urls_no_action')} END AS urls_no_action,
  {_COUNT.format(c='urls_pending')} AS urls_pending,
  CASE request_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'false' END AS from_abuser
FROM requests_v""")

view("domains_raw_v", ("counts_v",), """
SELECT request_id::VARCHAR AS request_id,
  CASE WHEN request_id % 997 = 0 THEN ' ' ELSE
    (CASE WHEN request_id % 9 = 0 THEN chr(9) ELSE '' END)
    || (CASE WHEN request_id % 3 = 0 THEN upper(domain) ELSE domain END)
    || (CASE WHEN request_id % 4 = 0 THEN '.' ELSE '' END) END AS domain,
  urls_removed::VARCHAR AS urls_removed, urls_not_in_index::VARCHAR AS urls_not_in_index,
  urls_no_action::VARCHAR AS urls_no_action, urls_pending::VARCHAR AS urls_pending,
  CASE WHEN request_id % 10 = 0 THEN 'True' ELSE 'false' END AS from_abuser
FROM counts_v""")


def clean_count(c: str) -> str:
    return f"coalesce(TRY_CAST(regexp_replace({c}, '[^0-9-]', '', 'g') AS INTEGER), 0)"


def clean_name(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def clean_domain(c: str) -> str:
    return (
        f"nullif(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '\\.+$', ''), '')"
    )


def parse_day(c: str) -> str:
    return f"try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ')::DATE"


def parse_flag(c: str) -> str:
    return f"(lower(trim({c})) = 'true')"


view("names_v", ("requests_raw_v",), f"""
SELECT *, {clean_name('copyright_owner')} AS owner_name,
  TRY_CAST(copyright_owner_id AS BIGINT) AS owner_id FROM requests_raw_v""")

view("canonical_v", ("names_v",), """
SELECT owner_id, owner_name AS canonical FROM (
  SELECT owner_id, owner_name,
    row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, owner_name) AS rn
  FROM names_v WHERE owner_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1 AND owner_id IS NOT NULL""")

view("org_canonical_v", ("requests_raw_v",), f"""
SELECT org_id, org_name AS canonical_org FROM (
  SELECT org_id, org_name,
    row_number() OVER (PARTITION BY org_id ORDER BY count(*) DESC, org_name) AS rn
  FROM (SELECT TRY_CAST(reporting_org_id AS BIGINT) AS org_id,
      {clean_name('reporting_org')} AS org_name FROM requests_raw_v)
  WHERE org_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1 AND org_id IS NOT NULL""")

_JOINED = """
SELECT d.request_id, d.domain, r.date, r.reporting_org_id, r.reporting_org, r.copyright_owner_id,
  r.copyright_owner,
  d.urls_specified AS domain_urls_specified, d.urls_removed AS domain_urls_removed,
  d.urls_no_action AS domain_urls_no_action, d.urls_not_in_index AS domain_urls_not_in_index,
  d.urls_pending AS domain_urls_pending, d.removal_rate AS domain_removal_rate,
  d.from_abuser AS domain_from_abuser,
  r.urls_specified AS request_urls_specified, r.urls_removed AS request_urls_removed,
  r.urls_no_action AS request_urls_no_action, r.urls_not_in_index AS request_urls_not_in_index,
  r.urls_pending AS request_urls_pending, r.removal_rate AS request_removal_rate,
  r.from_abuser AS request_from_abuser
FROM domains_v d LEFT JOIN requests_v r USING (request_id)"""
view("joined_v", ("domains_v", "requests_v"), _JOINED)
JOINED_DIRTY = _JOINED.replace("domains_v", "dirty_domains_v").replace("requests_v", "dirty_requests_v")


def prior_rate(group: str, rate: str) -> str:
    """Mean of ``rate`` over the group's rows of strictly earlier days."""
    return (
        f"avg({rate}) OVER (PARTITION BY {group} ORDER BY date "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    )


TOKENS = ("stream", "live", "hd", "sport", "sports", "futbol", "foot", "match", "tv", "watch", "free")
RISKY = ("xyz", "ru", "su", "top", "cc", "sbs", "club", "online", "stream")


def suffix(domain: str) -> str:
    """Public suffix among those the test domains can have."""
    two = f"regexp_extract({domain}, '([^.]+\\.[^.]+)$', 1)"
    one = f"regexp_extract({domain}, '([^.]+)$', 1)"
    return (
        f"CASE WHEN {two} IN ('co.uk', 'org.uk', 'com.au', 'com.br', 'co.jp') THEN {two} "
        f"WHEN {one} IN ('com', 'net', 'org', 'xyz', 'ru', 'stream', 'uk', 'io', 'dev', 'info') "
        f"THEN {one} ELSE '' END"
    )


def naming(domain: str) -> dict[str, str]:
    any_token = f"regexp_matches({domain}, '{'|'.join(TOKENS)}')::INT"
    count = " + ".join(f"contains({domain}, '{t}')::INT" for t in TOKENS)
    risky = ", ".join(f"'{t}'" for t in RISKY)
    digits = f"length(regexp_replace({domain}, '[^0-9]', '', 'g'))"
    return {
        "domain_has_suspicious_token": any_token,
        "suspicious_token_count": f"({count})",
        "tld": suffix(domain),
        "tld_is_risky": f"(({suffix(domain)}) IN ({risky}))::INT",
        "domain_length": f"length({domain})::INT",
        "digit_ratio": f"CASE WHEN length({domain}) > 0 THEN {digits}::DOUBLE / length({domain}) ELSE 0.0::DOUBLE END",
        "hyphen_count": f"length(regexp_replace({domain}, '[^-]', '', 'g'))::INT",
    }


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN {part}::DOUBLE / {whole} ELSE 0.0::DOUBLE END"


_NAMING = ",\n  ".join(f"{sql} AS {name}" for name, sql in naming("domain").items())
view("features_v", ("joined_v",), f"""
SELECT *,
  ln(1 + greatest(request_urls_specified, 0)) AS request_urls_log1p,
  {share('request_urls_not_in_index', 'request_urls_specified')} AS request_not_in_index_ratio,
  {share('request_urls_no_action', 'request_urls_specified')} AS request_no_action_ratio,
  (isodow(date) - 1)::INT AS request_dow, month(date)::INT AS request_month,
  {prior_rate('reporting_org_id', 'request_removal_rate')} AS request_org_historical_hit_rate,
  {prior_rate('copyright_owner_id', 'request_removal_rate')} AS request_owner_historical_hit_rate,
  {_NAMING},
  {prior_rate('domain', 'domain_removal_rate')} AS domain_historical_hit_rate,
  (coalesce(domain_removal_rate, 0) >= 0.5)::INT AS action
FROM joined_v""")

view("scored_v", ("features_v",), """
SELECT *, round(1 / (1 + exp(-(2 * (round(coalesce(request_org_historical_hit_rate, 0.5), 6) - 0.5)
  + 0.8 * tld_is_risky + 0.5 * suspicious_token_count - 1))), 6) AS score FROM features_v""")

view("holdout_v", ("scored_v",), f"SELECT * FROM scored_v WHERE date >= DATE '{CUTOFF}'")

view("candidates_v", ("holdout_v",), """
SELECT h.request_id, h.domain, h.date AS step_start, h.score, h.action, h.domain_removal_rate,
  h.request_urls_log1p, h.request_not_in_index_ratio, h.request_no_action_ratio, h.request_dow,
  h.request_month, h.request_org_historical_hit_rate, h.request_owner_historical_hit_rate,
  h.domain_has_suspicious_token, h.suspicious_token_count, h.tld_is_risky, h.domain_length,
  h.digit_ratio, h.hyphen_count, h.domain_historical_hit_rate,
  coalesce(1 + c.c_custkey % 3, 1)::DOUBLE AS weight,
  1 + (h.request_id + length(h.domain)) % 5 AS cost_minutes
FROM holdout_v h LEFT JOIN customer c ON c.c_custkey = h.copyright_owner_id""")

view("ranked_v", ("candidates_v",), """
SELECT *, row_number() OVER (PARTITION BY step_start ORDER BY score DESC, request_id, domain) AS rank
FROM candidates_v""")
