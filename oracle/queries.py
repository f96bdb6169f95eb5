"""SQL twins of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

from oracle.views import (
    CUTOFF,
    JOINED_DIRTY,
    RISKY,
    TOKENS,
    clean_count,
    clean_domain,
    clean_name,
    naming,
    parse_day,
    parse_flag,
    prior_rate,
    share,
    suffix,
    view,
    with_views,
)

SQL: dict[str, str] = {}


def sql(name: str, needs: tuple[str, ...], text: str) -> None:
    SQL[name] = with_views(*needs) + text.strip()


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) AS {name or expr}"


COUNTS = ("urls_removed", "urls_not_in_index", "urls_no_action", "urls_pending")

# ---- cleaning ---------------------------------------------------------------------

sql("contract_rename", ("requests_raw_v",), """
SELECT request_id, date, lumen_url, copyright_owner_id, copyright_owner, reporting_org_id,
  reporting_org, urls_removed, urls_not_in_index, urls_no_action, urls_pending, from_abuser
FROM requests_raw_v""")

_REQUESTS_RAW = (
    "request_id, date, {}, copyright_owner_id, copyright_owner, reporting_org_id, reporting_org, "
    "urls_removed, urls_not_in_index, urls_no_action, urls_pending, from_abuser"
)
_broken = (
    "CASE WHEN request_id::BIGINT % 7 = 0 THEN coalesce({0}, '') || chr(10) || '\"cited\", line' || chr(10) ELSE {0} END AS {0}"
)
sql("scan_requests_csv", ("requests_raw_v",), f"SELECT {_REQUESTS_RAW.format(_broken.format('lumen_url'))} FROM requests_raw_v")
sql("scan_domains_csv", ("domains_raw_v",), f"""
SELECT request_id, {_broken.format('domain')}, urls_removed, urls_not_in_index, urls_no_action, urls_pending, from_abuser
FROM domains_raw_v""")

_typed_counts = ", ".join(f"{clean_count(c)} AS {c}" for c in COUNTS)
view("typed_v", ("requests_raw_v",), f"""
SELECT *, urls_removed::BIGINT + urls_not_in_index + urls_no_action + urls_pending AS urls_specified FROM (
  SELECT TRY_CAST(request_id AS BIGINT) AS request_id, {parse_day('date')} AS date, lumen_url,
    TRY_CAST(copyright_owner_id AS BIGINT) AS copyright_owner_id, copyright_owner,
    TRY_CAST(reporting_org_id AS BIGINT) AS reporting_org_id, reporting_org,
    {_typed_counts}, {parse_flag('from_abuser')} AS from_abuser
  FROM requests_raw_v)""")
_rate = (
    "CASE WHEN urls_specified > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
    "urls_removed::DOUBLE / urls_specified)) END"
)

sql("coerce_counts", ("typed_v",), f"SELECT request_id, {', '.join(COUNTS)} FROM typed_v")
sql("normalise_names", ("names_v",), """
SELECT TRY_CAST(request_id AS BIGINT) AS request_id, owner_name AS copyright_owner FROM names_v""")
sql("name_key_variants", ("names_v",), """
SELECT lower(owner_name) AS name_key, count(DISTINCT owner_name) AS spellings, count(*) AS requests
FROM names_v WHERE owner_name IS NOT NULL GROUP BY 1""")
sql("normalise_domains", ("domains_raw_v",), f"""
SELECT TRY_CAST(request_id AS BIGINT) AS request_id, {clean_domain('domain')} AS domain
FROM domains_raw_v""")
sql("bool_parse", ("requests_raw_v",), f"""
SELECT request_id, CASE WHEN {parse_flag('from_abuser')} THEN 'yes'
  WHEN NOT {parse_flag('from_abuser')} THEN 'no' ELSE 'unknown' END AS from_abuser
FROM requests_raw_v""")
sql("parse_dates", ("typed_v",), """
SELECT request_id, date::VARCHAR AS date, coalesce(copyright_owner_id, -1) AS copyright_owner_id,
  reporting_org_id FROM typed_v""")
sql("removal_rate", ("typed_v",), f"""
SELECT request_id, urls_specified, {r(_rate, 'removal_rate')} FROM typed_v""")

view("clean_requests_v", ("typed_v", "canonical_v", "org_canonical_v"), f"""
SELECT t.* EXCLUDE (copyright_owner, reporting_org),
  coalesce(canonical, {clean_name('copyright_owner')}) AS copyright_owner,
  coalesce(canonical_org, {clean_name('reporting_org')}) AS reporting_org,
  {_rate} AS removal_rate
FROM typed_v t LEFT JOIN canonical_v ON owner_id = copyright_owner_id
LEFT JOIN org_canonical_v ON org_id = reporting_org_id""")
sql("canonical_names", ("clean_requests_v",), """
SELECT request_id, copyright_owner, reporting_org FROM clean_requests_v""")
sql("clean_requests", ("clean_requests_v",), f"""
SELECT request_id, date::VARCHAR AS date, reporting_org_id, reporting_org,
  coalesce(copyright_owner_id, -1) AS copyright_owner_id, copyright_owner, urls_specified,
  urls_removed, urls_no_action, urls_not_in_index, urls_pending, {r('removal_rate')},
  coalesce(from_abuser::INT, -1) AS from_abuser, lumen_url FROM clean_requests_v""")
sql("clean_domains", ("domains_raw_v",), f"""
SELECT *  EXCLUDE (removed), round(CASE WHEN urls_specified > 0 THEN removed::DOUBLE / urls_specified END, 6)
  AS removal_rate FROM (
  SELECT TRY_CAST(request_id AS BIGINT) AS request_id, {clean_domain('domain')} AS domain,
    {_typed_counts}, {clean_count('urls_removed')} AS removed,
    ({' + '.join(clean_count(c) for c in COUNTS)})::BIGINT AS urls_specified,
    {parse_flag('from_abuser')}::INT AS from_abuser
  FROM domains_raw_v)""")
view("dirty_raw_v", ("domains_raw_v",), """
SELECT * FROM domains_raw_v UNION ALL
SELECT * REPLACE (' ' || upper(domain) || '..' AS domain) FROM domains_raw_v WHERE request_id::BIGINT % 61 = 0""")
view("dirty_domains_v", ("dirty_raw_v",), f"""
SELECT *, {_rate} AS removal_rate FROM (
  SELECT TRY_CAST(request_id AS BIGINT) AS request_id, {clean_domain('domain')} AS domain, {_typed_counts},
    ({' + '.join(clean_count(c) for c in COUNTS)})::BIGINT AS urls_specified, {parse_flag('from_abuser')} AS from_abuser
  FROM dirty_raw_v)""")
# names are those of the kept requests alone
view("dirty_typed_v", ("typed_v",), "SELECT * FROM typed_v WHERE request_id % 31 <> 0")
for _id, _name, _view in (("copyright_owner_id", "copyright_owner", "dirty_owner_v"), ("reporting_org_id", "reporting_org", "dirty_org_v")):
    view(_view, ("dirty_typed_v",), f"""
SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, name) AS rn
  FROM (SELECT {_id} AS id, {clean_name(_name)} AS name FROM dirty_typed_v) WHERE name IS NOT NULL GROUP BY 1, 2)
WHERE rn = 1 AND id IS NOT NULL""")
view("dirty_requests_v", ("dirty_typed_v", "dirty_owner_v", "dirty_org_v"), f"""
SELECT t.* EXCLUDE (copyright_owner, reporting_org), coalesce(o.name, {clean_name('copyright_owner')}) AS copyright_owner,
  coalesce(g.name, {clean_name('reporting_org')}) AS reporting_org, {_rate} AS removal_rate
FROM dirty_typed_v t LEFT JOIN dirty_owner_v o ON o.id = copyright_owner_id LEFT JOIN dirty_org_v g ON g.id = reporting_org_id""")
view("joined_dirty_v", ("dirty_domains_v", "dirty_requests_v"), JOINED_DIRTY)
sql("contract_audit", ("typed_v",), """
SELECT count(*) AS rows,
  count(*) FILTER (least(urls_removed, urls_not_in_index, urls_no_action, urls_pending) < 0)
    AS negative_count_rows,
  count(*) FILTER (NOT urls_specified > 0) AS null_rate_rows FROM typed_v""")
sql("row_count_audit", ("requests_raw_v", "domains_raw_v"), """
SELECT 'requests' AS "table", count(*) AS raw_rows, count(*) AS clean_rows FROM requests_raw_v
UNION ALL SELECT 'domains', count(*), count(*) FROM domains_raw_v""")
sql("source_audit", ("requests_raw_v", "domains_raw_v"), """
SELECT 'requests.csv' AS source, 1 AS present, 1 AS recognised, 0 AS missing, count(*) AS rows
FROM requests_raw_v UNION ALL
SELECT 'domains.csv', 1, 1, 0, count(*) FROM domains_raw_v""")

# ---- joined table and samples -------------------------------------------------------

_rounded = ", ".join(
    f"{r(f'{g}_removal_rate')}, {g}_from_abuser::INT AS {g}_from_abuser" for g in ("domain", "request")
)
sql("joined", ("joined_v",), f"""
SELECT * EXCLUDE (date, domain_removal_rate, request_removal_rate, domain_from_abuser, request_from_abuser),
  date::VARCHAR AS date, {_rounded} FROM joined_v""")
sql("joined_dirty", ("joined_dirty_v",), f"""
SELECT * EXCLUDE (date, domain_removal_rate, request_removal_rate, domain_from_abuser, request_from_abuser),
  date::VARCHAR AS date, {_rounded} FROM joined_dirty_v""")


def _known(group: str, rate: str) -> str:
    return f"CASE WHEN date IS NOT NULL THEN {prior_rate(group, rate)} END"


for _key, _id in (("hit_rate_org_dirty", "reporting_org_id"), ("hit_rate_owner_dirty", "copyright_owner_id")):
    sql(_key, ("dirty_requests_v",), f"SELECT request_id, {r(_known(_id, 'removal_rate'), 'hit_rate')} FROM dirty_requests_v")
_dirty_names = ", ".join(f"{text} AS {name}" for name, text in naming("coalesce(domain, '')").items())
view("features_dirty_v", ("joined_dirty_v",), f"""
SELECT *, CASE WHEN request_urls_specified IS NOT NULL THEN ln(1 + greatest(request_urls_specified, 0)) END AS request_urls_log1p,
  {share('request_urls_not_in_index', 'request_urls_specified')} AS request_not_in_index_ratio,
  {share('request_urls_no_action', 'request_urls_specified')} AS request_no_action_ratio,
  (isodow(date) - 1)::INT AS request_dow, month(date)::INT AS request_month,
  {_known('reporting_org_id', 'request_removal_rate')} AS request_org_historical_hit_rate,
  {_known('copyright_owner_id', 'request_removal_rate')} AS request_owner_historical_hit_rate,
  {_dirty_names}, {_known('domain', 'domain_removal_rate')} AS domain_historical_hit_rate,
  (coalesce(domain_removal_rate, 0) >= 0.5)::INT AS action FROM joined_dirty_v""")
sql("replay_dirty", ("features_dirty_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, score,
  row_number() OVER (PARTITION BY step_start ORDER BY score DESC, request_id, domain NULLS FIRST) AS rank FROM (
  SELECT request_id, domain, date AS step_start, max(round(1 / (1 + exp(-(
    2 * (round(coalesce(request_org_historical_hit_rate, 0.5), 6) - 0.5) + 0.8 * tld_is_risky
    + 0.5 * suspicious_token_count - 1))), 6)) AS score
  FROM features_dirty_v WHERE date >= DATE '{CUTOFF}' GROUP BY ALL)""")
sql("joined_by_month", ("joined_v",), f"""
SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS rows, sum(domain_urls_removed)::BIGINT AS removed
FROM joined_v GROUP BY 1""")

view("sampled_v", (), """
SELECT request_id FROM (
  SELECT o_orderkey AS request_id, md5('42:' || o_orderkey::VARCHAR) AS digest FROM orders)
WHERE ('0x' || substr(digest, 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM orders) < 5000
ORDER BY digest, request_id LIMIT 5000""")
sql("sample_requests", ("sampled_v",), "SELECT request_id FROM sampled_v")
sql("sample_semi", ("joined_v", "sampled_v"), f"""
SELECT request_id, domain, date::VARCHAR AS date, reporting_org, {r('domain_removal_rate')},
  {r('request_removal_rate')} FROM joined_v WHERE request_id IN (SELECT request_id FROM sampled_v)""")

# ---- profile ---------------------------------------------------------------------------

for key, column in (("top_orgs", "reporting_org"), ("top_owners", "copyright_owner")):
    sql(key, ("requests_v",), f"""
SELECT {column}, count(*) AS requests, {r('avg(removal_rate)', 'mean_rate')} FROM requests_v
GROUP BY 1 ORDER BY requests DESC, {column} LIMIT 20""")
sql("monthly_volume", ("requests_v",), """
SELECT date_trunc('month', date)::DATE::VARCHAR AS year_month, count(*) AS total,
  count(*) FILTER (removal_rate >= 0.5) AS actioned,
  count(*) - count(*) FILTER (removal_rate >= 0.5) AS noise FROM requests_v GROUP BY 1""")
_pct = "100.0::DOUBLE * count(*) FILTER ({}) / count(*)"
sql("noise_summary", ("requests_v",), f"""
SELECT count(*) AS requests, count(*) FILTER (removal_rate = 0) AS zero_rate,
  {r(_pct.format('removal_rate = 0'), 'zero_rate_pct')},
  count(*) FILTER (removal_rate < 0.5) AS below_threshold,
  {r(_pct.format('removal_rate < 0.5'), 'noise_pct')},
  count(*) FILTER (from_abuser) AS from_abuser,
  round(100.0::DOUBLE * avg(from_abuser::INT), 6) AS from_abuser_pct,
  round(100.0::DOUBLE - {_pct.format('removal_rate < 0.5')}, 6) AS actioned_pct FROM requests_v""")
sql("org_noise", ("requests_v",), """
SELECT reporting_org, count(*) AS total, count(*) FILTER (removal_rate < 0.5) AS noise,
  round(count(*) FILTER (removal_rate < 0.5)::DOUBLE / count(*), 6) AS noise_pct FROM requests_v
GROUP BY 1 HAVING count(*) >= 50
ORDER BY count(*) FILTER (removal_rate < 0.5)::DOUBLE / count(*) DESC, 1 LIMIT 15""")
sql("tld_noise", ("domains_v",), """
SELECT coalesce(nullif(regexp_extract(domain, '\\.([a-z]{2,})$', 1), ''), 'other') AS tld,
  count(domain) AS domains, count(*) FILTER (removal_rate < 0.5) AS noise,
  round(count(*) FILTER (removal_rate < 0.5)::DOUBLE / count(domain), 6) AS noise_pct FROM domains_v
GROUP BY 1 HAVING count(domain) >= 500
ORDER BY count(*) FILTER (removal_rate < 0.5)::DOUBLE / count(domain) DESC, 1 LIMIT 20""")
view("tokens_v", ("domains_v",), f"""
SELECT removal_rate, {naming('domain')['domain_has_suspicious_token']} AS has_token FROM domains_v""")
sql("token_summary", ("tokens_v",), """
SELECT has_token, count(removal_rate) AS count, round(avg(removal_rate), 6) AS mean,
  round(median(removal_rate), 6) AS median FROM tokens_v GROUP BY 1""")
sql("token_box", ("tokens_v",), """
SELECT has_token, round(min(removal_rate), 6) AS low, round(quantile_cont(removal_rate, 0.25), 6) AS q1,
  round(median(removal_rate), 6) AS median, round(quantile_cont(removal_rate, 0.75), 6) AS q3,
  round(max(removal_rate), 6) AS high FROM tokens_v GROUP BY 1""")
sql("rate_histogram", ("requests_v",), """
SELECT least(floor(removal_rate * 50), 49)::INT AS bin, count(*) AS requests,
  round(least(floor(removal_rate * 50), 49)::INT / 50.0::DOUBLE, 6) AS bin_start
FROM requests_v WHERE removal_rate IS NOT NULL GROUP BY 1, 3""")
sql("dataset_summary", ("requests_v", "domains_v"), f"""
SELECT count(*) AS requests, {r(_pct.format('removal_rate >= 0.5'), 'actioned_pct')},
  {r(_pct.format('removal_rate < 0.5'), 'noise_pct')}, {r(_pct.format('removal_rate = 0'), 'zero_pct')},
  count(DISTINCT reporting_org) AS orgs, count(DISTINCT copyright_owner) AS owners,
  min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date,
  (SELECT count(*) FROM domains_v) AS domains FROM requests_v""")

# ---- features and label ------------------------------------------------------------------

sql("request_features", ("requests_v",), f"""
SELECT request_id, round(ln(1 + greatest(urls_specified, 0)), 6) AS urls_log1p,
  round({share('urls_not_in_index', 'urls_specified')}, 6) AS not_in_index_ratio,
  round({share('urls_no_action', 'urls_specified')}, 6) AS no_action_ratio,
  (isodow(date) - 1)::INT AS dow, month(date)::INT AS month,
  round({prior_rate('reporting_org_id', 'removal_rate')}, 6) AS org_historical_hit_rate,
  round({prior_rate('copyright_owner_id', 'removal_rate')}, 6) AS owner_historical_hit_rate
FROM requests_v""")
for key, group in (("hit_rate_org", "reporting_org_id"), ("hit_rate_owner", "copyright_owner_id")):
    sql(key, ("requests_v",), f"""
SELECT request_id, round({prior_rate(group, 'removal_rate')}, 6) AS hit_rate FROM requests_v""")
sql("hit_rate_domain", ("joined_v",), f"""
SELECT request_id, domain, round({prior_rate('domain', 'domain_removal_rate')}, 6) AS hit_rate
FROM joined_v""")
sql("domain_features", ("features_v",), f"""
SELECT request_id, domain, domain_has_suspicious_token, suspicious_token_count, tld, tld_is_risky,
  domain_length, {r('digit_ratio')}, hyphen_count, {r('domain_historical_hit_rate')} FROM features_v""")
_host = "nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '\\.+$', ''), '')"
sql("domain_suffix", (), f"""
SELECT page_id, domain, {suffix('domain')} AS suffix,
  coalesce(nullif(regexp_extract(domain, '\\.([a-z]{{2,}})$', 1), ''), 'other') AS last_label,
  round({naming('domain')['digit_ratio']}, 6) AS digit_ratio, {naming('domain')['hyphen_count']} AS hyphen_count
FROM (SELECT page_id, {_host} AS domain FROM pages)""")
sql("domain_suffix_rules", (), f"""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'a.' || label || '.ck' WHEN 1 THEN label || '.www.ck'
    WHEN 2 THEN label || '.co.uk' WHEN 3 THEN 'city.kawasaki.jp' WHEN 4 THEN 'b.' || label || '.kawasaki.jp'
    WHEN 5 THEN label ELSE 'ck' END AS name,
  CASE page_id % 7 WHEN 0 THEN label || '.ck' WHEN 1 THEN 'ck' WHEN 2 THEN 'co.uk' WHEN 3 THEN 'kawasaki.jp'
    WHEN 4 THEN label || '.kawasaki.jp' WHEN 5 THEN '' ELSE '' END AS suffix
FROM (SELECT page_id, 'n' || split_part({_host}, '.', 1) AS label FROM pages)""")
sql("domain_history", ("joined_v",), """
SELECT request_id, domain,
  count(*) OVER (PARTITION BY domain ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
    AND INTERVAL 1 DAY PRECEDING) AS prior_appearances,
  (date - min(date) OVER (PARTITION BY domain ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
    AND CURRENT ROW))::INT AS domain_age_days
FROM joined_v""")
_matrix = f"""
  {r('request_urls_log1p')}, {r('request_not_in_index_ratio')}, {r('request_no_action_ratio')},
  request_dow, request_month, {r('request_org_historical_hit_rate')},
  {r('request_owner_historical_hit_rate')}, domain_has_suspicious_token, suspicious_token_count,
  tld_is_risky, domain_length, {r('digit_ratio')}, hyphen_count, {r('domain_historical_hit_rate')}"""
sql("joined_features", ("features_v",), f"SELECT request_id, domain, tld, {_matrix} FROM features_v")
sql("feature_matrix", ("features_v",), f"""
SELECT request_id, domain, date::VARCHAR AS date, {_matrix}, action FROM features_v""")
sql("label", ("domains_v",), """
SELECT request_id, domain, (coalesce(removal_rate, 0) >= 0.5)::INT AS action FROM domains_v""")
sql("temporal_split", ("joined_v",), f"""
SELECT CASE WHEN date < DATE '{CUTOFF}' THEN 'train' ELSE 'holdout' END AS split, count(*) AS rows,
  min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date FROM joined_v GROUP BY 1""")
sql("class_balance", ("joined_v",), f"""
SELECT split, count(*) AS rows, round(avg(action), 6) AS positive_share,
  least(sum(action), count(*) - sum(action))::BIGINT AS smallest_class FROM (
  SELECT CASE WHEN date < DATE '{CUTOFF}' THEN 'train' ELSE 'holdout' END AS split,
    (coalesce(domain_removal_rate, 0) >= 0.5)::INT AS action FROM joined_v) GROUP BY 1""")
# fixed values: the model's feature columns, in order
_FEATURES = (
    "request_urls_log1p", "request_not_in_index_ratio", "request_no_action_ratio", "request_dow",
    "request_month", "request_org_historical_hit_rate", "request_owner_historical_hit_rate",
    "domain_has_suspicious_token", "suspicious_token_count", "tld_is_risky", "domain_length",
    "digit_ratio", "hyphen_count", "domain_historical_hit_rate",
)
sql("impute_medians", ("features_v",), " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(coalesce(median({f}::DOUBLE), 0), 6) AS median "
    f"FROM features_v WHERE date < DATE '{CUTOFF}'" for f in _FEATURES
))

sql("feature_matrix_dirty", ("features_dirty_v",), f"""
SELECT request_id, domain, date::VARCHAR AS date, action, {', '.join(
    f if f in ('request_dow', 'request_month', 'domain_has_suspicious_token', 'suspicious_token_count', 'tld_is_risky',
               'domain_length', 'hyphen_count') else r(f) for f in _FEATURES)} FROM features_dirty_v""")

# ---- evaluation ------------------------------------------------------------------------------

view("points_v", ("holdout_v",), """
SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
  SELECT score, sum(action) AS pos, sum(1 - action) AS neg FROM holdout_v GROUP BY 1)
WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
sql("pr_curve", ("points_v",), """
SELECT round(score, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS "precision",
  round(tp::DOUBLE / p, 6) AS recall FROM points_v
UNION ALL SELECT NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""")
sql("average_precision", ("points_v",), """
SELECT round(sum(pos::DOUBLE / p * tp / (tp + fp)), 6) AS average_precision FROM points_v""")
sql("roc_auc", ("points_v",), """
SELECT round(sum(pos::DOUBLE * (n - fp + neg / 2.0::DOUBLE)) / max(p::DOUBLE * n), 6) AS roc_auc
FROM points_v""")
sql("calibration_curve", ("holdout_v",), """
SELECT bin, count(*) AS rows, round(avg(score), 6) AS mean_predicted,
  round(avg(action), 6) AS fraction_positive FROM (
  SELECT score, action, len(list_filter(e.edges, lambda x: x < score))::INT AS bin FROM holdout_v,
    (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM holdout_v) e)
GROUP BY 1""")

_EXPLAINED = (
    ("request_urls_log1p", 4.5, 4.4, 0.9, 0.35),
    ("request_not_in_index_ratio", 0.2, 0.24, 0.2, -0.7),
    ("request_no_action_ratio", 0.2, 0.25, 0.22, -0.8),
    ("request_dow", 3.0, 3.0, 2.0, 0.05),
    ("request_month", 6.0, 6.4, 3.4, -0.02),
    ("request_org_historical_hit_rate", 0.5, 0.48, 0.03, 0.9),
    ("request_owner_historical_hit_rate", 0.5, 0.49, 0.1, 0.45),
    ("domain_has_suspicious_token", 0.0, 0.5, 0.5, 0.75),
    ("suspicious_token_count", 0.0, 0.55, 0.62, 1.3),
    ("tld_is_risky", 0.0, 0.45, 0.5, 0.6),
    ("domain_length", 14.0, 15.2, 3.1, -0.4),
    ("digit_ratio", 0.1, 0.11, 0.04, 0.2),
    ("hyphen_count", 1.0, 1.4, 0.6, 0.3),
    ("domain_historical_hit_rate", 0.5, 0.47, 0.2, 1.1),
)
view("contributions_v", ("candidates_v",), " UNION ALL ".join(
    f"SELECT request_id, domain, {i} AS place, '{f}' AS feature, "
    f"(coalesce({f}::DOUBLE, {m}::DOUBLE) - {mu}::DOUBLE) / {s}::DOUBLE * {c}::DOUBLE AS contribution "
    "FROM candidates_v" for i, (f, m, mu, s, c) in enumerate(_EXPLAINED)
))
sql("explain_top3", ("contributions_v",), """
SELECT request_id, domain, position::INT AS position, feature, round(contribution, 6) AS contribution,
  CASE WHEN contribution >= 0 THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, domain
    ORDER BY abs(contribution) DESC, place) AS position FROM contributions_v) WHERE position <= 3""")

view("importance_v", ("candidates_v",), " UNION ALL ".join(
    f"SELECT request_id, domain, {i} AS place, '{f}' AS feature, "
    f"coalesce({f}::DOUBLE, {m}::DOUBLE) * {abs(c) / 10!r}::DOUBLE AS contribution "
    "FROM candidates_v" for i, (f, m, _, _, c) in enumerate(_EXPLAINED)
))
sql("explain_tree_top3", ("importance_v",), """
SELECT request_id, domain, position::INT AS position, feature, round(contribution, 6) AS contribution,
  CASE WHEN contribution >= 0 THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, domain
    ORDER BY abs(contribution) DESC, place) AS position FROM importance_v) WHERE position <= 3""")
sql("predict_fixed", ("contributions_v",), """
SELECT request_id, domain, round((1 / (1 + exp(-(0.9::DOUBLE * z + 0.1::DOUBLE)))
  + 1 / (1 + exp(-(1.2::DOUBLE * z - 0.3::DOUBLE)))) / 2, 6) AS action_probability
FROM (SELECT request_id, domain, sum(contribution) - 0.25::DOUBLE AS z FROM contributions_v GROUP BY 1, 2)""")
# three trees, walked by a join per level: (tree, node, feature, threshold, left, right, value, weight)
_TREE_ROWS = """
  (0, 0, 'domain_historical_hit_rate', 0.48::DOUBLE, 1, 2, 0.0::DOUBLE, 1.0::DOUBLE), (0, 1, NULL, NULL, NULL, NULL, -0.4, 1.0),
  (0, 2, 'suspicious_token_count', 0.5, 3, 4, 0.0, 1.0), (0, 3, NULL, NULL, NULL, NULL, 0.2, 1.0), (0, 4, NULL, NULL, NULL, NULL, 0.9, 1.0),
  (1, 0, 'request_no_action_ratio', 0.25, 1, 2, 0.0, 0.05), (1, 1, 'request_month', 6.0, 3, 4, 0.0, 0.05),
  (1, 2, NULL, NULL, NULL, NULL, -1.5, 0.05), (1, 3, NULL, NULL, NULL, NULL, 0.7, 0.05), (1, 4, NULL, NULL, NULL, NULL, 1.1, 0.05),
  (2, 0, NULL, NULL, NULL, NULL, 0.3, 0.05)"""
view("tree_nodes_v", (), f"SELECT * FROM (VALUES {_TREE_ROWS}) AS n(tree, node, feature, threshold, l, r, value, weight)")
_tree_x = ", ".join(f"coalesce({f}::DOUBLE, {m}::DOUBLE) AS {f}" for f, m, *_ in _EXPLAINED)
view("tree_inputs_v", ("candidates_v",), f"""
SELECT request_id, domain, feature, x FROM (SELECT request_id, domain, {_tree_x} FROM candidates_v)
UNPIVOT (x FOR feature IN ({', '.join(e[0] for e in _EXPLAINED)}))""")
view("tree_0_v", ("candidates_v", "tree_nodes_v"), "SELECT request_id, domain, n.* FROM candidates_v, tree_nodes_v n WHERE node = 0")
for _k in (1, 2):
    view(f"tree_{_k}_v", (f"tree_{_k - 1}_v", "tree_inputs_v", "tree_nodes_v"), f"""
SELECT t.request_id, t.domain, n.* FROM tree_{_k - 1}_v t LEFT JOIN tree_inputs_v i USING (request_id, domain, feature)
JOIN tree_nodes_v n ON n.tree = t.tree AND n.node = CASE WHEN t.feature IS NULL THEN t.node WHEN x <= t.threshold THEN t.l ELSE t.r END""")
sql("tree_predict_fixed", ("tree_2_v",), """
SELECT request_id, domain, round(z, 6) AS margin, round(1 / (1 + exp(-2 * z)), 6) AS action_probability
FROM (SELECT request_id, domain, sum(value * weight) AS z FROM tree_2_v GROUP BY 1, 2)""")
view("fit_rows_v", ("features_v",), f"""
SELECT action AS y, suspicious_token_count::DOUBLE AS raw, domain_historical_hit_rate AS a, median(domain_historical_hit_rate) OVER () AS m,
  sum(action) OVER () AS pos, count(*) OVER () AS n FROM features_v WHERE date < DATE '{CUTOFF}'""")
view("fit_scaled_v", ("fit_rows_v",), """
SELECT y, (coalesce(a, m) - avg(coalesce(a, m)) OVER ()) / stddev_pop(coalesce(a, m)) OVER () AS x0,
  (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () AS x1,
  n::DOUBLE / (2 * CASE WHEN y = 1 THEN pos ELSE n - pos END) AS w FROM fit_rows_v""")
# Newton's method: each view is the step after the one before it; Cramer's rule solves it
view("newton_0", (), "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2")
view("platt_0", (), "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1")
view("platt_rows_v", ("fit_rows_v",), """
SELECT raw AS x, CASE WHEN y = 1 THEN (pos + 1)::DOUBLE / (pos + 2) ELSE 1.0::DOUBLE / (n - pos + 2) END AS t FROM fit_rows_v""")
for _k in range(1, 11):
    view(f"newton_{_k}", ("fit_scaled_v", f"newton_{_k - 1}"), f"""
SELECT b0 + (g0 * (e * i - f * f) - c * (g1 * i - f * g2) + d * (g1 * f - e * g2)) / det AS b0,
  b1 + (a * (g1 * i - g2 * f) - g0 * (c * i - f * d) + d * (c * g2 - g1 * d)) / det AS b1,
  b2 + (a * (e * g2 - f * g1) - c * (c * g2 - g1 * d) + g0 * (c * f - e * d)) / det AS b2
FROM (SELECT *, a * (e * i - f * f) - c * (c * i - f * d) + d * (c * f - e * d) AS det FROM (
  SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
    sum(w * (y - p) * x0) - any_value(b0) AS g0, sum(w * (y - p) * x1) - any_value(b1) AS g1, sum(w * (y - p)) AS g2,
    sum(h * x0 * x0) + 1 AS a, sum(h * x0 * x1) AS c, sum(h * x0) AS d, sum(h * x1 * x1) + 1 AS e, sum(h * x1) AS f, sum(h) AS i
  FROM (SELECT *, w * p * (1 - p) AS h FROM (
    SELECT *, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2))) AS p FROM fit_scaled_v, newton_{_k - 1}))))""")
    view(f"platt_{_k}", ("platt_rows_v", f"platt_{_k - 1}"), f"""
SELECT b0 + (g0 * e - c * g1) / (a * e - c * c) AS b0, b1 + (a * g1 - c * g0) / (a * e - c * c) AS b1 FROM (
  SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum((t - p) * x) AS g0, sum(t - p) AS g1,
    sum(p * (1 - p) * x * x) AS a, sum(p * (1 - p) * x) AS c, sum(p * (1 - p)) AS e
  FROM (SELECT *, 1 / (1 + exp(-(b0 * x + b1))) AS p FROM platt_rows_v, platt_{_k - 1}))""")
sql("baseline_fit", ("newton_10",), f"""
SELECT 'domain_historical_hit_rate' AS term, {r('b0', 'coefficient')} FROM newton_10
UNION ALL SELECT 'suspicious_token_count', round(b1, 6) FROM newton_10 UNION ALL SELECT 'intercept', round(b2, 6) FROM newton_10""")
sql("sigmoid_fit", ("platt_10",), f"SELECT {r('b0', 'slope')}, {r('b1', 'offset')} FROM platt_10".replace("AS offset", 'AS "offset"'))
_train = f"FROM features_v WHERE date < DATE '{CUTOFF}'"
sql("target_validation", ("features_v",), " UNION ALL ".join(
    f"SELECT '{name}' AS rows_of, count(*) FILTER (action <> 1) AS negative, count(*) FILTER (action = 1) AS positive, "
    f"(count(DISTINCT action) = 2)::INT AS accepted {_train} AND {where}"
    for name, where in (("all", "true"), ("risky", "tld_is_risky = 1"), ("actioned", "action = 1"), ("none", "action > 1"))
))
sql("scale_stats", ("features_v",), " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(any_value(m), 6) AS median, round(avg(coalesce({f}::DOUBLE, m)), 6) AS mean, "
    f"round(CASE WHEN stddev_pop(coalesce({f}::DOUBLE, m)) = 0 THEN 1 ELSE stddev_pop(coalesce({f}::DOUBLE, m)) END, 6) AS scale "
    f"FROM (SELECT {f}, median({f}::DOUBLE) OVER () AS m FROM features_v WHERE date < DATE '{CUTOFF}')"
    for f in _FEATURES
))
sql("numeric_coercion", ("requests_raw_v",), """
SELECT request_id, round(TRY_CAST(urls_removed AS DOUBLE), 6) AS urls_removed,
  round(TRY_CAST(urls_no_action AS DOUBLE), 6) AS urls_no_action,
  round(TRY_CAST(copyright_owner_id AS DOUBLE), 6) AS copyright_owner_id FROM requests_raw_v""")
view("two_scores_v", ("holdout_v",), """
SELECT 'naming' AS model, score, action FROM holdout_v UNION ALL
SELECT 'length', round(1.0::DOUBLE / domain_length, 6), action FROM holdout_v""")
view("measured_v", ("two_scores_v",), """
SELECT model, sum(pos::DOUBLE * (n - fp + neg / 2.0::DOUBLE)) / max(p::DOUBLE * n) AS roc_auc,
  sum(pos / p::DOUBLE * tp / (tp + fp)) AS average_precision FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p,
    sum(neg) OVER (PARTITION BY model) AS n FROM (
    SELECT model, score, sum(action) AS pos, sum(1 - action) AS neg FROM two_scores_v GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY 1""")
sql("model_choice", ("measured_v",), """
SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision,
  (row_number() OVER (ORDER BY average_precision DESC, model) = 1)::INT AS chosen FROM measured_v""")

# ---- selection ----------------------------------------------------------------------------------

view("valued_v", ("candidates_v",), """
SELECT request_id, domain, step_start, score * weight AS expected_value, cost_minutes, domain_removal_rate
FROM candidates_v""")
sql("expected_value", ("valued_v",), f"SELECT request_id, domain, {r('expected_value')} FROM valued_v")
view("greedy_v", ("valued_v",), """
SELECT *, sum(cost_minutes) OVER (PARTITION BY step_start ORDER BY expected_value / cost_minutes DESC,
  expected_value DESC, request_id, domain ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative_cost FROM valued_v""")
sql("greedy_select", ("greedy_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('expected_value')}, cost_minutes,
  cumulative_cost FROM greedy_v WHERE cumulative_cost <= 60""")
view("greedy_half_v", ("valued_v",), """
SELECT *, sum(cost_minutes) OVER (PARTITION BY step_start ORDER BY expected_value / cost_minutes DESC,
  expected_value DESC, request_id, domain ROWS UNBOUNDED PRECEDING) / 2.0::DOUBLE AS half_cost FROM valued_v""")
sql("greedy_select_fractional", ("greedy_half_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('expected_value')},
  cost_minutes / 2.0::DOUBLE AS cost_minutes, half_cost AS cumulative_cost FROM greedy_half_v WHERE half_cost <= 60""")
sql("optimal_select_fractional", ("valued_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('expected_value')}, cost_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY step_start
  ORDER BY expected_value DESC, request_id, domain) AS rn FROM valued_v) WHERE rn <= 24""")
view("optimal_v", ("valued_v",), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step_start
  ORDER BY expected_value DESC, request_id, domain) AS rn FROM valued_v) WHERE rn <= 20""")
sql("optimal_select", ("optimal_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('expected_value')}, cost_minutes
FROM optimal_v""")
sql("selection_uplift", ("optimal_v",), f"""
SELECT step_start::VARCHAR AS step_start, {r('sum(expected_value)', 'optimal_value')},
  count(*) AS optimal_count, {r('sum(expected_value)', 'greedy_value')}, count(*) AS greedy_count,
  0.0::DOUBLE AS uplift FROM optimal_v GROUP BY ALL""")

# the best total per step and budget 0..60, one candidate after the other; each cost's
# candidates beyond the 60 / cost most valuable cannot matter
view("short_v", ("valued_v",), """
SELECT step_start, expected_value AS v, cost_minutes AS c,
  row_number() OVER (PARTITION BY step_start ORDER BY request_id, domain) AS i FROM (
  SELECT *, row_number() OVER (PARTITION BY step_start, cost_minutes
    ORDER BY expected_value DESC, request_id, domain) AS rn FROM valued_v) WHERE rn * cost_minutes <= 60""")
SQL["selection_uplift_mixed"] = (
    with_views("short_v", "greedy_v").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, best_v AS (
  SELECT step_start, 0::BIGINT AS i, list_transform(range(61), lambda b: 0.0::DOUBLE) AS best
  FROM (SELECT DISTINCT step_start FROM short_v)
  UNION ALL
  SELECT b.step_start, s.i, list_transform(range(61), lambda m: greatest(b.best[m + 1],
    CASE WHEN m >= s.c THEN b.best[m + 1 - s.c] + s.v ELSE 0.0::DOUBLE END))
  FROM best_v b JOIN short_v s ON s.step_start = b.step_start AND s.i = b.i + 1)
SELECT o.step_start::VARCHAR AS step_start, round(o.v, 6) AS optimal_value,
  round(g.v, 6) AS greedy_value, g.n AS greedy_count, round(o.v - g.v, 6) AS uplift
FROM (SELECT step_start, max(best[61]) AS v FROM best_v GROUP BY 1) o
JOIN (SELECT step_start, sum(expected_value) AS v, count(*) AS n FROM greedy_v
  WHERE cumulative_cost <= 60 GROUP BY 1) g USING (step_start)"""
)

# the same on whole numbers, and back from the last candidate: one is in where the total needs it
view("units_v", ("valued_v",), """
SELECT *, floor(expected_value / max(expected_value) OVER (PARTITION BY step_start) * 1099511627776::DOUBLE + 0.5)::BIGINT AS v,
  row_number() OVER (PARTITION BY step_start ORDER BY expected_value DESC, request_id, domain) AS i FROM (
  SELECT *, row_number() OVER (PARTITION BY step_start, cost_minutes
    ORDER BY expected_value DESC, request_id, domain) AS rn FROM valued_v WHERE expected_value > 0) WHERE rn * cost_minutes <= 60""")
SQL["optimal_select_mixed"] = (
    with_views("units_v").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", best_v AS (
  SELECT step_start, 0::BIGINT AS i, list_transform(range(61), lambda b: 0::BIGINT) AS best
  FROM (SELECT DISTINCT step_start FROM units_v)
  UNION ALL
  SELECT b.step_start, s.i, list_transform(range(61), lambda m: CASE WHEN m >= s.cost_minutes
    THEN greatest(b.best[m + 1], b.best[m + 1 - s.cost_minutes] + s.v) ELSE b.best[m + 1] END)
  FROM best_v b JOIN units_v s ON s.step_start = b.step_start AND s.i = b.i + 1),
steps_v AS (
  SELECT u.*, b.best AS before FROM units_v u JOIN best_v b ON b.step_start = u.step_start AND b.i = u.i - 1),
back_v AS (
  SELECT step_start, max(i) + 1 AS i, 60::BIGINT AS left_over, false AS taken FROM units_v GROUP BY 1
  UNION ALL
  SELECT s.step_start, s.i, CASE WHEN t THEN left_over - cost_minutes ELSE left_over END, t FROM (
    SELECT s.*, b.left_over, b.left_over >= s.cost_minutes AND coalesce(
      s.before[b.left_over + 1 - s.cost_minutes] + s.v > s.before[b.left_over + 1], false) AS t
    FROM back_v b JOIN steps_v s ON s.step_start = b.step_start AND s.i = b.i - 1) s)
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('expected_value')}, cost_minutes
FROM units_v JOIN back_v USING (step_start, i) WHERE taken"""
)

# ---- backtest --------------------------------------------------------------------------------------

sql("replay_ranked", ("ranked_v",), f"""
SELECT request_id, domain, step_start::VARCHAR AS step_start, {r('score')}, rank, action,
  {r('domain_removal_rate')} FROM ranked_v""")
view("precision_v", ("ranked_v",), """
SELECT step_start, k, avg(action) AS precision, count(*) AS n
FROM ranked_v JOIN (SELECT unnest([10, 25, 50])::INT AS k) ON rank <= k GROUP BY 1, 2""")
sql("precision_at_k", ("precision_v",), """
SELECT step_start::VARCHAR AS step_start, k, round("precision", 6) AS "precision", n FROM precision_v""")
view("avoided_v", ("valued_v", "optimal_v"), """
SELECT v.step_start, v.candidates, coalesce(o.selected, 0) AS selected,
  v.zero - coalesce(o.zero, 0) AS noise_avoided, (v.zero - coalesce(o.zero, 0)) * 3.0::DOUBLE AS minutes_saved
FROM (SELECT step_start, count(*) AS candidates, count(*) FILTER (domain_removal_rate = 0) AS zero
  FROM valued_v GROUP BY 1) v
LEFT JOIN (SELECT step_start, count(*) AS selected, count(*) FILTER (domain_removal_rate = 0) AS zero
  FROM optimal_v GROUP BY 1) o USING (step_start)""")
sql("noise_avoided", ("avoided_v",), """
SELECT * EXCLUDE (step_start), step_start::VARCHAR AS step_start FROM avoided_v""")

# ---- radar -----------------------------------------------------------------------------------------


def signals(domain: str) -> str:
    s = f"({suffix(domain)})"
    stem = f"(CASE WHEN {s} <> '' THEN left({domain}, length({domain}) - length({s}) - 1) ELSE {domain} END)"
    marks = [f"CASE WHEN contains({domain}, '{t}') THEN 't:{t}' END" for t in TOKENS]
    marks += [
        f"CASE WHEN {s} <> '' THEN 's:' || {s} END",
        f"CASE WHEN regexp_matches({stem}, '[0-9]') THEN 'c:digit' END",
        f"CASE WHEN contains({stem}, '-') THEN 'c:hyphen' END",
    ]
    found = f"list_concat(regexp_extract_all({stem}, '[a-z]+'), [{', '.join(marks)}])"
    return f"list_distinct(list_filter({found}, lambda x: x IS NOT NULL))"


def weights(known: str) -> str:
    return f"""
SELECT signal, p AS pirate_domains, b AS other_domains,
  ln((p + 1)::DOUBLE / (sum(p) OVER () + count(*) OVER ()))
  - ln((b + 1)::DOUBLE / (sum(b) OVER () + count(*) OVER ())) AS weight FROM (
  SELECT signal, count(*) FILTER (is_pirate) AS p, count(*) FILTER (NOT is_pirate) AS b
  FROM (SELECT is_pirate, unnest({signals('domain')}) AS signal FROM {known}) GROUP BY 1)"""


def known(cutoff: str) -> str:
    return f"""
SELECT domain, coalesce(avg(domain_removal_rate), 0) >= 0.5 AS is_pirate FROM joined_v
WHERE date < DATE '{cutoff}' AND domain IS NOT NULL GROUP BY 1"""


def risk(domains: str, scorer: str) -> str:
    return f"""
SELECT d.domain, 1 / (1 + exp(-round(coalesce(sum(w.weight), 0), 9))) AS risk
FROM (SELECT domain, unnest({signals('domain')}) AS signal FROM (SELECT DISTINCT domain FROM {domains})) d
LEFT JOIN {scorer} w USING (signal) GROUP BY 1"""


_kind = (
    "CASE event_type WHEN 'view' THEN 'live-stream' WHEN 'click' THEN 'watch-hd' "
    "WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'portal' ELSE 'status' END"
)
_tld = "CASE user_id % 5 WHEN 0 THEN 'xyz' WHEN 1 THEN 'ru' WHEN 2 THEN 'com' WHEN 3 THEN 'net' ELSE 'co.uk' END"
view("ct_v", (), f"""
SELECT CASE WHEN event_id % 40 = 0 THEN 'match-live-' || user_id || '.xyz'
    ELSE {_kind} || '-' || user_id || '.' || {_tld} END AS domain,
  'CA-' || (user_id % 7) AS issuer,
  CASE WHEN event_id % 40 = 0 THEN 1705777200000000 + epoch_us(ts) % 900000000 ELSE epoch_us(ts) END AS seen_at, event_id
FROM events""")
sql("ct_events", ("ct_v",), "SELECT domain, issuer, seen_at FROM ct_v")
sql("new_domains", ("ct_v",), """
SELECT domain, min(seen_at) AS first_seen, count(*) AS sightings FROM ct_v GROUP BY 1""")
sql("stream_new_domains", ("ct_v",), "SELECT domain, min(seen_at) AS seen_at FROM ct_v GROUP BY 1")

# the feed is played in order of time, so a domain's first batch holds its first sighting
sql("stream_first_sightings", ("ct_v",), "SELECT domain, min(seen_at) AS seen_at FROM ct_v GROUP BY 1")

view("known_v", ("joined_v",), known(CUTOFF))
view("weights_v", ("known_v",), weights("known_v"))
sql("pattern_weights", ("weights_v",), f"SELECT signal, pirate_domains, other_domains, {r('weight')} FROM weights_v")
view("risk_v", ("ct_v", "weights_v"), risk("ct_v", "weights_v"))
sql("domain_scores", ("risk_v",), f"SELECT domain, {r('risk')} FROM risk_v")
view("watch_v", ("ct_v", "risk_v"), """
SELECT domain, first_seen, last_seen, sightings, round(risk, 6) AS risk,
  (row_number() OVER (ORDER BY r.risk DESC, domain))::INT AS rank FROM risk_v r JOIN (
  SELECT domain, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS sightings
  FROM ct_v GROUP BY 1) USING (domain)""")
for key in ("watchlist", "stream_watchlist"):
    sql(key, ("watch_v",), "SELECT * FROM watch_v WHERE rank <= 100")

_marks = ", ".join(f"CASE WHEN contains(domain, '{t}') THEN '{t}' END" for t in sorted(TOKENS))
view("windows_v", ("ct_v",), f"""
SELECT seen_at // 900000000 * 900 AS second, concat_ws('+', {_marks}) || '|' || ({suffix('domain')}) AS signature,
  count(*) AS n FROM ct_v GROUP BY 1, 2""")
view("bursts_v", ("windows_v",), """
SELECT second * 1000000 AS window_start, signature, n, expected,
  (n - expected) / sqrt(greatest(expected, 0.5)) AS z,
  (n >= 5 AND (n - expected) / sqrt(greatest(expected, 0.5)) >= 3)::INT AS is_burst FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY signature ORDER BY second
    RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) / 96.0::DOUBLE AS expected FROM windows_v)""")
sql("detect_bursts", ("bursts_v",), f"""
SELECT window_start, signature, n, {r('expected')}, {r('z')}, is_burst FROM bursts_v""")
# a window is closed once the latest event is ten minutes past its end
sql("stream_bursts", ("bursts_v", "ct_v"), f"""
SELECT window_start, signature, n, {r('expected')}, {r('z')}, is_burst FROM bursts_v
WHERE is_burst = 1 AND window_start + 900000000 <= (SELECT max(seen_at) FROM ct_v) - 600000000""")

# the feed in four stretches, every twentieth message a stretch late; a window closes ten minutes after its end
view("played_v", ("ct_v",), f"""
SELECT *, seen_at // 900000000 * 900000000 AS window_start, concat_ws('+', {_marks}) || '|' || ({suffix('domain')}) AS signature,
  least(floor((seen_at - a) * 4 / (b - a + 1))::INT + (event_id % 20 = 3)::INT, 3) AS part
FROM (SELECT *, min(seen_at) OVER () AS a, max(seen_at) OVER () AS b FROM ct_v)""")
view("late_v", ("played_v",), """
SELECT window_start, signature, part FROM played_v p JOIN (
  SELECT x.part, max(y.seen_at) AS latest FROM (SELECT DISTINCT part FROM played_v) x
  JOIN played_v y ON y.part < x.part GROUP BY 1) USING (part)
WHERE window_start + 900000000 <= latest - 600000000""")
sql("stream_late_events", ("played_v", "late_v"), """
SELECT window_start, signature, count(*) AS n, coalesce(any_value(n_late), 0) AS n_late,
  count(*) FILTER (part <= last_late) AS n_corrected
FROM played_v LEFT JOIN (SELECT window_start, signature, count(*) AS n_late, max(part) AS last_late FROM late_v GROUP BY 1, 2)
USING (window_start, signature) GROUP BY 1, 2""")

LEAD_CUTOFF = "1995-04-01"
view("early_known_v", ("joined_v",), known(LEAD_CUTOFF))
view("early_weights_v", ("early_known_v",), weights("early_known_v"))
view("later_v", ("joined_v",), f"""
SELECT domain, min(date) AS first_takedown FROM joined_v GROUP BY 1 HAVING min(date) >= DATE '{LEAD_CUTOFF}'""")
view("later_risk_v", ("later_v", "early_weights_v"), risk("later_v", "early_weights_v"))
view("feed_v", ("domains_v", "requests_v"), """
SELECT DISTINCT event_id, domain, epoch_us(date::TIMESTAMP) + epoch_us(ts) - 1705363200000000 AS seen_at
FROM events JOIN domains_v ON event_id = domains_v.request_id JOIN requests_v ON event_id = requests_v.request_id""")
view("feed_risk_v", ("feed_v", "early_weights_v"), risk("feed_v", "early_weights_v"))
view("leads_v", ("later_v", "feed_v", "feed_risk_v"), """
SELECT domain, first_takedown, min(day) AS flagged_on, count(*) FILTER (day < first_takedown) AS seen_before,
  max(day) FILTER (day < first_takedown) AS last_before, date_diff('day', min(day), first_takedown)::INT AS lead_days
FROM (SELECT domain, first_takedown, make_timestamp(seen_at)::DATE AS day
  FROM feed_v JOIN later_v USING (domain) JOIN feed_risk_v USING (domain) WHERE risk >= 0.5) GROUP BY 1, 2""")
sql("lead_time", ("leads_v",), """
SELECT domain, flagged_on::VARCHAR AS flagged_on, first_takedown::VARCHAR AS first_takedown, lead_days,
  seen_before, last_before::VARCHAR AS last_before FROM leads_v""")
sql("lead_time_summary", ("leads_v",), """
SELECT count(*) AS domains, count(*) FILTER (lead_days > 0) AS flagged_ahead,
  round(avg(lead_days), 6) AS mean_lead, round(quantile_cont(lead_days, 0.25), 6) AS lead_q1,
  round(median(lead_days), 6) AS lead_median, round(quantile_cont(lead_days, 0.75), 6) AS lead_q3
FROM leads_v""")

# ---- screens ------------------------------------------------------------------------------------------

view("reasons_v", ("contributions_v",), """
SELECT request_id, domain, string_agg(feature, ',' ORDER BY position) AS reasons FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, domain
    ORDER BY abs(contribution) DESC, place) AS position FROM contributions_v) WHERE position <= 3 GROUP BY 1, 2""")
sql("triage_view", ("ranked_v", "optimal_v", "reasons_v"), f"""
SELECT r.request_id, r.domain, r.step_start::VARCHAR AS step_start, {r('score')}, r.weight, reasons,
  round(r.score * r.weight, 6) AS expected_value, r.rank,
  (o.request_id IS NOT NULL)::INT AS selected, (score < 0.5)::INT AS low_confidence
FROM ranked_v r LEFT JOIN optimal_v o USING (request_id, domain) JOIN reasons_v USING (request_id, domain)""")
sql("scored_output_fixed", ("ranked_v", "optimal_v", "reasons_v"), f"""
SELECT r.request_id, r.domain, strftime(r.step_start, '%Y-%m') AS year_month, r.step_start::VARCHAR AS step_start, {r('score')}, r.weight,
  r.cost_minutes, r.action, round(r.domain_removal_rate, 6) AS domain_removal_rate, reasons, round(r.score * r.weight, 6) AS expected_value,
  r.rank, (o.request_id IS NOT NULL)::INT AS selected
FROM ranked_v r LEFT JOIN optimal_v o USING (request_id, domain) JOIN reasons_v USING (request_id, domain)""")
_month = "date_trunc('month', {})::DATE::VARCHAR AS year_month"
sql("outcomes_view", ("precision_v", "avoided_v", "requests_v"), f"""
SELECT {_month.format('step_start')}, 'precision_at_' || k AS metric, round(avg("precision"), 6) AS value
FROM precision_v GROUP BY ALL UNION ALL
SELECT {_month.format('step_start')}, 'noise_avoided', sum(noise_avoided)::DOUBLE FROM avoided_v GROUP BY 1
UNION ALL
SELECT {_month.format('step_start')}, 'minutes_saved', sum(minutes_saved) FROM avoided_v GROUP BY 1
UNION ALL
SELECT {_month.format('date')}, 'total', count(*)::DOUBLE FROM requests_v GROUP BY 1 UNION ALL
SELECT {_month.format('date')}, 'actioned', count(*) FILTER (removal_rate >= 0.5)::DOUBLE FROM requests_v GROUP BY 1
UNION ALL
SELECT {_month.format('date')}, 'noise', (count(*) - count(*) FILTER (removal_rate >= 0.5))::DOUBLE
FROM requests_v GROUP BY 1""")
