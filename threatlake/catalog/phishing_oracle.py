"""Check SQL building blocks for addresses and messages."""

from __future__ import annotations

from threatlake import fixed_values_phishing as P
from threatlake.catalog.endpoint_oracle import names, q
from threatlake.catalog.fixtures import MESSAGES, URLS

URL_VIEW = f"src AS ({URLS.format(pages='pages')})"
MSG_VIEW = f"msg AS ({MESSAGES.format(documents='documents')})"
IP = "'^([0-9]{1,3}[.]){3}[0-9]{1,3}$'"


def reg(h: str) -> str:
    """Registrable domain for the suffixes that occur in the test addresses."""
    return (
        f"CASE WHEN regexp_matches({h}, {IP}) THEN {h} "
        f"WHEN regexp_matches({h}, '(^|[.])(com[.]tr|github[.]io|co[.]uk|co[.]in)$') THEN regexp_extract({h}, '([^.]+[.])?[^.]+[.][^.]+$', 0) "
        f"ELSE regexp_extract({h}, '([^.]+[.])?[^.]+$', 0) END"
    )


def entropy(s: str) -> str:
    n = f"(len({s}) - len(replace({s}, c, '')))::DOUBLE / len({s})"
    return f"-list_sum(list_transform(list_sort(list_distinct(string_split({s}, ''))), lambda c: {n} * log2({n})))"


PARTS = f"""{URL_VIEW}, p0 AS (SELECT *, regexp_matches(url, '^https?://') AS url_valid, regexp_extract(url, '^(https?)://', 1) AS scheme,
    regexp_extract(url, '^https?://([^/?#]*)', 1) AS auth, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM src),
  p1 AS (SELECT *, contains(auth, '@') AS has_at, regexp_extract(auth, '([^@]*)$', 1) AS hp, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM p0),
  p2 AS (SELECT *, regexp_extract(hp, '^([^:]*)', 1) AS host, regexp_extract(hp, ':([0-9]+)$', 1) AS port0 FROM p1),
  p3 AS (SELECT *, CASE WHEN (scheme = 'https' AND port0 = '443') OR (scheme = 'http' AND port0 = '80') THEN '' ELSE port0 END AS port,
    {reg('host')} AS registrable, list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))) AS keys,
    list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 2)) AS vals FROM p2)"""
KEYWORDS = "[" + ", ".join(q(k) for k in P.SUSPICIOUS_KEYWORDS) + "]"
FEATURES = f"""{PARTS}, f AS (SELECT *, len(url) AS length, len(host) AS hostLength, CASE WHEN regexp_matches(host, {IP}) THEN 0 ELSE len(string_split(host, '.')) - len(string_split(registrable, '.')) END AS subdomains,
    len(regexp_replace(url, '[a-zA-Z0-9]', '', 'g')) AS specialChars, len(regexp_replace(host, '[^-]', '', 'g')) AS hyphens, len(regexp_replace(host, '[^0-9]', '', 'g'))::DOUBLE / len(host) AS digitRatio,
    {entropy("split_part(registrable, '.', 1)")} AS hostEntropy, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS pathDepth, len(keys) AS queryParams,
    CASE WHEN regexp_matches(host, {IP}) THEN 1 ELSE 0 END AS hasIp, CASE WHEN has_at THEN 1 ELSE 0 END AS hasAt, CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS isHttps, 0 AS hasPunycode,
    CASE WHEN regexp_extract(host, '([^.]*)$', 1) IN {names(P.SUSPICIOUS_TLDS)} THEN 1 ELSE 0 END AS suspiciousTld, CASE WHEN registrable IN {names(P.URL_SHORTENERS)} THEN 1 ELSE 0 END AS isShortener,
    len(list_filter({KEYWORDS}, lambda k: contains(lower(concat(host, path)), k))) AS keywordCount FROM p3 WHERE url_valid)"""

BRANDS = "brands AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(n)}, [{', '.join(q(d) for d in ds)}])" for i, (n, ds) in enumerate(P.BRANDS)
) + ") AS v(ord, brand, domains))"
OFFICIAL = names([d for _, ds in P.BRANDS for d in ds])


def fold(s: str, one: str) -> str:
    s = f"replace(replace(lower({s}), 'rn', 'm'), 'vv', 'w')"
    return f"translate(translate({s}, '1', '{one}'), '03457$', 'oeasts')"


def variants(lst: str) -> str:
    return f"list_concat({lst}, list_transform({lst}, lambda t: {fold('t', 'l')}), list_transform({lst}, lambda t: {fold('t', 'i')}))"


SPANS = "flatten(list_transform(range(1, len(parts) + 1), lambda s: list_transform(range(s, len(parts) + 1), lambda e: array_to_string(parts[s:e], ''))))"
LOOKALIKE = f"""{BRANDS}, hosts AS (SELECT DISTINCT host, {reg('host')} AS registrable FROM p3 WHERE url_valid AND NOT regexp_matches(host, {IP})),
  h1 AS (SELECT *, split_part(registrable, '.', 1) AS name FROM hosts WHERE registrable NOT IN {OFFICIAL}),
  h2 AS (SELECT *, list_filter(string_split(name, '-'), lambda x: x <> '') AS parts, list_filter(string_split(replace(host[1:len(host) - len(registrable)], '-', '.'), '.'), lambda x: x <> '') AS subs FROM h1),
  h3 AS (SELECT *, list_concat({SPANS}, parts) AS toks, [{fold('name', 'l')}, {fold('name', 'i')}, replace({fold('name', 'l')}, 'i', 'l'), replace({fold('name', 'l')}, 'l', 'i')] AS vars FROM h2),
  h4 AS (SELECT host, registrable, ord, brand, CASE WHEN name = brand THEN 'brand-wrong-domain' WHEN list_contains(vars, brand) THEN 'homoglyph'
      WHEN len(brand) >= 6 AND len(list_filter(vars, lambda v: levenshtein(v, brand) = 1 OR (len(v) >= 6 AND jaro_winkler_similarity(v, brand) >= 0.93))) > 0 THEN 'typosquat'
      WHEN list_contains({variants('toks')}, brand) THEN 'brand-in-domain' WHEN list_contains({variants('subs')}, brand) THEN 'brand-in-subdomain' END AS id FROM h3 CROSS JOIN brands),
  looks AS (SELECT host, arg_min(brand, ord) AS brand, arg_min(id, ord) AS id FROM h4 WHERE id IS NOT NULL GROUP BY host)"""

_dest = "regexp_extract(d, '^(?:https?:)?//([^/?#]+)', 1)"
REDIRECT = f"""red AS (SELECT DISTINCT url AS red_url FROM (SELECT url, registrable, unnest(flatten(list_transform(cands, lambda v: list_concat([v], regexp_extract_all(v, '(?:https?:)?//[^ "<>]+'))))) AS d FROM (
    SELECT url, registrable, list_concat(flatten(list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN list_contains([{', '.join(q(k) for k in P.REDIRECT_KEYS)}], keys[i]) THEN [url_decode(vals[i]), url_decode(url_decode(vals[i]))] ELSE [] END)), [path]) AS cands FROM f))
    WHERE {_dest} <> '' AND {reg(_dest)} <> registrable)"""

_SENS = "[" + ", ".join(q(k) for k in P.SENSITIVE_QUERY_KEYS) + "]"
_PATH = "(^|[/_-])(account|billing|checkout|confirm|login|payment|password|signin|verify)($|[/_-])"
_enc = "len(regexp_extract_all(url, '%[0-9a-fA-F]{2}'))"
WEIGHTED = [
    ("hasIp = 1", "ip-host", "40"), ("hasAt = 1", "credentials-in-url", "30"), ("isHttps = 0", "no-https", "10"),
    ("length > 100", "long-url", "CASE WHEN length > 500 THEN 25 WHEN length > 200 THEN 15 ELSE 8 END"),
    ("hostLength > 30", "long-domain", "CASE WHEN hostLength > 50 THEN 20 ELSE 10 END"),
    ("subdomains >= 3", "many-subdomains", "CASE WHEN subdomains >= 5 THEN 25 ELSE 15 END"),
    ("hyphens >= 3", "many-hyphens", "15"), ("port <> ''", "unusual-port", "15"), ("suspiciousTld = 1", "suspicious-tld", "15"),
    ("isShortener = 1", "shortener", "15"), ("digitRatio > 0.3 AND hostLength > 10", "digit-heavy", "12"),
    ("keywordCount >= 2", "keywords", "20"), ("keywordCount = 1", "keyword", "8"),
    (f"regexp_matches(path, '{_PATH}')", "sensitive-path", "14"),
    (f"list_has_any(keys, {_SENS})", "sensitive-query", "15"),
    (f"NOT list_has_any(keys, {_SENS}) AND queryParams >= 6", "many-query-params", "10"),
    ("len(regexp_replace(url, '%[0-9a-fA-F]{2}', '', 'g')) <> len(replace(regexp_replace(url, '%[0-9a-fA-F]{2}', '', 'g'), '%', ''))", "malformed-encoding", "30"),
    ("regexp_matches(url, '%(0[0-9a-fA-F]|1[0-9a-fA-F]|7[fF])')", "suspicious-characters", "25"),
    (f"{_enc} >= 5 AND {_enc}::DOUBLE / len(url) > 0.08", "encoded-obfuscation", "15"),
    ("red.red_url IS NOT NULL", "external-redirect", "30"),
    ("hasIp = 0 AND looks.id IS NOT NULL", "", ""),
    ("hasIp = 0 AND looks.id IS NOT NULL AND keywordCount >= 2", "brand-credential-lure", "50"),
]
_ids = ", ".join("looks.id" if not i else f"CASE WHEN {c} THEN {q(i)} END" for c, i, _ in WEIGHTED)
_ws = ", ".join(
    "CASE looks.id WHEN 'brand-wrong-domain' THEN 45 WHEN 'typosquat' THEN 45 WHEN 'homoglyph' THEN 50 WHEN 'brand-in-domain' THEN 50 WHEN 'brand-in-subdomain' THEN 50 END"
    if not i else f"CASE WHEN {c} THEN {w} END"
    for c, i, w in WEIGHTED
)
NOT_NULL = "lambda x: x IS NOT NULL"


def noisy(weights: str, cap: int = 95) -> str:
    """Noisy OR over a list of weights, heaviest first."""
    return (
        f"CAST(floor((1 - list_reduce(list_concat([1.0::DOUBLE], list_transform(list_reverse_sort({weights}), "
        f"lambda w: 1 - least(w, {cap}) / 100.0::DOUBLE)), lambda a, b: a * b)) * 100 + 0.5) AS BIGINT)"
    )


SIGNALS = f"""{FEATURES}, {LOOKALIKE}, {REDIRECT}, sig AS (SELECT f.page_id, f.user_id, f.url, f.host, f.path, looks.brand, list_filter([{_ids}], {NOT_NULL}) AS ids, list_filter([{_ws}], {NOT_NULL}) AS ws
    FROM f LEFT JOIN looks ON f.host = looks.host LEFT JOIN red ON f.url = red.red_url
    UNION ALL SELECT page_id, user_id, url, '' AS host, '' AS path, NULL, ['invalid-url'], [30] FROM p3 WHERE NOT url_valid)"""
VERDICT = f"""{SIGNALS}, verdict AS (SELECT *, {noisy('ws')} AS score FROM sig)"""


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 60 THEN 'dangerous' WHEN {score} >= 30 THEN 'suspicious' ELSE 'safe' END"
