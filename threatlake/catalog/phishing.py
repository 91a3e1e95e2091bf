"""Registered queries of the URL and message analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatlake import fixed_values_phishing as P
from threatlake.catalog import phishing_oracle as O
from threatlake.catalog.endpoint_oracle import q
from threatlake.catalog.fixtures import messages, tables, urls
from threatlake.catalog.registry import Catalog, as_long
from threatlake.session import cut_lineage
from threatlake.functions.signals import signal_ids
from threatlake.functions.text import blank
from threatlake.operators import decisions, domains, links, lookalike, rulesets, text as T, urls as U

catalog = Catalog()
query = catalog.query

# --- URLs -----------------------------------------------------------------------------------------------


@query("url_parts", f"WITH {O.PARTS} SELECT page_id, url, url_valid, CASE WHEN url_valid THEN scheme ELSE '' END AS scheme, CASE WHEN url_valid THEN host ELSE '' END AS host, CASE WHEN url_valid THEN port ELSE '' END AS port, CASE WHEN url_valid THEN path ELSE '' END AS path, CASE WHEN url_valid THEN query ELSE '' END AS query, url_valid AND has_at AS has_credentials FROM p3")
def url_parts(spark, sf):
    out = U.with_url_parts(urls(spark, sf))
    return out.select("page_id", "url", "url_valid", *[blank(F.col(c).cast("string")).alias(c) for c in ("scheme", "host", "port", "path", "query")],
                      F.coalesce("has_credentials", F.lit(False)).alias("has_credentials"))


_F = ", ".join(c if c in ("digitRatio", "hostEntropy") else f"CAST({c} AS BIGINT) AS {c}" for c in P.FEATURE_ORDER).replace("digitRatio", "round(digitRatio, 9) AS digitRatio").replace("hostEntropy", "round(hostEntropy, 9) AS hostEntropy")


@query("url_features", f"WITH {O.FEATURES} SELECT page_id, {_F} FROM f")
def url_features(spark, sf):
    f = U.url_features(urls(spark, sf)).where("url_valid")
    return as_long(f.select("page_id", *[F.round(c, 9).alias(c) if c in ("digitRatio", "hostEntropy") else F.col(c) for c in P.FEATURE_ORDER]))


@query("registrable_domain", f"WITH {O.PARTS} SELECT DISTINCT host, registrable FROM p3 WHERE url_valid")
def registrable_domain(spark, sf):
    hosts = U.with_url_parts(urls(spark, sf)).where("url_valid").select("host").distinct()
    return domains.with_registrable(hosts, "host").select("host", "registrable")


@query("url_signals", f"WITH {O.SIGNALS} SELECT page_id, array_to_string(ids, ',') AS signals FROM sig")
def url_signals(spark, sf):
    return U.url_signals(urls(spark, sf)).select("page_id", signal_ids("signals").alias("signals"))


@query("external_redirect", f"WITH {O.FEATURES}, {O.REDIRECT} SELECT page_id, url IN (SELECT red_url FROM red) AS external_redirect FROM f")
def external_redirect(spark, sf):
    return U.external_redirects(U.url_features(urls(spark, sf))).where("url_valid").select("page_id", "external_redirect")


_FOREIGN = O.PARTS.replace(O.URL_VIEW, f"raw AS ({O.URLS.format(pages='pages')}), src AS (SELECT * REPLACE (CASE WHEN page_id % 3 = 0 THEN translate(url, 'a', 'а') ELSE url END AS url) FROM raw)")
_LABELS = "list_filter(string_split(host, '.'), lambda l: CAST(regexp_matches(l, '\\p{Latin}') AS INT) + CAST(regexp_matches(l, '\\p{Cyrillic}') AS INT) + CAST(regexp_matches(l, '\\p{Greek}') AS INT) > 1)"


# An encoded label has at least five characters more, and two for each letter beyond ASCII; more than 63 are no host name.
_TOO_LONG = "list_filter(string_split(host, '.'), lambda l: regexp_matches(l, '[^\\x00-\\x7F]') AND len(l) + 5 + 2 * len(regexp_replace(l, '[\\x00-\\x7F]', '', 'g')) > 63)"


@query("mixed_script", f"WITH {_FOREIGN} SELECT page_id, host AS raw_host FROM p3 WHERE url_valid AND len({_LABELS}) > 0 AND len({_TOO_LONG}) = 0")
def mixed_script(spark, sf):
    """Hosts with their 'a' written in Cyrillic on every third page; rows with a mixed label."""
    raw = urls(spark, sf).select("page_id", F.when(F.col("page_id") % 3 == 0, F.translate("url", "a", "а")).otherwise(F.col("url")).alias("url"))
    return U.with_url_parts(raw).where("url_valid").where(U.mixed_script(F.col("raw_host"))).select("page_id", "raw_host")


@query("confusable_fold", f"WITH {O.PARTS} SELECT DISTINCT host, {O.fold('host', 'l')} AS folded_l, {O.fold('host', 'i')} AS folded_i FROM p3 WHERE url_valid")
def confusable_fold(spark, sf):
    hosts = U.with_url_parts(urls(spark, sf)).where("url_valid").select("host").distinct()
    return hosts.select("host", lookalike.fold_confusables(F.col("host"), "l").alias("folded_l"), lookalike.fold_confusables(F.col("host"), "i").alias("folded_i"))


@query("domain_lookalike", f"WITH {O.PARTS}, {O.LOOKALIKE} SELECT host, brand, id FROM looks")
def domain_lookalike(spark, sf):
    parts = U.with_url_parts(urls(spark, sf)).where(F.col("url_valid") & ~domains.contains_ip(F.col("host")))
    return lookalike.lookalike_hosts(parts.select("host")).select("host", "brand", F.col("lookalike.id").alias("id"))


@query("score_signals", f"WITH {O.VERDICT} SELECT page_id, score, {O.level('score')} AS level, CAST(len(ids) AS BIGINT) AS n FROM verdict")
def score_signals(spark, sf):
    return as_long(U.scan_urls(urls(spark, sf)).select("page_id", "score", "level", F.size("signals").alias("n")))


@query("top_reasons", f"WITH {O.VERDICT} SELECT page_id, list_reverse_sort(ws)[1] AS w1, CAST(least(5, len(ids)) AS BIGINT) AS reasons FROM verdict WHERE len(ids) > 0".replace("list_reverse_sort(ws)[1] AS w1", "CAST(list_reverse_sort(ws)[1] AS BIGINT) AS w1"))
def top_reasons(spark, sf):
    s = U.scan_urls(urls(spark, sf)).where(F.size("signals") > 0)
    return as_long(s.select("page_id", F.get("signals", F.lit(0))["weight"].alias("w1"), F.size("reasons").alias("reasons")))


@query("distinct_hosts", f"WITH {O.PARTS} SELECT host, count(DISTINCT url) AS urls, count(*) AS pages FROM p3 WHERE url_valid GROUP BY host")
def distinct_hosts(spark, sf):
    """Unique addresses and hosts: two levels of grouping instead of a distinct aggregate per host."""
    per_url = U.with_url_parts(urls(spark, sf)).where("url_valid").groupBy("host", "url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.sum("n").alias("pages"))


_ANCHORS = "regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)"
_LINKS = f"""l0 AS (SELECT page_id, concat('https://www.example.com', unnest({_ANCHORS})) AS href, trim(unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2))) AS txt FROM pages),
  l1 AS (SELECT page_id, href, CASE page_id % 4 WHEN 0 THEN 'https://paypal.com/login' WHEN 1 THEN 'Example.com' WHEN 2 THEN 'example.org/page' ELSE txt END AS label FROM l0)"""


@query("src_pages", """SELECT page_id, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, trim(unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2))) AS label FROM pages)""")
def src_pages(spark, sf):
    from threatlake.sources.html import anchors

    return anchors(tables(spark, sf, "pages")["pages"], "page_id").select("page_id", "href", "label")


@query("extract_html")
def extract_html(spark, sf):
    """Full parse: counts of anchors, images, forms and hidden texts per page."""
    from threatlake.sources.html import extract_html as run

    out = run(tables(spark, sf, "pages")["pages"].select("page_id", "html"), "page_id")
    return as_long(out.select("page_id", *[F.size(c).alias(c) for c in ("anchors", "images", "forms", "hidden_text")]))


@query("link_text_mismatch", f"""WITH {_LINKS} SELECT page_id, href, label, (regexp_extract(lower(label), '^(?:https?://)?((?:[a-z0-9-]+[.])+[a-z]{{2,}})(?:[/?#]|$)', 1) NOT IN ('', 'example.com', 'www.example.com')) AS mismatch FROM l1""")
def link_text_mismatch(spark, sf):
    from threatlake.sources.html import anchors

    a = anchors(tables(spark, sf, "pages")["pages"], "page_id").select("page_id", F.concat(F.lit("https://www.example.com"), F.col("href")).alias("href"), "label")
    k = F.col("page_id") % 4
    a = a.withColumn("label", F.when(k == 0, "https://paypal.com/login").when(k == 1, "Example.com").when(k == 2, "example.org/page").otherwise(F.col("label")))
    return links.link_mismatch(a, "label", "href").select("page_id", "href", "label", "mismatch")


@query("src_rules", f"""WITH r AS (SELECT page_id AS pos, CASE page_id % 5 WHEN 0 THEN 'brand' WHEN 1 THEN 'tld' WHEN 2 THEN 'shortener' WHEN 3 THEN 'keyword' ELSE 'brand' END AS kind, page_id FROM pages)
  SELECT kind, name FROM (SELECT 'brand' AS kind, concat('brand', CAST(page_id AS VARCHAR)) AS name FROM r WHERE page_id % 5 = 0 UNION ALL
  SELECT 'tld', concat('t', CAST(page_id % 40 AS VARCHAR)) FROM r WHERE page_id % 5 = 1 UNION ALL SELECT 'shortener', concat('s', CAST(page_id % 40 AS VARCHAR), '.example') FROM r WHERE page_id % 5 = 2 UNION ALL
  SELECT 'keyword', concat('word', CAST(page_id % 40 AS VARCHAR)) FROM r WHERE page_id % 5 = 3) GROUP BY ALL""")
def src_rules(spark, sf):
    """Rule lines derived from page ids; the invalid brand lines are rejected."""
    n = F.col("page_id").cast("string")
    m = (F.col("page_id") % 40).cast("string")
    k = F.col("page_id") % 5
    lines = tables(spark, sf, "pages")["pages"].select(
        F.when(k == 1, "tld").when(k == 2, "shortener").when(k == 3, "keyword").otherwise("brand").alias("kind"),
        F.col("page_id").alias("pos"),
        F.when(k == 0, F.concat(F.lit(" Brand"), n, F.lit(" = a"), n, F.lit(".com, A"), n, F.lit(".COM")))
        .when(k == 1, F.concat(F.lit(".T"), m, F.lit(", t"), m))
        .when(k == 2, F.concat(F.lit("S"), m, F.lit(".example")))
        .when(k == 3, F.concat(F.lit("Word"), m))
        .otherwise(F.concat(F.lit("bad rule "), n)).alias("line"),
    )
    return rulesets.parse_rules(lines)[0].select("kind", "name")


# --- messages --------------------------------------------------------------------------------------------

_BODY = "text"
_PLAIN = [r for r in P.SCAM_RULES if not r[4]]
_RULE_IDS = ", ".join(f"CASE WHEN regexp_matches({_BODY}, {q(r[5].replace(chr(92) + '/', '/'))}, 'i') THEN {q(r[0])} END" for r in _PLAIN)


@query("scam_rules", f"WITH {O.MSG_VIEW} SELECT doc_id, array_to_string(list_filter([{_RULE_IDS}], {O.NOT_NULL}), ',') AS rules FROM msg")
def scam_rules(spark, sf):
    """First matches of every rule, context aside."""
    m = messages(spark, sf)
    return T.scam_signals(m, "text", context=False).select("doc_id", signal_ids("scam").alias("rules"))


_CONTEXT = [r for r in _PLAIN if r[3]]


def _found(name: str, pattern: str) -> str:
    """Matches of a pattern and the text between them, from which their places follow."""
    p = q(pattern.replace(chr(92) + "/", "/"))
    return f"regexp_extract_all({_BODY}, {p}, 0, 'i') AS h_{name}, regexp_split_to_array({_BODY}, {p}, 'i') AS g_{name}"


def _places(name: str) -> str:
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: len(s))), 0)"
    return f"list_transform(range(1, len(h_{name}) + 1), lambda i: CAST({size(f'g_{name}[1:i]')} + {size(f'h_{name}[1:i - 1]')} AS BIGINT)) AS p_{name}"


_NAMES = {r[0]: f"r{i}" for i, r in enumerate(_CONTEXT)}
_BEFORE = f"substring({_BODY}, greatest(p - {P.NEGATION_LOOKBACK}, 0) + 1, p - greatest(p - {P.NEGATION_LOOKBACK}, 0))"
_LIVE = f"NOT regexp_matches({_BEFORE}, {q(P.NEGATION_BEFORE)}, 'i') AND len(list_filter(p_prot, lambda x: p >= x AND p - x <= {P.PROTECTIVE_WINDOW})) = 0"
_LIVE_IDS = ", ".join(
    f"CASE WHEN len(list_filter(p_{_NAMES[r[0]]}, lambda p: {_LIVE})) > 0 THEN {q(r[0])} END" if r[3]
    else f"CASE WHEN regexp_matches({_BODY}, {q(r[5].replace(chr(92) + '/', '/'))}, 'i') THEN {q(r[0])} END"
    for r in _PLAIN
)


@query("protective_context", f"""WITH {O.MSG_VIEW}, a AS (SELECT doc_id, text, {_found("prot", P.PROTECTIVE)}, {", ".join(_found(n, next(r[5] for r in _CONTEXT if r[0] == i)) for i, n in _NAMES.items())} FROM msg),
  b AS (SELECT *, {_places("prot")}, {", ".join(map(_places, _NAMES.values()))} FROM a)
  SELECT doc_id, array_to_string(list_filter([{_RULE_IDS}], {O.NOT_NULL}), ',') AS every_match, array_to_string(list_filter([{_LIVE_IDS}], {O.NOT_NULL}), ',') AS live_match FROM b""")
def protective_context(spark, sf):
    m = messages(spark, sf)
    both = T.scam_signals(T.scam_signals(m, "text", "every", context=False).drop("tactics"), "text", "live")
    return both.select("doc_id", signal_ids("every").alias("every_match"), signal_ids("live").alias("live_match"))


# The text outside links, hidden characters removed. The given texts are in composed form, so composition changes none.
_BARE = f"regexp_replace(regexp_replace({_BODY}, '[{P.ZERO_WIDTH}]', '', 'g'), '(?i)https?://\\S+|www\\.\\S+', chr(10), 'g')"
_WORDS = "[" + ", ".join(q(w) for w in T._VOCABULARY) + "]"
_SPREAD = "regexp_extract_all(bare, '(^|[^A-Za-z0-9_])((?:[A-Za-z][ \\t.\\-_*]){2,}[A-Za-z])($|[^A-Za-z0-9_])', 2)"
_SHUT = "regexp_replace(m, '[ \\t.\\-_*]', '', 'g')"
_PUT = f"translate(lower(w), {q(P.LEET[0])}, {q(P.LEET[1])})"


_SPREAD_SQL = f"""list_filter({_SPREAD}, lambda m: len({_SHUT}) >= 5 OR list_contains({_WORDS}, lower({_SHUT}))) AS spread,
    list_filter(regexp_extract_all(bare, '\\S+'), lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[\\x{{370}}-\\x{{3FF}}\\x{{400}}-\\x{{4FF}}]')) AS mixed,
    list_filter(regexp_extract_all(bare, '[A-Za-z0-9@$]{{3,}}'), lambda w: regexp_matches(w, '[013457@$]') AND NOT regexp_matches(w, '[0-9]{{3}}') AND regexp_matches(w, '[A-Za-z]')
      AND (list_contains({_WORDS}, replace({_PUT}, '1', 'i')) OR list_contains({_WORDS}, replace({_PUT}, '1', 'l')))) AS leet"""


@query("text_deobfuscate", f"""WITH {O.MSG_VIEW}, a AS (SELECT doc_id, text, {_BARE} AS bare, len(text) - len(regexp_replace(text, '[{P.ZERO_WIDTH}]', '', 'g')) AS hidden FROM msg),
  b AS (SELECT *, {_SPREAD_SQL} FROM a)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN hidden >= 2 THEN 'obfuscation-hidden-chars' END, CASE WHEN len(mixed) > 0 THEN 'obfuscation-mixed-script' END,
    CASE WHEN len(spread) > 0 THEN 'obfuscation-spaced-letters' END, CASE WHEN len(leet) > 0 THEN 'obfuscation-leet' END], {O.NOT_NULL}), ',') AS signals,
    len(text) - hidden - CAST(coalesce(list_sum(list_transform(spread, lambda m: len(m) - len({_SHUT}))), 0) AS BIGINT) AS clean_length FROM b""")
def text_deobfuscate(spark, sf):
    out = T.deobfuscate(messages(spark, sf))
    return as_long(out.select("doc_id", signal_ids("obfuscation").alias("signals"), F.length("clean_text").alias("clean_length")))


_LINK = "regexp_extract_all(" + _BODY + ", '(?:https?://|www[.])[^\\s<>\"'')]+', 0, 'i')"
_CUT = f"list_transform({_LINK}, lambda u: regexp_replace(u, '[.,;:!?]+$', ''))"
_FULL = f"list_transform({_CUT}, lambda u: CASE WHEN regexp_matches(u, '^https?:', 'i') THEN u ELSE concat('http://', u) END)"


@query("extract_links", f"WITH {O.MSG_VIEW} SELECT doc_id, array_to_string({_FULL}, ' ') AS links FROM msg WHERE len({_LINK}) > 0")
def extract_links(spark, sf):
    m = messages(spark, sf)
    return T.text_links(m).where(F.size("links") > 0).select("doc_id", F.array_join("links", " ").alias("links"))


_WORST = f"""lk AS (SELECT doc_id, unnest({_FULL}) AS url, generate_subscripts({_FULL}, 1) AS pos FROM msg WHERE len({_LINK}) > 0),
  src AS (SELECT url, min(doc_id) AS page_id, 0 AS user_id, '' AS html FROM lk GROUP BY url)"""
_LINK_VERDICT = O.VERDICT.replace(O.URL_VIEW, f"{O.MSG_VIEW}, {_WORST}")


@query("risky_link", f"""WITH {_LINK_VERDICT}, best AS (SELECT doc_id, arg_max(struct_pack(url := lk.url, host := host, score := score), struct_pack(a := score, b := -pos)) AS w FROM lk JOIN verdict USING (url) GROUP BY doc_id)
  SELECT doc_id, w.url AS url, w.host AS host, w.score AS score FROM best""")
def risky_link(spark, sf):
    m = T.text_links(messages(spark, sf)).where(F.size("links") > 0)
    w = T.worst_links(cut_lineage(m.select("doc_id", "links")), "doc_id")
    return as_long(w.select("doc_id", F.col("worst.url").alias("url"), F.col("worst.host").alias("host"), F.col("worst.score").alias("score")))


_NAMED = "CASE " + " ".join(
    f"WHEN (regexp_matches(low, '\\b{n}\\b')" + (f" OR contains(solid, '{n}')" if len(n) >= 7 else "") + f") AND NOT list_has_any(regs, [{', '.join(q(d) for d in ds)}]) THEN {q(n)}"
    for n, ds in P.BRANDS
) + " END"


@query("brand_link_mismatch", f"""WITH {O.MSG_VIEW}, a AS (SELECT doc_id, lower({_BODY}) AS low, regexp_replace(lower({_BODY}), '\\s+', '', 'g') AS solid, {_FULL} AS links FROM msg WHERE len({_LINK}) > 0),
  b AS (SELECT *, list_transform(links, lambda u: {O.reg("lower(regexp_extract(u, '^https?://([^/?#:]*)', 1, 'i'))")}) AS regs FROM a)
  SELECT doc_id, {_NAMED} AS brand FROM b WHERE {_NAMED} IS NOT NULL""")
def brand_link_mismatch(spark, sf):
    m = T.text_links(messages(spark, sf)).where(F.size("links") > 0)
    m = cut_lineage(m.select("doc_id", "links", T.named_brands(F.col("text")).alias("named")))
    w = T.worst_links(m, "doc_id").select("doc_id", "link_domains")
    j = m.join(w, "doc_id").withColumn("brand", T.unlinked_brand(F.col("named"), F.col("link_domains")))
    return j.where(F.col("brand").isNotNull()).select("doc_id", "brand")


_PHONE = r"(?:(?:\+?91[\s-]?)?\b[6-9]\d{9}\b|\b1800[\s-]?\d{3}[\s-]?\d{3,4}\b|\+\d{1,3}[\s-]?\d{6,12}\b)"


@query("callback_number", f"WITH {O.MSG_VIEW} SELECT doc_id, regexp_extract({_BODY}, {q(P.PHONE_PATTERN)}, 0) AS phone FROM msg WHERE regexp_matches({_BODY}, {q(P.CALL_VERB + '.{0,36}?' + _PHONE)}, 'is')")
def callback_number(spark, sf):
    m = messages(spark, sf).withColumn("phone", T.callback_number(F.col("text")))
    return m.where(F.col("phone").isNotNull()).select("doc_id", "phone")


_LET, _UP = f"len(regexp_replace({_BODY}, '[^A-Za-z]', '', 'g'))", f"len(regexp_replace({_BODY}, '[^A-Z]', '', 'g'))"


@query("style_cues", f"""WITH {O.MSG_VIEW} SELECT doc_id, array_to_string(list_filter([CASE WHEN {_LET} >= 30 AND {_UP}::DOUBLE / {_LET} > 0.6 THEN 'shouting' END,
  CASE WHEN len(regexp_replace({_BODY}, '[^!]', '', 'g')) >= 3 THEN 'exclamation-spam' END], {O.NOT_NULL}), ',') AS signals FROM msg""")
def style_cues(spark, sf):
    return messages(spark, sf).select("doc_id", signal_ids(T.style_signals(F.col("text"))).alias("signals"))


_TACTICS = ", ".join(f"CASE WHEN regexp_matches({_BODY}, {q(r[5].replace(chr(92) + '/', '/'))}, 'i') THEN {q(r[1])} END" for r in _PLAIN)
_STRONG = f"list_filter(list_distinct(list_filter([{_TACTICS}], {O.NOT_NULL})), lambda t: t <> 'lure')"


@query("tactic_fusion", f"WITH {O.MSG_VIEW}, t AS (SELECT doc_id, {_STRONG} AS s FROM msg) SELECT doc_id, CAST(len(s) AS BIGINT) AS tactics, CAST(CASE WHEN len(s) >= 4 THEN 35 WHEN len(s) = 3 THEN 25 WHEN len(s) = 2 THEN 12 ELSE 0 END AS BIGINT) AS weight FROM t")
def tactic_fusion(spark, sf):
    m = messages(spark, sf)
    s = T.scam_signals(m, "text", context=False)
    fused = F.get(T.fuse_tactics(F.col("tactics")), F.lit(0))["weight"]
    return as_long(s.select("doc_id", F.size(T.strong_tactics(F.col("tactics"))).alias("tactics"), F.coalesce(fused, F.lit(0)).alias("weight")))


# The whole message scan: cleaned text, rules in context, links and their verdicts, brands, call-back numbers, style and tactics.
_W = P.OBFUSCATION_WEIGHTS
_CLEARED = f"list_reduce(list_concat([regexp_replace(text, '[{P.ZERO_WIDTH}]', '', 'g')], spread), lambda t, m: replace(t, m, {_SHUT}))"
_DECODED = f"list_reduce(list_concat([{_CLEARED}], leet), lambda t, w: replace(t, w, CASE WHEN list_contains({_WORDS}, replace({_PUT}, '1', 'i')) THEN replace({_PUT}, '1', 'i') ELSE replace({_PUT}, '1', 'l') END))"
_RULE = [(r[0], r[1], r[2], f"len(list_filter(p_{_NAMES[r[0]]}, lambda p: {_LIVE})) > 0" if r[3] else f"regexp_matches({_BODY}, {q(r[5].replace(chr(92) + '/', '/'))}, 'i')") for r in _PLAIN]
_OF_RULES = lambda i: ", ".join(f"CASE WHEN {r[3]} THEN {q(r[i]) if isinstance(r[i], str) else r[i]} END" for r in _RULE)
_CALLS = f"regexp_matches({_BODY}, {q(P.CALL_VERB + '.{0,36}?' + _PHONE)}, 'is')"
_RAW_LET, _RAW_UP = _LET.replace(_BODY, "raw"), _UP.replace(_BODY, "raw")
_PARTS = [
    ("hidden >= 2", "obfuscation-hidden-chars", _W["hidden-chars"]), ("len(mixed) > 0", "obfuscation-mixed-script", _W["mixed-script"]),
    ("len(spread) > 0", "obfuscation-spaced-letters", _W["spaced-letters"]), ("len(leet) > 0", "obfuscation-leet", _W["leet"]),
    ("w.score >= 30", "risky-link", "CAST(least(60, w.score) AS INTEGER)"), (f"len(strong) > 0 AND len(links) > 0 AND {_NAMED} IS NOT NULL", "brand-link-mismatch", 35),
    ("pressure AND len(links) > 0", "pressure-plus-link", 20), ("pressure AND calls", "pressure-plus-callback", 20),
    (f"{_RAW_LET} >= 30 AND {_RAW_UP}::DOUBLE / {_RAW_LET} > 0.6", "shouting", 8), ("len(regexp_replace(raw, '[^!]', '', 'g')) >= 3", "exclamation-spam", 6),
    ("len(strong) >= 2", "multi-tactic", "CASE WHEN len(strong) >= 4 THEN 35 WHEN len(strong) = 3 THEN 25 ELSE 12 END"),
]
_SCAN_LINKS = f"""lk AS (SELECT doc_id, unnest(links) AS url, generate_subscripts(links, 1) AS pos FROM t5 WHERE len(links) > 0),
  src AS (SELECT url, min(doc_id) AS page_id, 0 AS user_id, '' AS html FROM lk GROUP BY url)"""
_SCAN = f"""{O.MSG_VIEW}, t0 AS (SELECT doc_id, text, {_BARE} AS bare, len(text) - len(regexp_replace(text, '[{P.ZERO_WIDTH}]', '', 'g')) AS hidden FROM msg),
  t1 AS (SELECT *, {_SPREAD_SQL} FROM t0), t2 AS (SELECT doc_id, text AS raw, hidden, spread, mixed, leet, {_DECODED} AS text FROM t1),
  t3 AS (SELECT *, {_found("prot", P.PROTECTIVE)}, {", ".join(_found(n, next(r[5] for r in _CONTEXT if r[0] == i)) for i, n in _NAMES.items())} FROM t2),
  t4 AS (SELECT *, {_places("prot")}, {", ".join(map(_places, _NAMES.values()))} FROM t3),
  t5 AS (SELECT doc_id, raw, hidden, spread, mixed, leet, {_FULL} AS links, list_filter([{_OF_RULES(0)}], {O.NOT_NULL}) AS ids0, list_filter([{_OF_RULES(2)}], {O.NOT_NULL}) AS ws0,
    list_distinct(list_filter([{_OF_RULES(1)}], {O.NOT_NULL})) AS tactics, {_CALLS} AS calls, lower({_BODY}) AS low, regexp_replace(lower({_BODY}), '\\s+', '', 'g') AS solid FROM t4)"""
_SCANNED = O.VERDICT.replace(O.URL_VIEW, f"{_SCAN}, {_SCAN_LINKS}") + f""", best AS (SELECT doc_id, arg_max(struct_pack(score := score), struct_pack(a := score, b := -pos)) AS w FROM lk JOIN verdict USING (url) GROUP BY doc_id),
  t6 AS (SELECT t5.*, best.w, list_transform(links, lambda u: {O.reg("lower(regexp_extract(u, '^https?://([^/?#:]*)', 1, 'i'))")}) AS regs, list_filter(tactics, lambda t: t <> 'lure') AS strong,
    list_has_any(tactics, [{", ".join(q(t) for t in P.PRESSURE_TACTICS)}]) AS pressure FROM t5 LEFT JOIN best USING (doc_id)),
  t7 AS (SELECT doc_id, list_concat(ids0, list_filter([{", ".join(f"CASE WHEN {c} THEN {q(i)} END" for c, i, _ in _PARTS)}], {O.NOT_NULL})) AS ids,
    list_concat(ws0, list_filter([{", ".join(f"CASE WHEN {c} THEN {w} END" for c, _, w in _PARTS)}], {O.NOT_NULL})) AS ws FROM t6),
  scanned AS (SELECT doc_id, ids, {O.noisy("ws")} AS score FROM t7)"""


@query("scan_text", f"WITH {_SCANNED} SELECT doc_id, array_to_string(list_sort(ids), ',') AS signals, score, {O.level('score')} AS level FROM scanned")
def scan_text(spark, sf):
    out = T.scan_text(messages(spark, sf), "doc_id")
    return as_long(out.select("doc_id", F.array_join(F.array_sort(F.transform("signals", lambda s: s["id"])), ",").alias("signals"), "score", "level"))


_PAGE_VIEW = f"pg AS ({O.URLS.format(pages='pages')}), msg AS (SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pg)"
_PAGE_LINKS = _SCAN_LINKS.replace("FROM lk GROUP BY url)", "FROM (SELECT url, doc_id FROM lk UNION ALL SELECT url, page_id FROM pg) GROUP BY url)")
_PAGE_SCANNED = _SCANNED.replace(_SCAN_LINKS, _PAGE_LINKS).replace(O.MSG_VIEW, _PAGE_VIEW) + f""",
  page AS (SELECT pg.page_id, list_concat(sig.ids, t7.ids) AS ids, list_concat(sig.ws, t7.ws) AS ws FROM pg JOIN t7 ON pg.page_id = t7.doc_id JOIN sig ON pg.url = sig.url),
  pages_scanned AS (SELECT page_id, ids, {O.noisy("ws")} AS score FROM page)"""


@query("scan_page", f"WITH {_PAGE_SCANNED} SELECT page_id, array_to_string(list_sort(ids), ',') AS signals, score, {O.level('score')} AS level FROM pages_scanned")
def scan_page(spark, sf):
    """Pages with their visible text (tags removed) scanned together with the address."""
    p = urls(spark, sf).withColumn("text", F.regexp_replace("html", "<[^>]*>", " ")).drop("html")
    out = T.scan_page(p, "page_id")
    return as_long(out.select("page_id", F.array_join(F.array_sort(F.transform("signals", lambda s: s["id"])), ",").alias("signals"), "score", "level"))


# --- navigation -------------------------------------------------------------------------------------------

_NAV = f"nav AS (SELECT page_id AS seq, user_id, host, score, {O.level('score')} AS level, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS sensitivity FROM verdict WHERE host <> '')"
_BLOCKED = "blocked AS (SELECT * FROM nav WHERE score >= CASE sensitivity WHEN 'high' THEN 45 WHEN 'low' THEN 75 ELSE 60 END)"


def _navigations(spark, sf):
    n = U.url_signals(urls(spark, sf), keep=True)
    from threatlake.functions.signals import with_verdict

    n = with_verdict(n).where("url_valid")
    u = F.col("user_id") % 3
    return n.select(
        F.col("page_id").alias("seq"), "user_id", F.timestamp_seconds(F.col("page_id")).alias("ts"), "host", "score", "level", "reasons",
        F.when(u == 0, "high").when(u == 1, "low").otherwise("medium").alias("sensitivity"))


@query("block_decision", f"WITH {O.VERDICT}, {_NAV}, {_BLOCKED} SELECT seq, user_id, host, score FROM blocked")
def block_decision(spark, sf):
    return as_long(decisions.blocked(_navigations(spark, sf)).select("seq", "user_id", "host", "score"))


@query("history_cap", f"WITH {O.VERDICT}, {_NAV}, {_BLOCKED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS item FROM blocked) SELECT user_id, item, host, score, level FROM r WHERE item <= 3")
def history_cap(spark, sf):
    h = decisions.block_history(decisions.blocked(_navigations(spark, sf)), items=3)
    return as_long(h.select("user_id", "item", "host", "score", "level"))


@query("allowlist_filter", f"WITH {O.VERDICT}, {_NAV} SELECT seq, user_id, host FROM nav WHERE NOT (user_id % 2 = 0 AND host = 'paypa1.com')")
def allowlist_filter(spark, sf):
    n = _navigations(spark, sf)
    allow = n.where(F.col("user_id") % 2 == 0).select("user_id", F.lit("paypa1.com").alias("host")).distinct()
    return decisions.not_allowlisted(n, allow).select("seq", "user_id", "host")


_VISITS = "SELECT event_id AS seq, ts, user_id, CASE WHEN event_type IN ('click', 'signup') THEN 'approve' ELSE 'visit' END AS kind, CASE WHEN event_id % 11 = 0 THEN 'ftp://x' ELSE concat('https://site', CAST(event_id % 3 AS STRING), '.example.com/', CASE WHEN event_id % 2 = 0 THEN '#top' ELSE '' END) END AS url FROM {events}"


@query("allow_once", f"WITH v AS ({_VISITS.format(events='events')}), w AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, split_part(url, '#', 1) ORDER BY ts, seq) AS before FROM v) SELECT seq, coalesce(before = 'approve', false) AND url LIKE 'https%' AS allowed FROM w WHERE kind = 'visit'")
def allow_once(spark, sf):
    v = spark.sql(_VISITS, **tables(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return decisions.consume_allow_once(v).select("seq", "allowed")
