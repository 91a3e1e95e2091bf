"""URL parts, the sixteen features, structural signals and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.patterns import from_ecmascript
from threatlake.functions.signals import signal, signal_if, signals_of, union_signals, with_verdict
from threatlake.functions.text import blank, idna_ascii, in_list, shannon_entropy, text_array
from threatlake.operators.domains import contains_ip, same_site, with_deeper_suffixes, with_registrable
from threatlake.operators.lookalike import with_lookalike
from threatlake.operators.rulesets import DEFAULT_RULES, DetectionRules

_NO_TEXT = F.lit


def _dotted(host: Column) -> Column:
    """Browser reading of numeric hosts: 1-4 decimal, octal or hex parts, the last one filling up."""

    def number(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^0x[0-9a-f]*\z"), F.coalesce(F.conv(F.nullif(F.substr(p, F.lit(3)), F.lit("")), 16, 10), F.lit("0")))
            .when(p.rlike(r"^0[0-7]+\z"), F.conv(p, 8, 10))
            .when(p.rlike(r"^[1-9]\d*\z|^0\z"), p)
        ).try_cast("bigint")

    parts = F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), number)
    n = F.size(parts)
    fine = (
        (n <= 4)
        & F.forall(parts, lambda x: x.isNotNull())
        & F.forall(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda x: x <= 255)
        & (F.get(parts, n - 1) < F.pow(F.lit(256.0), F.lit(5) - n))
    )
    value = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.get(parts, i) * F.when(i == n - 1, F.lit(1)).otherwise(F.pow(F.lit(256.0), F.lit(3) - i)).cast("bigint"),
    )
    octet = lambda s: F.shiftright(value, s).bitwiseAND(255).cast("string")
    return F.when(fine, F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``scheme, host, raw_host, port, path, query, has_credentials, authority, url_valid``.

    Parsing follows browsers rather than ``java.net.URI``, which rejects hosts and paths that
    browsers open. Default ports are dropped; numeric hosts are normalised to dotted quads.
    Dot segments in paths are kept.
    """
    raw = F.col(url)
    cleaned = F.regexp_replace(F.regexp_replace(blank(raw), r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    shape = r"(?is)^(https?):[/\\]+([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
    df = df.withColumn("__u", cleaned)
    part = lambda i: F.regexp_extract("__u", shape, i)
    df = df.withColumns(
        {
            "scheme": F.lower(F.regexp_extract("__u", r"(?i)^(https?):", 1)),
            "__auth": part(2),
            "path": F.translate(part(3), "\\", "/"),
            "query": part(4),
            "authority": F.regexp_extract(raw, r"(?i)^https?://([^/?#]*)", 1),
        }
    )
    host_port = F.substring_index("__auth", "@", -1)
    df = df.withColumns(
        {
            "__hp": host_port,
            "has_credentials": F.col("__auth").contains("@") & F.regexp_extract("__auth", r"(?s)^(.*)@", 1).rlike("[^:]"),
            "path": F.when(F.col("path") == "", "/").otherwise(F.col("path")),
        }
    )
    bracket = F.regexp_extract("__hp", r"^(\[[0-9a-fA-F:.]+\])(?::\d*)?\z", 1)
    name = F.regexp_extract("__hp", r"(?s)^([^:\[\]]*)(?::\d*)?\z", 1)
    df = df.withColumns(
        {
            "__name": F.lower(idna_ascii(F.when(bracket != "", bracket).otherwise(name))),
            "__port": F.regexp_extract("__hp", r":(\d+)\z", 1).try_cast("int"),
        }
    )
    numeric = F.col("__name").rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?\z")
    df = df.withColumn("host", F.when(numeric, _dotted(F.col("__name"))).otherwise(F.col("__name")))
    bad_host = F.col("host").rlike(r"[\x00-\x20#/<>?@\\^|%\x7f]") | (F.col("host") == "")
    valid = (F.col("scheme") != "") & ~F.coalesce(bad_host, F.lit(True)) & (F.coalesce(F.col("__port"), F.lit(0)) <= 65535)
    default = F.when(F.col("scheme") == "http", 80).otherwise(443)
    own = F.substring_index("authority", "@", -1)
    raw_host = F.when((F.col("authority") == "") | F.col("authority").contains("\\"), F.col("host")).when(
        own.startswith("["), F.regexp_extract(own, r"^(\[[^\]]*\]?)", 1)
    ).otherwise(F.regexp_replace(own, r":\d+\z", ""))
    df = df.withColumns(
        {
            "url_valid": valid,
            "port": F.when(F.col("__port") != default, F.col("__port")),
            "raw_host": raw_host,
        }
    )
    wipe = {c: F.when(F.col("url_valid"), F.col(c)) for c in ("scheme", "host", "raw_host", "port", "path", "query", "has_credentials")}
    return df.withColumns(wipe).drop("__u", "__auth", "__hp", "__name", "__port")


def _decode(c: Column, plus_is_space: bool) -> Column:
    """Percent-decoding, null where an escape is malformed."""
    return F.try_url_decode(c if plus_is_space else F.replace(c, F.lit("+"), F.lit("%2B")))


def query_pairs(query: Column) -> Column:
    """Decoded ``key, value`` pairs of a query string; empty pieces are skipped, bad escapes kept."""
    pieces = F.filter(F.split(blank(query), "&"), lambda p: p != "")

    def text(c: Column) -> Column:
        return F.coalesce(_decode(c, True), F.translate(c, "+", " "))

    return F.transform(
        pieces,
        lambda p: F.struct(
            text(F.substring_index(p, "=", 1)).alias("key"),
            text(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("value"),
        ),
    )


def url_features(df: DataFrame, rules: DetectionRules = DEFAULT_RULES, url: str = "url") -> DataFrame:
    """Add the sixteen features as columns named by ``FEATURE_ORDER`` (null for invalid URLs)."""
    if "url_valid" not in df.columns:
        df = with_url_parts(df, url)
    df = with_registrable(df, "host", "registrable", "registrable_is_suffix")
    host, raw = F.col("host"), F.col(url)
    df = df.withColumns({"pairs": query_pairs(F.col("query")), "hasIp": contains_ip(host).cast("int")})
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    hay = F.lower(F.concat(host, F.col("path")))
    df = df.withColumns({"__hay": hay, "__label": F.substring_index("registrable", ".", 1)})
    labels = lambda c: F.size(F.split(c, r"\."))
    out = {
        "length": F.length(raw),
        "hostLength": F.length(host),
        "subdomains": F.when(F.col("hasIp") == 1, 0).otherwise(F.greatest(labels(host) - labels(F.col("registrable")), F.lit(0))),
        "specialChars": count(raw, "[^a-zA-Z0-9]"),
        "hyphens": count(host, "-"),
        "digitRatio": F.coalesce(F.try_divide(count(host, "[0-9]"), F.length(host)), F.lit(0.0)),
        "hostEntropy": shannon_entropy(F.col("__label")),
        "pathDepth": F.size(F.filter(F.split(F.col("path"), "/"), lambda p: p != "")),
        "queryParams": F.size("pairs"),
        "hasAt": F.col("has_credentials").cast("int"),
        "isHttps": (F.col("scheme") == "https").cast("int"),
        "hasPunycode": host.contains("xn--").cast("int"),
        "suspiciousTld": in_list(F.substring_index(host, ".", -1), rules.tlds).cast("int"),
        "isShortener": in_list(F.col("registrable"), rules.shorteners).cast("int"),
        "keywordCount": F.size(F.filter(text_array(rules.keywords), lambda k: F.col("__hay").contains(k))),
    }
    valid = F.col("url_valid")
    out = {k: F.when(valid, v) for k, v in out.items()}
    out["hasIp"] = F.when(valid, F.col("hasIp"))
    return df.withColumns(out).drop("__hay", "__label")


def feature_vector(df: DataFrame, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(P.FEATURE_ORDER), outputCol=out, handleInvalid="skip").transform(df)


def mixed_script(host: Column) -> Column:
    """A label that mixes Latin, Cyrillic or Greek letters."""
    return F.exists(
        F.split(host, r"\."),
        lambda label: (
            label.rlike(r"\p{IsLatin}").cast("int")
            + label.rlike(r"\p{IsCyrillic}").cast("int")
            + label.rlike(r"\p{IsGreek}").cast("int")
        )
        > 1,
    )


def _candidates(c: Column) -> Column:
    """A value and what it decodes to, at most twice, stopping at a fixed point or a bad escape."""
    once = _decode(c, False)
    twice = _decode(once, False)
    return F.array_distinct(F.array_compact(F.array(c, once, twice)))


def external_redirects(df: DataFrame) -> DataFrame:
    """Add ``external_redirect``: a redirect-like parameter or the path carries a URL of another site."""
    df = with_deeper_suffixes(df, "registrable")
    keyed = F.filter("pairs", lambda p: in_list(F.lower(p["key"]), P.REDIRECT_KEYS))
    values = F.flatten(F.transform(keyed, lambda p: _candidates(p["value"])))
    suspect = F.concat(F.col("path"), F.lit("?"), F.col("query")).rlike(r"(?i)//|%2f|%25|https?:")
    df = df.withColumn("__cand", F.when(F.col("url_valid") & suspect, F.concat(values, _candidates(F.col("path")))))
    embedded = F.flatten(
        F.transform(
            "__cand",
            lambda v: F.concat(
                F.array(v), F.regexp_extract_all(v, F.lit(r"(?i)(?:https?:)?//[^\s\"'<>]+"), F.lit(0))
            ),
        )
    )
    authority = lambda d: F.regexp_extract(d, r"(?i)^(?:https?:[/\\]*|//)([^/?#\\]+)", 1)
    hosts = F.transform(
        embedded,
        lambda d: F.regexp_replace(
            F.lower(F.regexp_replace(F.substring_index(authority(d), "@", -1), r":\d*\z", "")), r"\.\z", ""
        ),
    )
    usable = F.filter(hosts, lambda h: (h != "") & ~h.rlike(r"[\x00-\x20#/<>?@\\^|%\x7f:]"))
    df = df.withColumn("__dest", F.array_distinct(usable))
    off = F.exists(
        "__dest",
        lambda h: ~same_site(h, F.col("registrable"), F.col("registrable_is_suffix"), F.col("suffixes_below")),
    )
    return df.withColumn("external_redirect", F.coalesce(off, F.lit(False))).drop("__cand", "__dest", "suffixes_below")


def structural_signals(url: str = "url") -> Column:
    """Signals of one URL from its feature columns, in their fixed order."""
    c, raw = F.col, F.col(url)
    path = F.coalesce(_decode(c("path"), False), c("path"))
    sensitive = F.exists(
        "pairs", lambda p: in_list(F.translate(F.lower(p["key"]), "-_", ""), P.SENSITIVE_QUERY_KEYS)
    )
    encoded = F.regexp_count(raw, F.lit("%[0-9a-fA-F]{2}"))
    hidden = (
        raw.rlike(r"(?i)%(?:0[0-9a-f]|1[0-9a-f]|7f)")
        | raw.rlike("[\\u0000-\\u001f\\u007f-\\u009f\\u202a-\\u202e\\u2066-\\u2069]")
        | c("authority").contains("\\")
    )
    tier = lambda col, *steps: F.coalesce(*[F.when(col >= at, w) for at, w in steps])
    long_url = tier(c("length"), (501, 25), (201, 15), (101, 8))
    long_domain = tier(c("hostLength"), (51, 20), (31, 10))
    subdomains = tier(c("subdomains"), (5, 25), (3, 15))
    found = signals_of(
        signal_if(c("hasIp") == 1, "ip-host", 40, "Uses a bare address instead of a domain name"),
        signal_if(c("hasAt") == 1, "credentials-in-url", 30, "Has a user part that can hide the real destination"),
        signal_if(c("hasPunycode") == 1, "punycode", 25, "Domain uses international characters"),
        signal_if(mixed_script(c("raw_host")), "mixed-script", 30, "Domain mixes look-alike alphabets"),
        signal_if(c("isHttps") == 0, "no-https", 10, "Connection is not encrypted (HTTP)"),
        signal_if(long_url.isNotNull(), "long-url", long_url, "Long link"),
        signal_if(long_domain.isNotNull(), "long-domain", long_domain, "Long domain name"),
        signal_if(subdomains.isNotNull(), "many-subdomains", subdomains, "Many subdomains"),
        signal_if(c("hyphens") >= 3, "many-hyphens", 15, "Domain has many hyphens"),
        signal_if(c("port").isNotNull(), "unusual-port", 15, F.concat(F.lit("Unusual port "), c("port").cast("string"))),
        signal_if(c("suspiciousTld") == 1, "suspicious-tld", 15, "Often abused domain ending"),
        signal_if(c("isShortener") == 1, "shortener", 15, "Shortened link"),
        signal_if((c("digitRatio") > 0.3) & (c("hostLength") > 10), "digit-heavy", 12, "Domain is full of digits"),
        F.when(c("keywordCount") >= 2, signal("keywords", 20, "Several sign-in or payment words"))
        .when(c("keywordCount") == 1, signal("keyword", 8, "A sign-in or payment word")),
        signal_if(path.rlike(from_ecmascript(P.SENSITIVE_PATH)), "sensitive-path", 14, "Path of a sign-in or payment step"),
        F.when(sensitive, signal("sensitive-query", 15, "Parameters ask for account or payment data"))
        .when(c("queryParams") >= 6, signal("many-query-params", 10, "Many query parameters")),
        signal_if(raw.rlike("%(?![0-9a-fA-F]{2})"), "malformed-encoding", 30, "Broken percent escape"),
        signal_if(hidden, "suspicious-characters", 25, "Hidden control or direction characters"),
        signal_if((encoded >= 5) & (encoded / F.length(raw) > 0.08), "encoded-obfuscation", 15, "Dense percent escapes"),
        signal_if(c("external_redirect"), "external-redirect", 30, "Carries a URL of another site"),
    )
    lure = F.col("lookalike").isNotNull() & (c("keywordCount") >= 2)
    imitation = F.when(
        c("hasIp") == 0,
        signals_of(
            c("lookalike"),
            signal_if(lure, "brand-credential-lure", 50, F.concat(F.lit("Imitates "), c("brand"), F.lit(" and asks to sign in"))),
        ),
    )
    invalid = signals_of(signal("invalid-url", 30, "Malformed link or unsupported protocol"))
    return F.when(F.coalesce(c("url_valid"), F.lit(False)), union_signals(found, imitation)).otherwise(invalid)


_HELPERS = ["pairs", "authority", "registrable_is_suffix", "external_redirect", "has_credentials", "brand", "lookalike"]


def url_signals(df: DataFrame, rules: DetectionRules = DEFAULT_RULES, url: str = "url", keep: bool = False) -> DataFrame:
    """Add ``signals`` to each URL row; ``keep`` leaves parts and features in place."""
    parts = url_features(df, rules, url)
    parts = external_redirects(parts)
    parts = with_lookalike(parts, "raw_host", rules)
    out = parts.withColumn("signals", structural_signals(url))
    if keep:
        return out
    added = ["scheme", "host", "raw_host", "port", "path", "query", "url_valid", "registrable", *P.FEATURE_ORDER]
    return out.drop(*_HELPERS, *[c for c in added if c not in df.columns])


def scan_urls(df: DataFrame, rules: DetectionRules = DEFAULT_RULES, url: str = "url") -> DataFrame:
    """Verdict per row, computed once per distinct URL."""
    return with_verdict(url_signals(df, rules, url))
