"""E-mail addresses in page and message text: extraction, validation, signals and assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.distance import alignment_distance, edit_distance_at_most_one
from threatlake.functions.patterns import from_ecmascript
from threatlake.functions.signals import (
    score_weights, signal, signal_if, signals_of, strongest_per_id, union_signals,
)
from threatlake.functions.text import blank, clip, idna_ascii, in_list, nfkc, text_array
from threatlake.operators.domains import with_registrable
from threatlake.operators.lookalike import with_lookalike
from threatlake.operators.rulesets import DEFAULT_RULES, DetectionRules
from threatlake.operators.text import _rewrite, matches_of
from threatlake.operators.urls import query_pairs, with_url_parts
from threatlake.session import cut_lineage

_HIDDEN = "[\\u200B-\\u200D\\u2060\\uFEFF]"
_ATOM = r"\s<>()\[\]{}\"',;"
#: What P.EMAIL_PLAIN matches, in linear time: its matches are the whole runs of these characters that hold a sign inside, so only the begin of a run is tried.
_PLAIN = rf"(?<![^{_ATOM}])[^{_ATOM}][^{_ATOM}@]*+@[^{_ATOM}]++"
#: Words that hold a sign. The classes are small, so most of a text is passed over quickly; every run lies inside a word.
_WORD = r"(?<![^ \n])[^ \n@]*+@[^ \n]*+"
_DOTS = r"(?i)\s*(?:\[dot\]|\(dot\)|\{dot\})\s*"


def _groups(text: Column, pattern: str, *groups: int, ignore_case: bool = True) -> Column:
    java = from_ecmascript(pattern, ignore_case)
    return F.arrays_zip(
        *[F.regexp_extract_all(text, F.lit(java), F.lit(g)).alias(f"g{g}") for g in groups]
    )


def _entities(text: Column) -> Column:
    """Printable ASCII entities only."""
    code = lambda m, p, base: F.conv(F.regexp_extract(m, p, 1), base, 10).try_cast("int")
    shown = lambda n: F.when(n.between(32, 126), F.char(n.cast("bigint")))
    decimal = _rewrite(text, r"&#\d{1,3};", lambda m: shown(code(m, r"&#(\d+);", 10)))
    hexed = _rewrite(decimal, r"(?i)&#x[0-9a-f]{1,2};", lambda m: shown(code(m, r"(?i)&#x([0-9a-f]+);", 16)))
    named = F.regexp_replace(F.regexp_replace(hexed, "(?i)&commat;", "@"), "(?i)&period;", ".")
    return F.when(text.contains("&"), named).otherwise(text)


def normalize_source(text: Column) -> Column:
    whole = _entities(nfkc(blank(text)))
    return F.when(whole.rlike(r"[^\x00-\x7F]"), F.regexp_replace(whole, _HIDDEN, "")).otherwise(whole)


def clean_candidate(c: Column) -> Column:
    return F.regexp_replace(c, r"^[.,:;]+|[.,:;!?]+\z", "")


def extract_emails(df: DataFrame, key: str, text: str = "text", order: str | None = None) -> DataFrame:
    """``key, address, obfuscated, source, occurrences, display_name``: one row per address of a page.

    A page may have several source rows; ``order`` is their position. All patterns run inside the row, then
    sightings are counted per address with map-side combining. ``position`` numbers the addresses of a page.
    """
    no_names = F.array().cast("array<string>")
    base = df.select(F.col(key), (F.col(order) if order else F.lit(0)).alias("_row"), normalize_source(F.col(text)).alias("_t"))
    base = base.where(F.col("_t").rlike(r"(?i)@|mailto:|[\[({]at[\])}]|\sat\s"))
    target_list = lambda c: F.filter(F.transform(F.split(c, "[,;]"), lambda v: F.trim(v)), lambda v: v != "")
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    mail = F.flatten(
        F.transform(
            _groups(F.col("_t"), P.EMAIL_MAILTO, 1, 2),
            lambda m: F.concat(
                target_list(decoded(m["g1"])),
                F.flatten(
                    F.transform(
                        F.filter(query_pairs(m["g2"]), lambda q: F.lower(q["key"]).isin("to", "cc", "bcc")),
                        lambda q: target_list(q["value"]),
                    )
                ),
            ),
        )
    )
    linked = F.col("_t").rlike("(?i)mailto:")
    bare = F.when(linked, F.regexp_replace("_t", from_ecmascript(P.EMAIL_MAILTO), " ")).otherwise(F.col("_t"))
    base = base.withColumns({"_mail": F.when(linked, mail).otherwise(no_names), "_r": bare}).drop("_t")
    rest = F.col("_r")
    names = F.transform(
        _groups(rest, P.EMAIL_DISPLAY, 1, 2, 3, ignore_case=False),
        lambda m: F.struct(
            m["g3"].alias("a"),
            F.lit("name").alias("s"),
            F.trim(
                F.regexp_replace(
                    F.when(blank(m["g1"]) != "", m["g1"]).otherwise(m["g2"]),
                    r"(?i)^(?:from|to|cc|bcc|reply-to|sender)\s*:\s*", "",
                )
            ).alias("n"),
        ),
    )
    words = F.transform(
        _groups(rest, P.EMAIL_BRACKET_WORDS, 1, 2), lambda m: F.concat(m["g1"], F.lit("@"), F.regexp_replace(m["g2"], _DOTS, "."))
    )
    bracket = F.transform(_groups(rest, P.EMAIL_BRACKET_AT, 1, 2), lambda m: F.concat(m["g1"], F.lit("@"), m["g2"]))
    spoken = F.transform(
        _groups(rest, P.EMAIL_SPOKEN, 1, 2), lambda m: F.concat(m["g1"], F.lit("@"), F.regexp_replace(m["g2"], r"(?i)\s+dot\s+", "."))
    )
    plain = F.flatten(F.transform(matches_of(rest, _WORD), lambda word: matches_of(word, from_ecmascript(_PLAIN, False))))
    no_name = F.lit(None).cast("string")
    tag = lambda arr, s: F.transform(
        arr, lambda a: F.struct(a.alias("a"), F.lit(s).alias("s"), no_name.alias("n"))
    )
    shaped = lambda test, arr: F.when(test, arr).otherwise(
        F.array().cast("array<struct<a:string,s:string,n:string>>")
    )
    disguised = rest.rlike(r"(?i)[\[({](?:at|@)[\])}]")
    found = F.concat(
        tag(F.col("_mail"), "mailto"),
        shaped(disguised, F.concat(tag(words, "obfuscated"), tag(bracket, "obfuscated"))),
        shaped(rest.rlike(r"(?i)\sat\s") & rest.rlike(r"(?i)\sdot\s"), tag(spoken, "obfuscated")),
        tag(plain, "text"),
        shaped(rest.contains("<"), names),
    )
    seen = base.select(key, "_row", F.posexplode(found).alias("_pos", "_f")).select(
        key, F.struct("_row", "_pos").alias("_at"), clean_candidate(F.col("_f.a")).alias("_a"),
        F.col("_f.s").alias("_s"), F.nullif(F.col("_f.n"), F.lit("")).alias("_n"),
    ).where(F.col("_a") != "")
    sighted = F.col("_s") != "name"
    plainly = sighted & (F.col("_s") != "obfuscated")
    addresses = seen.groupBy(key, F.lower("_a").alias("_k")).agg(
        F.min_by("_a", F.when(sighted, F.col("_at"))).alias("address"),
        F.min(F.when(sighted, F.col("_at"))).alias("_first"),
        F.count_if(sighted).alias("occurrences"),
        (~F.bool_or(plainly)).alias("obfuscated"),
        F.coalesce(F.min_by("_s", F.when(plainly, F.col("_at"))), F.lit("obfuscated")).alias("source"),
        F.min_by("_n", F.when(F.col("_n").isNotNull(), F.col("_at"))).alias("display_name"),
    ).where(F.col("occurrences") > 0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_first"))
    return addresses.withColumn("position", rank).select(
        key, "position", "address", "obfuscated", "source", "occurrences", "display_name"
    )


def ascii_domain(raw: Column) -> Column:
    """Punycode domain, or empty where it is not a valid mail domain."""
    name = F.regexp_replace(F.lower(nfkc(raw)), r"\.\z", "")
    shape = name.rlike(r"^[\p{L}\p{M}\p{N}.-]{1,253}\z") & ~name.rlike(r"\.\.|^\.|\.\z")
    host = F.coalesce(F.lower(idna_ascii(name)), F.lit(""))
    good = host.rlike(
        r"^(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?!\d+\z)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z"
    )
    return F.when(shape & good, host).otherwise(F.lit(""))


def validate_emails(df: DataFrame, address: str = "address") -> DataFrame:
    """Add ``local, domain, valid``; an invalid address keeps its raw domain."""
    a = F.trim(F.col(address))
    at = F.length(a) - F.instr(F.reverse(a), "@") + 1
    has_at = F.instr(a, "@") > 0
    local = F.when(has_at, F.substr(a, F.lit(1), at - 1)).otherwise(a)
    raw = F.when(has_at, F.substr(a, at + 1)).otherwise(F.lit(""))
    df = df.withColumns(
        {"local": local, "_raw": F.regexp_replace(F.lower(raw), r"\.\z", ""), "_ascii": ascii_domain(raw), "_full": raw}
    )
    ok_local = (
        F.col("local").rlike(r"(?i)^[a-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}\z") & ~F.col("local").rlike(r"^\.|\.\z|\.\.")
    )
    valid = (
        (F.length(a) <= 254)
        & (F.regexp_count(a, F.lit("@")) == 1)
        & ok_local
        & ~F.col("_full").rlike(r"[\s/@\\:\[\]?#%]")
        & (F.col("_ascii") != "")
        & (F.length("local") + F.length("_ascii") + 1 <= 254)
    )
    return df.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "domain", F.when(F.col("valid"), F.col("_ascii")).otherwise(F.col("_raw"))
    ).drop("_raw", "_ascii", "_full")


def email_domain_signals(domain: Column, registrable: Column, page_registrable: Column) -> Column:
    free = in_list(registrable, P.FREE_PROVIDERS)
    target = F.coalesce(
        *[F.when(edit_distance_at_most_one(registrable, F.lit(t)), F.lit(t)) for t in P.FREEMAIL_TYPO_TARGETS]
    )
    digits = F.regexp_count(domain, F.lit("[0-9]"))
    labels = lambda c: F.size(F.split(c, r"\."))
    site, own = F.substring_index(page_registrable, ".", 1), F.substring_index(registrable, ".", 1)
    related = (
        (blank(page_registrable) != "") & (page_registrable != registrable) & ~free
        & (F.length(site) >= 5) & (F.length(own) >= 4) & (own != site)
    )
    close = related & (F.abs(F.length(site) - F.length(own)) <= 2)
    near = F.when(close, alignment_distance(site, own) <= 2).otherwise(False)
    return signals_of(
        signal_if(in_list(registrable, P.DISPOSABLE_DOMAINS), "disposable-domain", 45, "Disposable e-mail service"),
        signal_if(~free & target.isNotNull(), "freemail-typo", 45, F.concat(F.lit("Looks like a misspelling of "), target)),
        signal_if(F.exists(F.split(domain, r"\."), lambda s: s.startswith("xn--")), "idn-domain", 30, "International characters in the domain"),
        signal_if(~free & in_list(F.substring_index(domain, ".", -1), P.EMAIL_TLDS), "suspicious-tld", 20, "Often abused domain ending"),
        signal_if(labels(domain) - labels(registrable) >= 3, "deep-subdomain", 15, "Many subdomains"),
        signal_if((F.length(domain) > 8) & (F.coalesce(F.try_divide(digits, F.length(domain)), F.lit(0.0)) > 0.3),
                  "digit-heavy-domain", 15, "Domain is full of digits"),
        F.when(near, signal("resembles-this-site", 40, F.concat(F.lit("Near-copy of "), page_registrable))).when(
            related & F.array_contains(F.split(own, "-"), site),
            signal("contains-this-site-name", 35, F.concat(F.lit("Borrows the name of "), page_registrable)),
        ),
    )


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def find_brand(text: Column) -> Column:
    """First e-mail brand that a text names by token, contained long name or alias."""
    low, tokens = F.lower(text), _tokens(text)
    expr = None
    for name, _, aliases in P.EMAIL_BRANDS:
        test = F.array_contains(tokens, name)
        if len(name) >= 6:
            test = test | F.exists(tokens, lambda t: t.contains(name))
        for alias in aliases:
            test = test | low.contains(alias)
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return expr


def _is_official(brand: Column, registrable: Column) -> Column:
    test = F.lit(False)
    for name, domains, _ in P.EMAIL_BRANDS:
        test = test | ((brand == name) & registrable.isin(*domains))
    return F.coalesce(test, F.lit(False))


def email_local_signals(local: Column, registrable: Column, brand: Column) -> Column:
    """``brand`` is ``find_brand(local)``, passed in so that it is computed once."""
    tokens = _tokens(local)
    joined = F.array_join(tokens, "")
    authority = F.coalesce(F.arrays_overlap(tokens, text_array(P.AUTHORITY_WORDS)), F.lit(False)) | F.exists(
        text_array([w for w in P.AUTHORITY_WORDS if len(w) >= 7]), lambda w: joined.contains(w)
    )
    digits = F.regexp_count(local, F.lit("[0-9]"))
    odd = (digits >= 6) | ((F.length(local) >= 8) & (F.coalesce(F.try_divide(digits, F.length(local)), F.lit(0.0)) > 0.4))
    return signals_of(
        signal_if(authority & in_list(registrable, P.FREE_PROVIDERS), "authority-on-freemail", 35, "Official-sounding name on a free mailbox"),
        signal_if(brand.isNotNull() & ~_is_official(brand, registrable) & (authority | (joined == brand)),
                  "brand-in-local-part", 45, F.concat(F.lit("Uses the name "), brand)),
        signal_if(odd, "random-local-part", 15, "Name part looks generated"),
        signal_if(F.length(local) >= 40, "very-long-local-part", 10, "Very long name part"),
    )


def email_display_signals(name: Column, registrable: Column, shown_registrable: Column, brand: Column) -> Column:
    """``shown_registrable`` belongs to an address inside the display name, null without one."""
    named = F.trim(blank(name)) != ""
    return signals_of(
        F.when(
            named & shown_registrable.isNotNull(),
            F.when(shown_registrable != registrable,
                   signal("display-name-email-mismatch", 55, "Display name shows another address")),
        ).when(
            named & brand.isNotNull() & ~_is_official(brand, registrable),
            signal("display-name-impersonation", 50, F.concat(F.lit("Display name says "), clip(F.trim(name), 40))),
        )
    )


def page_host(df: DataFrame, host: str, out: str) -> DataFrame:
    """Registrable domain of a page given as host or URL; empty if unusable."""
    raw = F.trim(blank(host))
    url = F.when(raw.rlike(r"(?i)^[a-z][a-z\d+.-]*://"), raw).otherwise(F.concat(F.lit("http://"), raw))
    pages = df.select(F.col(host)).distinct().withColumn("_url", F.when(raw != "", url))
    pages = with_url_parts(pages, "_url")
    pages = pages.withColumn(
        "_h", F.when(F.col("url_valid") & ~F.col("has_credentials"), ascii_domain(F.col("host")))
    )
    pages = with_registrable(pages, "_h", out).select(
        F.col(host).alias("_page"), F.when(blank("_h") != "", F.col(out)).otherwise(F.lit("")).alias(out)
    )
    return df.join(pages, F.col(host).eqNullSafe(F.col("_page")), "left").drop("_page")


def email_signals(df: DataFrame, rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """Signals of candidates (``address, obfuscated, display_name, page_registrable``)."""
    df = validate_emails(df)
    df = with_registrable(df, "domain", "registrable")
    shown = F.regexp_extract(F.trim(blank("display_name")), "[^\\s<>()\"',;]+@[^\\s<>()\"',;]+", 0)
    shown_domain = F.lower(F.substring_index(F.regexp_replace(shown, r"[.,;:]+\z", ""), "@", -1))
    df = df.withColumn("_shown", F.when(shown != "", shown_domain))
    df = with_registrable(df, "_shown", "_shown_reg")
    df = df.withColumns({"_lb": find_brand(F.col("local")), "_db": find_brand(blank("display_name"))})
    df = with_lookalike(df.withColumn("_d", F.when(F.col("valid"), F.col("domain"))), "_d", rules)
    imitation = F.when(
        F.col("lookalike").isNotNull(),
        signals_of(signal(F.col("lookalike.id"), F.greatest(F.col("lookalike.weight"), F.lit(50)), F.col("lookalike.reason"))),
    )
    checks = F.when(
        F.col("valid"),
        union_signals(
            imitation,
            email_domain_signals(F.col("domain"), F.col("registrable"), F.col("page_registrable")),
            email_local_signals(F.col("local"), F.col("registrable"), F.col("_lb")),
            email_display_signals(F.col("display_name"), F.col("registrable"), F.col("_shown_reg"), F.col("_db")),
        ),
    )
    own = signals_of(
        signal_if(F.coalesce(F.col("obfuscated"), F.lit(False)), "obfuscated", 55, "Disguised with at or dot words"),
        signal_if(~F.col("valid"), "invalid-format", 100, "Not a valid address"),
    )
    return df.withColumn("signals", union_signals(own, checks)).drop(
        "_shown", "_shown_reg", "_lb", "_db", "_d", "brand", "lookalike"
    )


def finish_assessment(df: DataFrame) -> DataFrame:
    """Strongest signal per id, risk, status, category and explanation."""
    df = df.withColumn("signals", strongest_per_id(F.col("signals"), ties_by_id=True))
    df = df.withColumn("risk_score", score_weights(F.col("signals")))
    same = F.col("valid") & (blank("page_registrable") != "") & (F.col("registrable") == F.col("page_registrable"))
    suspicious = F.col("risk_score") >= 30
    top = F.get("signals", F.lit(0))
    others = F.size("signals") - 1
    explained = F.when(
        (top["weight"] < 30) & (others > 0),
        F.concat(top["reason"], F.lit(" (plus "), others.cast("string"), F.lit(" other warning signs)")),
    ).otherwise(top["reason"])
    return df.withColumns(
        {
            "status": F.when(suspicious, "suspicious").when(same, "matches-site").otherwise("external"),
            "category": F.when(~F.col("valid"), "other-domain")
            .when(in_list(F.col("registrable"), P.DISPOSABLE_DOMAINS), "disposable")
            .when(in_list(F.col("registrable"), P.FREE_PROVIDERS), "free-provider")
            .when(same, "same-site")
            .otherwise("other-domain"),
            "explanation": F.when(suspicious, explained)
            .when(same, "Same domain as the page; the mailbox is unverified")
            .otherwise("On another domain; owner unverified"),
        }
    )


def assess_emails(candidates: DataFrame, host: str | None = None, rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """Assess extracted addresses; ``host`` names the column of the page they were found on."""
    # Addresses feed several lookups; extraction from long texts must not be repeated for each.
    candidates = cut_lineage(candidates)
    df = page_host(candidates, host, "page_registrable") if host else candidates.withColumn("page_registrable", F.lit(""))
    return finish_assessment(email_signals(df, rules))


def summarize_emails(assessed: DataFrame, key: str) -> DataFrame:
    """Totals per page and its riskiest address (the first one on ties)."""
    status = F.col("status")
    return assessed.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "suspicious").alias("suspicious"),
        F.count_if(status == "external").alias("external"),
        F.count_if(status == "matches-site").alias("matches_site"),
        F.count_if(F.col("category") == "disposable").alias("disposable"),
        F.max_by("address", F.struct("risk_score", -F.col("position"))).alias("worst_address"),
        F.max("risk_score").alias("worst_score"),
    )


def sender_identity(mail: DataFrame, key: str = "msg_id", rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """``key, risk_score, signals, sender_address``: From against Reply-To, Return-Path and links.

    Columns read: ``from_header, reply_to, return_path, link_urls``. The three addresses of a message
    are assessed in one pass as rows and come back through one aggregation.
    """
    roles = F.array(
        *[
            F.struct(F.lit(i).alias("role"), F.col(c).alias("text"))
            for i, c in enumerate(("from_header", "reply_to", "return_path"))
        ]
    )
    rows = mail.select(F.col(key), F.explode(roles).alias("r")).where(blank("r.text") != "")
    rows = rows.select(F.concat_ws("\u0001", F.col(key).cast("string"), F.col("r.role").cast("string")).alias("_slot"), F.col("r.text").alias("text"))
    first = extract_emails(rows, "_slot").where(F.col("position") == 1)
    judged = assess_emails(first, None, rules).select(
        F.substring_index("_slot", "\u0001", 1).alias("_m"), F.substring_index("_slot", "\u0001", -1).cast("int").alias("role"),
        F.struct(
            "address", "signals", "status", "explanation", "display_name", "domain", "registrable",
        ).alias("a"),
    )
    pick = lambda i, n: F.max_by("a", F.when(F.col("role") == i, F.lit(1))).alias(n)
    per_mail = judged.groupBy("_m").agg(pick(0, "sender"), pick(1, "reply"), pick(2, "path"))
    link_rows = mail.select(F.col(key).cast("string").alias("_lm"), F.explode("link_urls").alias("_u"))
    link_hosts = with_registrable(with_url_parts(link_rows, "_u").where("url_valid").select("_lm", "host").distinct(), "host", "_ld")
    link_sets = link_hosts.groupBy("_lm").agg(F.collect_set("_ld").alias("link_domains"))
    out = (
        mail.select(F.col(key), F.col(key).cast("string").alias("_k"))
        .join(per_mail, F.col("_k") == F.col("_m"), "left")
        .join(link_sets, F.col("_k") == F.col("_lm"), "left")
    )
    s, r, p, links = F.col("sender"), F.col("reply"), F.col("path"), F.col("link_domains")
    own = s["registrable"]
    differs = r.isNotNull() & (r["registrable"] != own)
    to_free = differs & in_list(r["registrable"], P.FREE_PROVIDERS) & ~in_list(own, P.FREE_PROVIDERS)
    checks = signals_of(
        F.when(to_free, signal("reply-to-freemail", 45, "Replies go to a free mailbox"))
        .when(differs, signal("reply-to-mismatch", 30, "Replies go to another domain")),
        signal_if(r["status"] == "suspicious", "reply-to-suspicious", 35, F.concat(F.lit("Reply-to looks suspicious: "), blank(r["explanation"]))),
        signal_if(p.isNotNull() & (p["registrable"] != own), "return-path-mismatch", 15, "Bounces go to another domain"),
        signal_if((F.size(links) > 0) & ~F.array_contains(links, own), "links-off-sender-domain", 15, "No link leads to the sender's domain"),
        signal_if(F.exists(links, lambda d: in_list(d, P.URL_SHORTENERS)), "shortened-links", 15, "Shortened links"),
    )
    missing = signals_of(signal("no-sender", 30, "No readable sender"))
    out = out.withColumn("signals", F.when(s.isNull(), missing).otherwise(union_signals(s["signals"], checks)))
    return out.select(
        key, score_weights(F.col("signals")).alias("risk_score"), "signals",
        s["address"].alias("sender_address"), s["display_name"].alias("sender_name"), own.alias("sender_registrable"),
    )
