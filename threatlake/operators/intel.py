"""Domain, address and URL intelligence from snapshot tables instead of live lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.signals import (
    signal, signal_if, signals_of, strongest_per_id, union_signals, with_verdict,
)
from threatlake.functions.text import blank, first_match
from threatlake.operators.domains import with_registrable
from threatlake.operators.emails import validate_emails
from threatlake.operators.urls import with_url_parts

TYPE_A, TYPE_CNAME, TYPE_MX, TYPE_TXT = 1, 5, 15, 16


def unquote_txt(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\"\s+\"", ""), "^\"|\"\\z", "")


def spf_all(record: Column) -> Column:
    """The ``all`` mechanism with its qualifier; ``+`` when none is written."""
    found = F.regexp_extract(F.lower(record), r"(?:^|\s)([+\-~?]?)all(?:\s|$)", 1)
    has = F.lower(record).rlike(r"(?:^|\s)[+\-~?]?all(?:\s|$)")
    return F.when(has, F.concat(F.when(found == "", "+").otherwise(found), F.lit("all")))


def dmarc_policy(record: Column) -> Column:
    tags = F.filter(
        F.transform(F.split(record, ";"), lambda t: F.struct(
            F.lower(F.trim(F.substring_index(t, "=", 1))).alias("k"),
            F.lower(F.trim(F.substr(t, F.instr(t, "=") + 1))).alias("v"), (F.instr(t, "=") > 1).alias("ok"))),
        lambda t: t["ok"] & (t["k"] == "p"),
    )
    value = F.try_element_at(tags, F.lit(-1))["v"]
    return F.when(value.isin("none", "quarantine", "reject"), value)


def dns_facts(answers: DataFrame) -> DataFrame:
    """One row per domain from answers (``domain, query, status, pos, type, data``).

    ``query`` is MX, TXT, DMARC or A; ``status`` 0 or 3 (no such name) are answers, anything else is a
    failed lookup and leaves its facts null. An empty answer is a row without ``type``.
    """
    ok = F.col("status").isin(0, 3)
    asked = lambda q: ok & (F.col("query") == q)
    data = F.trim(F.col("data"))
    mx_host = F.lower(F.regexp_replace(F.regexp_extract(data, r"(?s)^\S+\s+(.*)\z", 1), r"\.\z", ""))
    txt = unquote_txt(data)
    spf = asked("TXT") & (F.col("type") == TYPE_TXT) & F.lower(txt).startswith("v=spf1")
    dmarc = asked("DMARC") & (F.col("type") == TYPE_TXT) & txt.rlike(r"(?i)^v=dmarc1(?![A-Za-z0-9_])")
    is_mx = asked("MX") & (F.col("type") == TYPE_MX)
    agg = answers.groupBy("domain").agg(
        F.bool_or(F.when(asked("MX"), F.col("status") == 3)).alias("_nx_mx"),
        F.bool_or(F.when(asked("A"), F.col("status") == 3)).alias("_nx_a"),
        F.bool_or(asked("MX")).alias("_mx"), F.bool_or(asked("TXT")).alias("_txt"),
        F.bool_or(asked("DMARC")).alias("_dm"), F.bool_or(asked("A")).alias("_a"),
        F.array_sort(F.collect_set(F.when(is_mx & (mx_host != ""), F.struct("pos", mx_host.alias("h"))))).alias("_hosts"),
        F.count_if(is_mx).alias("_n_mx"),
        F.bool_or(asked("A") & F.col("type").isin(TYPE_A, TYPE_CNAME)).alias("_resolves"),
        F.min_by(txt, F.when(spf, F.col("pos"))).alias("_spf"),
        F.min_by(txt, F.when(dmarc, F.col("pos"))).alias("_dmarc"),
    )
    hosts = F.array_distinct(F.transform("_hosts", lambda x: x["h"]))
    return agg.select(
        "domain",
        F.coalesce("_nx_mx", "_nx_a").alias("nxdomain"),
        F.when(F.col("_mx"), F.size("_hosts") > 0).alias("has_mx"),
        hosts.alias("mx_hosts"),
        ((F.col("_n_mx") > 0) & (F.size("_hosts") == 0)).alias("null_mx"),
        F.when(F.col("_a"), F.coalesce("_resolves", F.lit(False))).alias("resolves"),
        F.when(F.col("_txt"), F.col("_spf").isNotNull()).alias("has_spf"),
        spf_all(F.col("_spf")).alias("spf_all"),
        F.when(F.col("_dm"), F.col("_dmarc").isNotNull()).alias("has_dmarc"),
        dmarc_policy(F.col("_dmarc")).alias("dmarc_policy"),
        (4 - F.col("_mx").cast("int") - F.col("_txt").cast("int") - F.col("_dm").cast("int") - F.col("_a").cast("int")).alias("failed_lookups"),
    )


def inherit_dmarc(facts: DataFrame) -> DataFrame:
    """A subdomain without a DMARC record takes that of its organisational domain."""
    own = with_registrable(facts, "domain", "registrable")
    parents = facts.where(F.col("has_dmarc")).select(
        F.col("domain").alias("_parent"), F.col("dmarc_policy").alias("_policy")
    )
    needs = (F.col("has_dmarc") == F.lit(False)) & (F.col("registrable") != F.col("domain"))
    joined = own.withColumn("_org", F.when(needs, F.col("registrable"))).join(parents, F.col("_org") == F.col("_parent"), "left")
    found = F.col("_parent").isNotNull()
    return joined.withColumns(
        {
            "has_dmarc": F.when(found, F.lit(True)).otherwise(F.col("has_dmarc")),
            "dmarc_policy": F.when(found, F.col("_policy")).otherwise(F.col("dmarc_policy")),
        }
    ).drop("registrable", "_org", "_parent", "_policy")


def mx_provider(hosts: Column) -> Column:
    """Provider of the first MX host that has a known one."""
    named = F.transform(hosts, lambda h: first_match(h, P.MX_PROVIDERS, lambda p: p))
    return F.get(F.array_compact(named), F.lit(0))


def rdap_base(domains: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """``domain, base``: https service of the longest matching ending (bootstrap: ``ending, urls, pos``)."""
    services = bootstrap.select(
        F.lower("ending").alias("_end"), F.get(F.filter("urls", lambda u: u.startswith("https://")), F.lit(0)).alias("base"), "pos"
    ).where(F.col("base").isNotNull())
    services = services.groupBy("_end").agg(F.min_by("base", "pos").alias("base"))
    low = F.lower("domain")
    n = F.size(F.split(low, r"\."))
    endings = domains.select("domain").distinct().select(
        "domain",
        F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(F.split(low, r"\."), n - k + 1, k), ".").alias("e")))).alias("x"),
    )
    return endings.join(services, F.col("x.e") == F.col("_end")).groupBy("domain").agg(F.max_by("base", "x.k").alias("base"))


def domain_age(registered: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(registered)) / F.lit(86_400_000_000))
    return F.greatest(days, F.lit(0)).cast("int")


def with_age(df: DataFrame, as_of, registered: str = "registered_at", out: str = "age_days") -> DataFrame:
    return df.withColumn(out, domain_age(F.col(registered), F.lit(as_of).cast("timestamp")))


def url_age_signal(age: Column) -> Column:
    weight = F.when(age <= 7, 40).when(age <= 30, 28).when(age <= 90, 10)
    return signals_of(
        signal_if(weight.isNotNull(), "new-domain", weight, F.concat(F.lit("Domain registered "), age.cast("string"), F.lit(" day(s) ago")))
    )


def domain_intel_signals(for_email: bool) -> Column:
    """Signals from fact columns; unknown (null) facts never count as false."""
    c = F.col
    false = lambda x: F.coalesce(x == F.lit(False), F.lit(False))
    gone = F.coalesce(c("nxdomain"), F.lit(False))
    mail = F.lit(for_email) & ~gone
    refuses = F.coalesce(c("null_mx"), F.lit(False))
    age = c("age_days")
    weight = F.when(age <= 7, 40).when(age <= 30, 30).when(age <= 90, 12)
    return signals_of(
        signal_if(gone, "online-domain-not-found", 55, "The domain does not exist in DNS"),
        signal_if(mail & (refuses | (false(c("has_mx")) & false(c("resolves")))), "online-no-mail-server", 45, "The domain receives no mail"),
        signal_if(mail & false(c("has_spf")) & false(c("has_dmarc")), "online-no-email-auth", 12, "Neither SPF nor DMARC is published"),
        signal_if(mail & F.coalesce(c("spf_all") == "+all", F.lit(False)), "online-spf-allows-all", 25, "SPF lets any server send"),
        signal_if(weight.isNotNull(), "online-new-domain", weight, F.concat(F.lit("Domain registered "), age.cast("string"), F.lit(" day(s) ago"))),
    )


def with_domain_intel(df: DataFrame, domain: str, facts: DataFrame, registration: DataFrame, as_of) -> DataFrame:
    """Attach DNS facts, registration age and mail provider; one lookup per distinct domain.

    The facts of the distinct domains are assembled first and joined once to the rows.
    """
    names = df.select(F.col(domain).alias("domain")).where(~F.col("domain").rlike(r"^\d{1,3}(\.\d{1,3}){3}\z")).distinct()
    intel = with_registrable(names, "domain", "_reg")
    intel = intel.join(facts, "domain", "left").join(
        registration.select(F.col("domain").alias("_rd"), "registered_at"), F.col("_reg") == F.col("_rd"), "left"
    ).drop("_reg", "_rd")
    intel = with_age(intel, as_of).withColumn("mail_provider", mx_provider(F.col("mx_hosts")))
    return df.join(intel.withColumnRenamed("domain", "_dom"), F.col(domain) == F.col("_dom"), "left").drop("_dom")


def parse_registrations(payloads: DataFrame) -> DataFrame:
    """``domain, registered_at`` from registry JSON: the first readable registration event."""
    schema = "struct<events: array<struct<eventAction:string,eventDate:string>>>"
    events = F.from_json("payload", schema)["events"]
    dates = F.transform(F.filter(events, lambda e: e["eventAction"] == "registration"), lambda e: F.try_to_timestamp(e["eventDate"]))
    return payloads.select("domain", F.get(F.array_compact(dates), F.lit(0)).alias("registered_at"))


def parse_email_reputation(payloads: DataFrame) -> DataFrame:
    """``address`` with reputation fields from provider JSON; texts clipped to 40 characters."""
    flags = [f for f, _ in P.REPUTATION_FLAGS]
    detail = ",".join(f"{f}:boolean" for f in flags)
    schema = (
        "struct<reputation:string,suspicious:boolean,references:double,details:struct<first_seen:string,last_seen:string,"
        f"data_breaches:double,days_since_domain_creation:double,domain_reputation:string,domain_exists:boolean,{detail}>>"
    )
    j = payloads.select("address", F.from_json("payload", schema).alias("j"))
    d = F.col("j.details")
    labels = F.array_compact(F.array(*[F.when(d[f], F.lit(label)) for f, label in P.REPUTATION_FLAGS]))
    return j.select(
        "address", F.col("j.reputation").alias("reputation"), F.col("j.suspicious").alias("suspicious"),
        F.col("j.references").alias("references"), d["first_seen"].alias("first_seen"), d["last_seen"].alias("last_seen"),
        F.greatest(d["data_breaches"], F.lit(0.0)).alias("data_breaches"),
        F.greatest(F.floor(d["days_since_domain_creation"]), F.lit(0)).cast("int").alias("domain_age_days"),
        d["domain_reputation"].alias("domain_reputation"), d["domain_exists"].alias("domain_exists"), labels.alias("flags"),
        F.lit(None).cast("string").alias("error"),
    )


def email_rep_signals() -> Column:
    c, has = F.col, lambda label: F.coalesce(F.array_contains("flags", label), F.lit(False))
    return signals_of(
        signal_if(F.coalesce(c("suspicious"), F.lit(False)), "online-email-suspicious", 55, "Provider marks the address as suspicious"),
        signal_if(has("Reported malicious activity") | has("Recent malicious activity"), "online-malicious-activity", 75, "Malicious activity reported"),
        signal_if(has("Listed on a blocklist"), "online-email-blocklisted", 70, "On a blocklist"),
        signal_if(has("Associated with spam"), "online-email-spam", 55, "Associated with spam"),
        signal_if(has("Credentials reported leaked"), "online-credentials-leaked", 35, "Credentials leaked"),
        signal_if(has("Disposable email provider"), "online-disposable-provider", 45, "Disposable provider"),
        signal_if(F.coalesce(~c("domain_exists"), F.lit(False)), "online-domain-not-found", 50, "The mail domain does not exist"),
        signal_if(F.coalesce(c("domain_age_days") <= 30, F.lit(False)) | has("Recently registered domain"), "online-new-domain", 20, "Recently registered mail domain"),
    )


def rep_report(df: DataFrame) -> DataFrame:
    """Join of reputation and domain facts to ``report_status``, ``report_age`` and merged ``signals``.

    ``rep_available`` says whether the provider answered; domain facts may be null.
    """
    domain_known = F.col("has_mx").isNotNull() | F.col("has_spf").isNotNull() | F.col("has_dmarc").isNotNull()
    status = F.when(F.col("rep_available") & domain_known, "complete").when(F.col("rep_available") | domain_known, "partial").otherwise("unavailable")
    both = union_signals(F.when(F.col("rep_available"), email_rep_signals()), domain_intel_signals(True))
    df = df.withColumns({"report_status": status, "signals": both})
    return df.withColumns(
        {"signals": strongest_per_id(F.col("signals")), "report_age": F.coalesce("age_days", "domain_age_days")}
    )


def _first_per_key(firsts: DataFrame, key: str, limit: int | None) -> DataFrame:
    """All rows, or the first ``limit`` per key by ``_o``. Without a limit no key is gathered anywhere."""
    if limit is None:
        return firsts.drop("_o")
    w = Window.partitionBy(key).orderBy("_o")
    return firsts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r", "_o")


def email_lookup_keys(df: DataFrame, key: str, address: str = "address", order: str = "position", limit: int | None = None) -> DataFrame:
    """Valid addresses in lookup form, case-insensitively distinct; with ``limit`` only the first so many per page."""
    v = validate_emails(df.withColumn("_a", F.trim(F.col(address))), "_a").where("valid")
    form = F.concat(F.col("local"), F.lit("@"), F.col("domain"))
    firsts = v.groupBy(key, F.lower(form).alias("lookup_key")).agg(F.min_by(form, F.col(order)).alias("lookup_address"), F.min(order).alias("_o"))
    return _first_per_key(firsts, key, limit)


def normal_url(df: DataFrame, url: str = "url", out: str = "lookup_url") -> DataFrame:
    """HTTP(S) URL without credentials in browser form, else null."""
    p = with_url_parts(df.withColumn("_u", F.trim(F.col(url))), "_u")
    port = F.when(F.col("port").isNotNull(), F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise(F.lit(""))
    tail = F.regexp_extract("_u", r"(?s)([?#].*)\z", 1)
    href = F.concat(F.col("scheme"), F.lit("://"), F.col("host"), port, F.col("path"), tail)
    ok = F.col("url_valid") & ~F.col("has_credentials")
    kept = [F.col(c) for c in df.columns]
    return p.select(*kept, F.when(ok, href).alias(out))


def url_lookup_keys(df: DataFrame, key: str, url: str = "url", order: str = "pos", limit: int | None = None) -> DataFrame:
    """Distinct lookup addresses per key; with ``limit`` only the first so many."""
    n = normal_url(df, url).where(F.col("lookup_url").isNotNull())
    firsts = n.groupBy(key, "lookup_url").agg(F.min(order).alias("_o"))
    return _first_per_key(firsts, key, limit)


def with_url_listings(scanned: DataFrame, listings: DataFrame, url: str = "url") -> DataFrame:
    """Status of each of the four providers per URL, and the verdict with 55 for every listing.

    Listings (``url, provider, status, detail``) are folded to one row per URL before the join.
    """
    mine = lambda p, f: F.max(F.when(F.col("provider") == p, F.col(f)))
    folded = listings.groupBy(F.col("url").alias("_lu")).agg(
        *[mine(p, "status").alias(f"{p}_status") for p in P.URL_PROVIDERS], *[mine(p, "detail").alias(f"_{p}") for p in P.URL_PROVIDERS]
    )
    j = scanned.join(folded, F.col(url) == F.col("_lu"), "left")
    status = {f"{p}_status": F.coalesce(f"{p}_status", F.lit("unknown")) for p in P.URL_PROVIDERS}
    hits = signals_of(
        *[signal_if(F.col(f"{p}_status") == "listed", f"url-reputation-{p}", 55, F.concat(F.lit(f"{p}: "), blank(f"_{p}"))) for p in P.URL_PROVIDERS]
    )
    out = j.withColumns({"local_score": F.col("score"), "signals": union_signals(F.col("signals"), hits), **status})
    return with_verdict(out).drop("_lu", *[f"_{p}" for p in P.URL_PROVIDERS])


def needs_enrichment(score: Column, mode: str = "domains") -> Column:
    return F.lit(mode != "off") & (score >= P.ENRICH_FROM) & (score < P.ENRICH_BELOW)


def enrich_scans(scanned: DataFrame, registration: DataFrame, as_of, mode: str = "domains", host: str = "host") -> DataFrame:
    """Add the domain-age signal to borderline scans only; all others bypass the join."""
    if mode == "off":
        return scanned
    gate = needs_enrichment(F.col("score"), mode) & blank(host).contains(".") & ~blank(host).rlike(r"^[\d.]+\z|:")
    border = with_registrable(scanned.where(gate), host, "_reg")
    ages = with_age(registration.select(F.col("domain").alias("_rd"), "registered_at"), as_of).drop("registered_at")
    aged = border.join(ages, F.col("_reg") == F.col("_rd"), "left")
    aged = aged.withColumn("signals", union_signals(F.col("signals"), url_age_signal(F.col("age_days"))))
    rescored = with_verdict(aged).drop("_reg", "_rd", "age_days")
    return rescored.select(*scanned.columns).unionByName(scanned.where(~F.coalesce(gate, F.lit(False))))


def fuse_model(verdicts: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``phishing-model`` with weight ``round(100 p)``; the model may raise a verdict, never lower it."""
    weight = F.floor(F.col(probability) * 100 + 0.5).cast("int")
    old = F.struct("signals", "score", "level", "reasons")
    df = verdicts.withColumns(
        {"_old": old, "signals": union_signals(F.col("signals"), signals_of(signal("phishing-model", weight, "Text model")))}
    )
    df = with_verdict(df)
    keep = {c: F.when(F.col("score") >= F.col("_old.score"), F.col(c)).otherwise(F.col(f"_old.{c}")) for c in ("signals", "level", "reasons", "score")}
    return df.withColumns(keep).drop("_old")


def explain_trigger(score: Column, intent: Column) -> Column:
    return F.when(intent == "explain", "user-request").when(score >= P.EXPLAIN_FROM, "risk-threshold").otherwise("not-triggered")
