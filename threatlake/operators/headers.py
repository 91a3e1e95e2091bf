"""Mail headers: authentication claims, alignment, failure scores, received route, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.signals import score_weights, signal, signals_of, union_signals
from threatlake.functions.text import blank
from threatlake.operators.domains import with_registrable
from threatlake.operators.emails import sender_identity

_METHODS = ["spf", "dkim", "dmarc"]
_RESULT = "(" + "|".join(P.AUTH_RESULTS) + ")"


def header_block(raw: Column) -> Column:
    """Text before the first empty line, without a byte-order mark."""
    return F.regexp_replace(F.regexp_extract(raw, r"(?s)^(.*?)(?:\r?\n\r?\n.*)?\z", 1), "^\\uFEFF", "")


def parse_headers(block: Column) -> Column:
    """Unfolded headers as ``name, value`` in order."""
    lines = F.split(F.regexp_replace(F.regexp_replace(block, r"\r\n|\r", "\n"), r"[ \t]*\n[ \t]+", " "), "\n")
    pairs = F.transform(
        F.filter(lines, lambda s: F.instr(s, ":") > 1),
        lambda s: F.struct(
            F.lower(F.trim(F.substring_index(s, ":", 1))).alias("name"),
            F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda h: h["name"].rlike("^[a-z0-9-]+$"))


def header_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: h["value"])


def first_header(headers: Column, name: str) -> Column:
    return F.get(header_values(headers, name), F.lit(0))


def first_address(value: Column) -> Column:
    bracket = F.regexp_extract(blank(value), r"<\s*([^<>\s,;]+@[^<>\s,;]+)\s*>", 1)
    bare = F.regexp_extract(blank(value), r"(?:^|[\s,;])([^<>\s,;]+@[^<>\s,;]+)(?=$|[\s,;])", 1)
    found = F.when(bracket != "", bracket).otherwise(bare)
    return F.nullif(F.regexp_replace(found, r"[.,;:]+\z", ""), F.lit(""))


def with_headers(mail: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``headers`` and the usual single headers. Mail without any gets ``error``."""
    df = mail.withColumn("_block", header_block(F.col(raw)))
    df = df.withColumn("headers", parse_headers(F.col("_block")))
    return df.withColumns(
        {
            "from_header": first_header(F.col("headers"), "from"),
            "reply_to": first_address(first_header(F.col("headers"), "reply-to")),
            "return_path": first_address(first_header(F.col("headers"), "return-path")),
            "subject": F.array_join(header_values(F.col("headers"), "subject"), " "),
            "error": F.when(F.size("headers") == 0, "no headers"),
        }
    ).drop("_block")


def _identity(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?i)(?:smtp\.mailfrom|envelope-from|header\.d|header\.i|header\.from)\s*=\s*([^\s;]+)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(raw, "^@", ""), r"[>,]+\z", ""))
    domain = F.regexp_replace(F.substring_index(name, "@", -1), r"\.\z", "")
    return F.when(domain.rlike(r"^[^\s/?#@:\[\]<>^|%]+\z"), domain)


def auth_claims(mail: DataFrame, key: str = "msg_id") -> DataFrame:
    """``key, pos, method, result, authserv_id, identity_domain, source`` from the parsed headers."""
    results = header_values(F.col("headers"), "authentication-results")
    clause = rf"(?i)^\s*(spf|dkim|dmarc)\s*=\s*{_RESULT}\b(.*)$"

    def from_results(value: Column) -> Column:
        server = F.coalesce(F.nullif(F.trim(F.substring_index(value, ";", 1)), F.lit("")), F.lit("unknown"))
        clauses = F.filter(F.slice(F.split(value, ";"), F.lit(2), F.size(F.split(value, ";"))), lambda c: c.rlike(clause))
        return F.transform(
            clauses,
            lambda c: F.struct(
                F.lower(F.regexp_extract(c, clause, 1)).alias("method"),
                F.lower(F.regexp_extract(c, clause, 2)).alias("result"),
                server.alias("authserv_id"),
                _identity(F.regexp_extract(c, clause, 3)).alias("identity_domain"),
                F.lit("Authentication-Results").alias("source"),
            ),
        )

    spf = rf"(?i)^\s*{_RESULT}\b(.*)$"
    received = F.transform(
        F.filter(header_values(F.col("headers"), "received-spf"), lambda v: v.rlike(spf)),
        lambda v: F.struct(
            F.lit("spf").alias("method"),
            F.lower(F.regexp_extract(v, spf, 1)).alias("result"),
            F.coalesce(
                F.nullif(F.trim(F.regexp_extract(F.regexp_extract(v, spf, 2), r"^\s*\(([^:;)]+)", 1)), F.lit("")),
                F.lit("unknown"),
            ).alias("authserv_id"),
            _identity(F.regexp_extract(v, spf, 2)).alias("identity_domain"),
            F.lit("Received-SPF").alias("source"),
        ),
    )
    claims = F.concat(F.flatten(F.transform(results, from_results)), received)
    return mail.select(key, F.posexplode(claims).alias("pos", "c")).select(key, "pos", "c.*")


def auth_summary(claims: DataFrame, mail: DataFrame, key: str = "msg_id") -> DataFrame:
    """Per message: alignment of each method, DMARC status, and strongest failure weights."""
    sender = mail.select(F.col(key), F.substring_index(first_address(F.col("from_header")), "@", -1).alias("_fd"))
    sender = with_registrable(sender, "_fd", "from_registrable").drop("_fd")
    known = with_registrable(claims, "identity_domain", "_claim_reg")
    joined = sender.join(known, key, "left")
    aggs = []
    passing = (F.col("result") == "pass") & F.col("identity_domain").isNotNull()
    for m in _METHODS:
        mine = F.col("method") == m
        aggs += [
            F.bool_or(mine & passing & (F.col("_claim_reg") == F.col("from_registrable"))).alias(f"_{m}_ok"),
            F.bool_or(mine & passing).alias(f"_{m}_pass"),
            F.max(F.when(mine, _failure_weight())).alias(f"{m}_failure"),
            F.max_by("result", F.when(mine, _failure_weight())).alias(f"{m}_failed"),
        ]
    dmarc = F.col("method") == "dmarc"
    out = joined.groupBy(key).agg(
        F.first("from_registrable").alias("from_registrable"),
        F.count_if(dmarc & (F.col("result") == "fail")).alias("_f"),
        F.count_if(dmarc & (F.col("result") == "pass")).alias("_p"),
        F.count_if(dmarc).alias("_d"),
        *aggs,
    )
    align = {
        f"{m}_alignment": F.when(F.col(f"_{m}_ok"), "aligned")
        .when(F.col(f"_{m}_pass") & F.col("from_registrable").isNotNull(), "not-aligned")
        .otherwise("unknown")
        for m in _METHODS
    }
    status = (
        F.when(F.col("_f") > 0, "reported-fail")
        .when(F.col("_p") > 0, "reported-pass")
        .when(F.col("_d") > 0, "reported-inconclusive")
        .otherwise("missing")
    )
    return out.withColumns({**align, "dmarc_status": status}).drop(
        "_f", "_p", "_d", *[f"_{m}_{x}" for m in _METHODS for x in ("ok", "pass")]
    )


def _failure_weight() -> Column:
    expr = None
    for method, table in P.AUTH_FAILURE_WEIGHTS.items():
        for result, weight in table.items():
            test = (F.col("method") == method) & (F.col("result") == result)
            expr = F.when(test, weight) if expr is None else expr.when(test, weight)
    return expr


def header_risk(mail: DataFrame, key: str = "msg_id") -> DataFrame:
    """``key, risk_score, signals, dmarc_status`` and alignments of mail with parsed headers, and its ``link_urls`` where they are known."""
    linked = mail if "link_urls" in mail.columns else mail.withColumn("link_urls", F.array().cast("array<string>"))
    identity = sender_identity(linked, key)
    summary = auth_summary(auth_claims(mail, key), mail, key)
    failures = signals_of(
        *[
            F.when(
                F.col(f"{m}_failure").isNotNull(),
                signal(f"reported-{m}-failure", F.col(f"{m}_failure"), F.concat(F.lit(f"Headers report {m} "), F.col(f"{m}_failed"))),
            )
            for m in _METHODS
        ]
    )
    out = summary.join(identity.drop("risk_score"), key)
    out = out.withColumn("signals", union_signals(F.col("signals"), failures))
    return out.withColumn("risk_score", score_weights(F.col("signals")))


def received_hops(mail: DataFrame, key: str = "msg_id") -> DataFrame:
    """``key, hop, header, ips`` per Received header: valid IPv4 and bracketed IPv6 literals."""
    hops = mail.select(key, F.posexplode(header_values(F.col("headers"), "received")).alias("hop", "header"))
    v4 = F.filter(
        F.regexp_extract_all("header", F.lit(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"), F.lit(0)),
        lambda ip: F.forall(F.split(ip, r"\."), lambda n: n.cast("int") <= 255),
    )
    v6 = F.filter(
        F.transform(F.regexp_extract_all("header", F.lit(r"(?i)\[(?:IPv6:)?([0-9a-f:]{3,})\]"), F.lit(1)), lambda s: F.lower(s)),
        lambda s: s.contains(":") & ~s.rlike(":::|::.*::|[0-9a-f]{5,}"),
    )
    return hops.withColumn("ips", F.array_distinct(F.concat(v4, v6)))


def body_links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[),.;!?]+\z", ""))


def normal_link(u: Column) -> Column:
    """An HTTP(S) address with lower-case scheme and host, without the scheme's own port, with a path."""
    scheme = F.lower(F.regexp_extract(u, "(?i)^(https?):", 1))
    authority = F.regexp_extract(u, "(?i)^https?://([^/?#]*)", 1)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    bare = F.when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(F.regexp_replace(host, ":(80)?$", ""))
    rest = F.regexp_extract(u, r"(?is)^https?://[^/?#]*(.*)\z", 1)
    return F.concat(scheme, F.lit("://"), user, bare, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def mail_links(mail: DataFrame, key: str = "msg_id") -> DataFrame:
    """``key, pos, url, source, label, mismatch`` from plain text, HTML text, anchors, images and forms.

    Unique by URL and source: the place of the first sighting, the content of the last. Addresses are
    compared and returned in normal form, so a label that spells the same address otherwise is no mismatch.
    """
    entry = lambda u, s, label=None: F.struct(
        normal_link(u).alias("url"), F.lit(s).alias("source"), (label if label is not None else F.lit(None)).cast("string").alias("label")
    )
    http = lambda c: c.rlike("(?i)^https?://[^/?#]")
    all_links = F.concat(
        F.transform(body_links(blank("plain_text")), lambda u: entry(u, "body")),
        F.transform(body_links(blank("html")), lambda u: entry(u, "body")),
        F.transform(F.filter("images", http), lambda u: entry(u, "image")),
        F.transform(F.filter("anchors", lambda a: http(a["href"])), lambda a: entry(a["href"], "href", a["label"])),
        F.transform(F.filter("forms", lambda f: http(f["action"])), lambda f: entry(f["action"], "form")),
    )
    keyed = F.transform(all_links, lambda x: F.concat_ws("\n", x["url"], x["source"]))
    rows = mail.select(key, all_links.alias("_l"), keyed.alias("_k")).select(
        key, F.posexplode(F.array_distinct("_k")).alias("pos", "_id"), "_l", "_k"
    )
    last = F.size("_k") - F.array_position(F.reverse("_k"), F.col("_id")).cast("int")
    rows = rows.select(key, "pos", F.get("_l", last).alias("x")).select(key, "pos", "x.*")
    said = F.trim(blank("label"))
    return rows.withColumn("mismatch", http(said) & (normal_link(said) != F.col("url")))


def model_text(mail: DataFrame) -> Column:
    """Subject, text, hidden text and links as one text."""
    parts = F.concat(
        F.array(blank("subject"), blank("plain_text")), F.coalesce("hidden_text", F.array()), F.coalesce("link_urls", F.array())
    )
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")
