"""Messages: de-obfuscation, scam language, links, call-back numbers and tactic fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.patterns import from_ecmascript, required_literals
from threatlake.functions.signals import (
    no_signals, signal, signal_if, signals_of, union_signals, with_verdict,
)
from threatlake.functions.text import blank, clip, contains_any, in_list, let, nfkc
from threatlake.operators.rulesets import DEFAULT_RULES, DetectionRules
from threatlake.operators.urls import scan_urls, url_signals
from threatlake.session import cut_lineage

_URL_SPAN = from_ecmascript(r"https?:\/\/\S+|www\.\S+")
_SPACED = r"(?<![A-Za-z0-9_])(?:[A-Za-z][ \t.\-_*]){2,}[A-Za-z](?![A-Za-z0-9_])"
_LEET_TOKEN = "[A-Za-z0-9@$]{3,}"
_TOKEN = from_ecmascript(r"\s+", ignore_case=False)
_VOCABULARY = P.SCAM_VOCABULARY + [b for b, _ in P.BRANDS]
_ZERO = f"[{P.ZERO_WIDTH}]"
_NO_TEXT = "array<string>"


def matches_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match by ``change(match)``; null keeps the match."""
    return F.array_join(
        F.zip_with(
            F.split(text, pattern, -1),
            matches_of(text, pattern),
            lambda gap, hit: F.concat(gap, F.coalesce(change(hit), hit, F.lit(""))),
        ),
        "",
    )


def _mixed(token: Column) -> Column:
    return token.rlike("[A-Za-z]") & token.rlike("[\\u0370-\\u03FF\\u0400-\\u04FF]")


def _collapsed(match: Column) -> Column:
    joined = F.regexp_replace(match, r"[ \t.\-_*]", "")
    return F.when((F.length(joined) >= 5) | in_list(F.lower(joined), _VOCABULARY), joined)


def _decoded(token: Column) -> Column:
    """Vocabulary word behind a leet spelling, null where there is none."""
    plausible = token.rlike("[013457@$]") & ~token.rlike(r"[0-9]{3}") & token.rlike("[A-Za-z]")
    base = F.translate(F.lower(token), *P.LEET)
    with_i, with_l = F.translate(base, "1", "i"), F.translate(base, "1", "l")
    return F.when(
        plausible, F.when(in_list(with_i, _VOCABULARY), with_i).when(in_list(with_l, _VOCABULARY), with_l)
    )


def deobfuscate(df: DataFrame, text: str = "text", out: str = "clean_text", signals: str = "obfuscation") -> DataFrame:
    """Add the cleaned text and its ``obfuscation-*`` signals.

    Compatibility composition, removal of zero-width characters, look-alike letters inside Latin
    words, spaced-out letters, and leet spellings of scam vocabulary. URLs are never rewritten. Each
    step runs only on texts that a cheap test finds it can change.
    """
    df = df.withColumn("__t0", nfkc(blank(text)))
    wide = F.col("__t0").rlike(r"[^\x00-\x7F]")
    df = df.withColumns(
        {
            "__hidden": F.when(wide, F.regexp_count("__t0", F.lit(_ZERO))).otherwise(0),
            "__t1": F.when(wide, F.regexp_replace("__t0", _ZERO, "")).otherwise(F.col("__t0")),
        }
    )
    linked = F.col("__t1").contains("://") | F.lower("__t1").contains("www.")
    df = df.withColumns(
        {
            "__urls": F.when(linked, matches_of(F.col("__t1"), _URL_SPAN)).otherwise(F.array().cast(_NO_TEXT)),
            "__s0": F.when(linked, F.split("__t1", _URL_SPAN, -1)).otherwise(F.array("__t1")),
        }
    )
    foreign = F.col("__t1").rlike("[\\u0370-\\u03FF\\u0400-\\u04FF]")
    tokens = lambda s: F.split(s, _TOKEN, -1)
    fixed = F.transform(
        "__s0",
        lambda s: _rewrite(
            s, "\\S+", lambda t: F.when(_mixed(t), F.translate(t, *P.SCRIPT_CONFUSABLES))
        ),
    )
    df = df.withColumns(
        {
            "__s1": F.when(foreign, fixed).otherwise(F.col("__s0")),
            "__mixed": F.when(
                foreign, F.filter(F.flatten(F.transform("__s0", tokens)), lambda t: (t != "") & _mixed(t))
            ).otherwise(F.array().cast(_NO_TEXT)),
        }
    )
    spaced = F.exists("__s1", lambda s: s.rlike(_SPACED))
    df = df.withColumns(
        {
            "__s2": F.when(spaced, F.transform("__s1", lambda s: _rewrite(s, _SPACED, _collapsed))).otherwise(F.col("__s1")),
            "__spaced": F.when(
                spaced,
                F.filter(F.flatten(F.transform("__s1", lambda s: matches_of(s, _SPACED))), lambda m: _collapsed(m).isNotNull()),
            ).otherwise(F.array().cast(_NO_TEXT)),
        }
    )
    leet = F.exists("__s2", lambda s: s.rlike("[A-Za-z][013457@$]|[013457@$][A-Za-z]"))
    df = df.withColumns(
        {
            "__s3": F.when(leet, F.transform("__s2", lambda s: _rewrite(s, _LEET_TOKEN, _decoded))).otherwise(F.col("__s2")),
            "__leet": F.when(
                leet,
                F.filter(F.flatten(F.transform("__s2", lambda s: matches_of(s, _LEET_TOKEN))), lambda m: _decoded(m).isNotNull()),
            ).otherwise(F.array().cast(_NO_TEXT)),
        }
    )
    joined = F.array_join(
        F.transform("__s3", lambda s, i: F.concat(s, F.coalesce(F.get(F.col("__urls"), i), F.lit("")))), ""
    )
    shown = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    w = P.OBFUSCATION_WEIGHTS
    found = signals_of(
        signal_if(F.col("__hidden") >= 2, "obfuscation-hidden-chars", w["hidden-chars"], "Invisible characters",
                  F.concat(F.col("__hidden").cast("string"), F.lit(" invisible characters"))),
        signal_if(F.size("__mixed") > 0, "obfuscation-mixed-script", w["mixed-script"],
                  "Letters of other alphabets inside words", shown("__mixed")),
        signal_if(F.size("__spaced") > 0, "obfuscation-spaced-letters", w["spaced-letters"],
                  "Letters spread apart", shown("__spaced")),
        signal_if(F.size("__leet") > 0, "obfuscation-leet", w["leet"], "Digits or symbols in place of letters", shown("__leet")),
    )
    return df.withColumns({out: joined, signals: found}).drop(
        *[f"__{n}" for n in ("t0", "hidden", "t1", "urls", "s0", "s1", "s2", "s3", "mixed", "spaced", "leet")]
    )


def located(text: Column, pattern: str) -> Column:
    """All matches as ``hit, at`` with the zero-based start of each."""
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda n, s: n + F.length(s))
    both = F.struct(matches_of(text, pattern).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(
        both,
        lambda b: F.transform(
            b["hits"],
            lambda h, i: F.struct(
                h.alias("hit"),
                (total(F.slice(b["gaps"], 1, i + 1)) + total(F.slice(b["hits"], 1, i))).alias("at"),
            ),
        ),
    )


def _before(text: Column, at: Column, size: int) -> Column:
    start = F.greatest(at - size, F.lit(0))
    return F.substr(text, start + 1, at - start)


def protective_positions(text: Column) -> Column:
    pattern = from_ecmascript(P.PROTECTIVE)
    return F.when(
        text.rlike(pattern), F.transform(located(text, pattern), lambda m: m["at"])
    ).otherwise(F.array().cast("array<int>"))


def live_match(text: Column, pattern: str, protected: Column, hindi: bool) -> Column:
    """First match that is neither negated nor under a protective phrase, else the empty string."""
    negation = from_ecmascript(P.NEGATION_BEFORE)

    def live(m: Column) -> Column:
        at = m["at"]
        shielded = F.exists(protected, lambda p: (at >= p) & (at - p <= P.PROTECTIVE_WINDOW))
        ok = ~_before(text, at, P.NEGATION_LOOKBACK).rlike(negation) & ~shielded
        return ok & ~m["hit"].rlike(from_ecmascript(P.HINDI_NEGATION, False)) if hindi else ok

    first = F.get(F.filter(located(text, pattern), live), F.lit(0))
    return F.when(text.rlike(pattern), F.coalesce(first["hit"], F.lit(""))).otherwise(F.lit(""))


def _possible(pattern: str) -> Column:
    """Plain substring test on the lower-cased text that every match of the pattern passes."""
    test = F.lit(True)
    groups = [sorted(x for x in g if not any(y != x and y in x for y in g)) for g in required_literals(pattern)]
    for literals in sorted(groups, key=len):
        test = test & contains_any(F.col("__low"), literals)
    return test


def scam_signals(df: DataFrame, text: str = "text", out: str = "scam", context: bool = True) -> DataFrame:
    """Add ``out`` (signals) and ``tactics`` in rule order: all rules in one pass over each text.

    ``context=False`` takes the first match of every rule, whatever precedes it.
    """
    df = df.withColumns(
        {
            "__prot": protective_positions(F.col(text)) if context else F.array().cast("array<int>"),
            "__low": F.lower(text),
        }
    )
    body, rows = F.col(text), []
    for rid, tactic, weight, negatable, hindi, pattern in P.SCAM_RULES:
        java = from_ecmascript(pattern, ignore_case=not hindi)
        hit = (
            live_match(body, java, F.col("__prot"), hindi)
            if negatable and context
            else F.regexp_extract(body, java, 0)
        )
        rows.append(
            F.struct(
                F.lit(rid).alias("id"), F.lit(tactic).alias("tactic"), F.lit(weight).alias("weight"),
                F.when(_possible(pattern), hit).otherwise(F.lit("")).alias("hit"),
            )
        )
    df = df.withColumn("__hits", F.filter(F.array(*rows), lambda r: r["hit"] != ""))
    return df.withColumns(
        {
            out: F.transform(
                "__hits",
                lambda r: signal(r["id"], r["weight"], F.concat(F.lit("Scam language: "), r["id"]), clip(r["hit"], 80)),
            ),
            "tactics": F.array_distinct(F.transform("__hits", lambda r: r["tactic"])),
        }
    ).drop("__prot", "__low", "__hits")


def links_in(text: Column) -> Column:
    """All links, without trailing punctuation, ``http://`` added to bare ``www.``."""
    found = matches_of(text, from_ecmascript(P.LINK_PATTERN))
    cut = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+\z", ""))
    return F.transform(cut, lambda u: F.when(u.rlike("(?i)^https?:"), u).otherwise(F.concat(F.lit("http://"), u)))


def text_links(df: DataFrame, text: str = "text", out: str = "links") -> DataFrame:
    return df.withColumn(out, links_in(blank(text)))


def worst_links(df: DataFrame, key: str, links: str = "links", rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """``key, worst, first_link, link_domains`` of the rows that have links.

    Links are scored once per distinct URL and joined back; the highest score wins, the earliest
    position on ties. The rows are read several times: pass a table or a frame whose lineage was cut, if their links are costly.
    """
    flat = df.select(F.col(key), F.posexplode(links).alias("pos", "url"))
    judged = with_verdict(url_signals(flat.select("url").distinct(), rules, keep=True)).select(
        "url", F.col("score").alias("link_score"), "host", "registrable", "url_valid"
    )
    joined = flat.join(judged, "url")
    info = F.struct("url", F.coalesce("host", F.lit("unknown")).alias("host"), F.col("link_score").alias("score"))
    return joined.groupBy(key).agg(
        F.max_by(info, F.struct("link_score", -F.col("pos"))).alias("worst"),
        F.min_by(F.struct("url", "host"), F.when(F.col("url_valid"), F.col("pos"))).alias("first_link"),
        F.collect_set(F.when(F.col("url_valid"), F.col("registrable"))).alias("link_domains"),
    )


def named_brands(text: Column, brands=P.BRANDS) -> Column:
    """The brands that a text names, in order."""
    low = F.lower(text)
    solid = F.regexp_replace(low, from_ecmascript(r"\s+", False), "")

    def named(low: Column, solid: Column) -> Column:
        found = []
        for name, _ in brands:
            test = low.contains(name) & low.rlike(from_ecmascript(rf"\b{name}\b", False))
            if len(name) >= 7:
                test = test | solid.contains(name)
            found.append(F.when(test, F.lit(name)))
        return F.array_compact(F.array(*found))

    return let(F.struct(low.alias("low"), solid.alias("solid")), lambda t: named(t["low"], t["solid"]))


def unlinked_brand(named: Column, domains: Column, brands=P.BRANDS) -> Column:
    """First of the named brands that no link goes to; null without one, or without links."""
    expr = F.lit(None).cast("string")
    for name, official in reversed(brands):
        own = F.arrays_overlap(domains, F.array(*[F.lit(d) for d in official]))
        expr = F.when(F.array_contains(named, name) & ~own, F.lit(name)).otherwise(expr)
    return F.when(F.size(domains) > 0, expr)


def brand_link_mismatch(text: Column, domains: Column, brands=P.BRANDS) -> Column:
    """First brand the text names although no link goes to it; null without one."""
    return unlinked_brand(named_brands(text, brands), domains, brands)


def callback_number(text: Column) -> Column:
    """First phone number with a call verb in the forty characters before it."""
    phone, verb = from_ecmascript(P.PHONE_PATTERN, False), from_ecmascript(P.CALL_VERB)
    hits = F.filter(located(text, phone), lambda m: _before(text, m["at"], P.CALL_LOOKBACK).rlike(verb))
    return F.when(text.rlike(verb) & text.rlike(phone), F.get(hits, F.lit(0))["hit"])


def style_signals(text: Column) -> Column:
    # a count of matches would build a string for each letter
    count = lambda others: F.length(F.regexp_replace(text, others, ""))
    letters = count("[^A-Za-z]+")
    shouting = (letters >= 30) & F.coalesce(F.try_divide(count("[^A-Z]+"), letters) > 0.6, F.lit(False))
    marks = F.length(text) - F.length(F.replace(text, F.lit("!")))
    return signals_of(
        signal_if(shouting, "shouting", 8, "Mostly capital letters"),
        signal_if(marks >= 3, "exclamation-spam", 6, "Many exclamation marks"),
    )


def strong_tactics(tactics: Column) -> Column:
    return F.filter(tactics, lambda t: t != "lure")


def has_pressure(tactics: Column) -> Column:
    return F.exists(tactics, lambda t: t.isin(*P.PRESSURE_TACTICS))


def fuse_tactics(tactics: Column) -> Column:
    """``multi-tactic`` from two strong tactics on."""
    strong = strong_tactics(tactics)
    n = F.size(strong)
    weight = F.when(n >= 4, 35).when(n == 3, 25).otherwise(12)
    return signals_of(
        signal_if(n >= 2, "multi-tactic", weight, F.concat(F.lit("Combines tactics: "), F.array_join(strong, ", ")))
    )


def text_findings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and what a message says by itself: signals, tactics, links, the brands it names, a number to call. The text is read here and nowhere else."""
    df = scam_signals(deobfuscate(df.select(key, F.col(text).alias("__text")), "__text"), "clean_text")
    df = text_links(df, "clean_text", "links")
    clean, strong = F.col("clean_text"), F.size(strong_tactics(F.col("tactics"))) > 0
    return df.select(
        key, "obfuscation", "scam", "tactics", "links", style_signals(blank("__text")).alias("style"),
        F.when(strong & (F.size("links") > 0), named_brands(clean)).otherwise(F.array().cast(_NO_TEXT)).alias("brands"),
        F.when(has_pressure(F.col("tactics")), callback_number(clean)).alias("call"),
    )


def text_signals(df: DataFrame, key: str, text: str = "text", out: str = "signals", rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """``key`` and all signals of a message, whatever its length. ``key`` identifies the row.

    The findings are narrow; they are kept for the two passes that links need, so that no text is cleaned twice."""
    found = cut_lineage(text_findings(df, key, text))
    worst = worst_links(found.where(F.size("links") > 0), key, "links", rules).withColumnRenamed(key, "__key")
    both = found.join(worst, F.col(key) == F.col("__key"), "left").drop("__key")
    both = both.withColumn("__brand", F.when(F.col("first_link").isNotNull(), unlinked_brand(F.col("brands"), F.col("link_domains"))))
    pressure, worst_score = has_pressure(F.col("tactics")), F.col("worst.score")
    tail = signals_of(
        signal_if(worst_score >= 30, "risky-link", F.least(F.lit(60), worst_score),
                  F.concat(F.lit("Risky link to "), F.col("worst.host")), clip(F.col("worst.url"), 80)),
        signal_if(F.col("__brand").isNotNull(), "brand-link-mismatch", 35,
                  F.concat(F.lit("Names "), F.col("__brand"), F.lit(" but links to "), F.col("first_link.host")),
                  clip(F.col("first_link.url"), 80)),
        signal_if(pressure & (F.size("links") > 0), "pressure-plus-link", 20, "Pressure and a link to click"),
        signal_if(F.col("call").isNotNull(), "pressure-plus-callback", 20, "Pressure and a number to call", F.col("call")),
    )
    return both.select(key, union_signals(F.col("obfuscation"), F.col("scam"), tail, F.col("style"), fuse_tactics(F.col("tactics"))).alias(out))


def scan_text(df: DataFrame, key: str, text: str = "text", rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """``df`` with the signals and the verdict of its messages."""
    judged = with_verdict(text_signals(df, key, text, "signals", rules)).withColumnRenamed(key, "__key")
    return df.join(judged, F.col(key) == F.col("__key")).drop("__key")


def scan_page(df: DataFrame, key: str, url: str = "url", text: str = "text", rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """Address and visible text together: URL signals, then text signals, one verdict."""
    of_text = text_signals(df, key, text, "__text", rules).withColumnRenamed(key, "__key")
    both = url_signals(df, rules, url).join(of_text, F.col(key) == F.col("__key")).drop("__key")
    return with_verdict(both.withColumn("signals", union_signals(F.col("signals"), F.col("__text"))).drop("__text"))


__all__ = [
    "deobfuscate", "scam_signals", "text_links", "worst_links", "brand_link_mismatch", "callback_number",
    "style_signals", "fuse_tactics", "text_signals", "scan_text", "scan_page", "scan_urls", "no_signals",
]
