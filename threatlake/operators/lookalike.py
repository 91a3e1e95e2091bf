"""Domains that imitate a known brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.distance import jaro_winkler_at_least
from threatlake.functions.signals import signal
from threatlake.functions.text import in_list
from threatlake.operators.domains import with_registrable
from threatlake.operators.rulesets import DEFAULT_RULES, DetectionRules

LOOKALIKE_IDS = ["homoglyph", "typosquat", "brand-wrong-domain", "brand-in-domain", "brand-in-subdomain"]
_CHECKS = {
    "brand-wrong-domain": (45, "Named like {b}, but not the official domain of {b}"),
    "homoglyph": (50, "Similar-looking characters imitate {b}"),
    "typosquat": (45, "One typing error away from {b}"),
    "brand-in-domain": (50, "Contains {b}, but is not {d}"),
    "brand-in-subdomain": (50, "Puts {b} in a subdomain of another site"),
}


def fold_confusables(c: Column, one: str = "l") -> Column:
    """Undo usual letter swaps: look-alike alphabets, ``rn``, ``vv``, and digits for letters."""
    s = F.translate(F.lower(c), *P.FOLD_UNICODE)
    s = F.replace(F.replace(s, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(F.translate(s, "1", one), *P.FOLD_DIGITS)


def _variants(tokens: Column) -> Column:
    return F.array_distinct(
        F.concat(
            tokens,
            F.transform(tokens, lambda t: fold_confusables(t, "l")),
            F.transform(tokens, lambda t: fold_confusables(t, "i")),
        )
    )


def _spans(name: Column) -> Column:
    """Hyphen-separated parts of a name and the concatenations of neighbouring parts."""
    parts = F.filter(F.split(name, "-"), lambda p: p != "")
    n = F.size(parts)
    return F.when(
        n > 0,
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda s: F.transform(
                    F.sequence(s, n), lambda e: F.array_join(F.slice(parts, s, e - s + 1), "")
                ),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def lookalike_hosts(hosts: DataFrame, rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """``host, brand, lookalike`` for the distinct hosts that imitate a brand, at most one each.

    The first brand with any matching check wins, then the first check. Brands are literals of the
    plan, so the work is one narrow pass over distinct hosts.
    """
    d = with_registrable(hosts.select("host").distinct(), "host", "_reg")
    d = d.where(~in_list(F.col("_reg"), rules.official_domains))
    d = d.withColumn("_name", F.substring_index("_reg", ".", 1))
    sub = F.expr("substring(host, 1, length(host) - length(_reg))")
    sub_tokens = F.filter(F.flatten(F.transform(F.split(sub, r"\."), lambda x: F.split(x, "-"))), lambda x: x != "")
    folded = fold_confusables(F.col("_name"), "l")
    d = d.withColumns(
        {
            "_names": _variants(F.array_union(_spans(F.col("_name")), F.split("_name", "-"))),
            "_subs": _variants(sub_tokens),
            "_vars": F.array_distinct(
                F.array(
                    folded, fold_confusables(F.col("_name"), "i"), F.translate(folded, "i", "l"), F.translate(folded, "l", "i")
                )
            ),
        }
    )
    brands = F.array(
        *[F.struct(F.lit(n).alias("b"), F.lit(ds[0]).alias("d")) for n, ds in rules.brands]
    )

    def typo(v: Column, b: Column) -> Column:
        near = (F.abs(F.length(v) - F.length(b)) <= 1) & (F.levenshtein(v, b) == 1)
        return near | ((F.length(v) >= 6) & jaro_winkler_at_least(v, b, P.JARO_WINKLER_FLOOR))

    def check(x: Column) -> Column:
        b = x["b"]
        kind = (
            F.when(F.col("_name") == b, "brand-wrong-domain")
            .when(F.array_contains("_vars", b), "homoglyph")
            .when((F.length(b) >= 6) & F.exists("_vars", lambda v: typo(v, b)), "typosquat")
            .when(F.array_contains("_names", b), "brand-in-domain")
            .when(F.array_contains("_subs", b), "brand-in-subdomain")
        )
        return F.struct(kind.alias("id"), b.alias("b"), x["d"].alias("d"))

    hit = F.get(F.filter(F.transform(brands, check), lambda r: r["id"].isNotNull()), F.lit(0))
    found = d.select("host", hit.alias("_hit")).where(F.col("_hit").isNotNull())
    weight, reason = None, None
    for kind, (w, text) in _CHECKS.items():
        said = F.replace(F.replace(F.lit(text), F.lit("{b}"), F.col("_hit.b")), F.lit("{d}"), F.col("_hit.d"))
        test = F.col("_hit.id") == kind
        weight = F.when(test, w) if weight is None else weight.when(test, w)
        reason = F.when(test, said) if reason is None else reason.when(test, said)
    return found.select(
        "host", F.col("_hit.b").alias("brand"), signal(F.col("_hit.id"), weight, reason).alias("lookalike")
    )


def with_lookalike(df: DataFrame, host: str, rules: DetectionRules = DEFAULT_RULES) -> DataFrame:
    """Join the look-alike verdict of the distinct hosts back to all rows.

    Only hosts with a hit are on the right side; the engine broadcasts them when their measured
    size allows and otherwise shuffles with skew handling.
    """
    found = lookalike_hosts(df.select(F.col(host).alias("host")).where(F.col("host").isNotNull()), rules)
    found = found.withColumnRenamed("host", "__lh")
    return df.join(found, F.col(host) == F.col("__lh"), "left").drop("__lh")
