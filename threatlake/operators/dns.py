"""Domain-name features of DNS events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.text import shannon_entropy


def clean_domain(c: Column) -> Column:
    return F.lower(F.rtrim(F.trim(c), F.lit(".")))


def _ends(c: Column, endings) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(e) for e in endings], F.lit(False))


def is_dynamic_dns(c: Column) -> Column:
    return c.isin(*V.DYNAMIC_DNS) | _ends(c, [f".{d}" for d in V.DYNAMIC_DNS])


def dns_domain_features(df: DataFrame, domain: str = "domain", only: Column | None = None) -> DataFrame:
    """Clean name, dynamic-DNS and TLD flags, label entropy, generated-name test, indicators. Rows outside ``only`` have the clean name and the
    features of an empty one."""
    df = df.withColumn(domain, F.coalesce(clean_domain(F.col(domain)), F.lit("")))
    name = F.col(domain) if only is None else F.when(only, F.col(domain)).otherwise("")
    df = df.withColumn("__label", F.substring_index(name, ".", 1))
    label = F.col("__label")
    df = df.withColumn("entropy", F.round(shannon_entropy(label), 3))
    size = F.length(label)
    vowels = F.try_divide(F.regexp_count(label, F.lit("[aeiou]")), size)
    mixed = label.rlike(r"(?U)\p{IsDigit}") & label.rlike(r"\p{IsAlphabetic}")
    generated = (size >= 12) & ((F.col("entropy") >= 3.6) | (F.coalesce(vowels < 0.15, F.lit(False)) & mixed))
    df = df.withColumns(
        {
            "is_dynamic_dns": is_dynamic_dns(name),
            "is_suspicious_tld": _ends(name, V.ABUSED_DNS_TLDS),
            "is_potential_dga": generated,
        }
    )
    return df.withColumn(
        "indicators",
        F.array_compact(
            F.array(
                F.when(F.col("is_dynamic_dns"), F.lit("Dynamic DNS domain service")),
                F.when(F.col("is_suspicious_tld"), F.lit("Domain uses high-abuse / high-spam TLD")),
                F.when(
                    F.col("is_potential_dga"),
                    F.concat(F.lit("High-entropy / possible DGA label (entropy "),
                             F.col("entropy").cast("string"), F.lit(")")),
                ),
                F.when(name.contains("xn--"), F.lit("Internationalized / Punycode domain")),
            )
        ),
    ).drop("__label")
