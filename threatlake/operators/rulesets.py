"""The editable detection rules: brands, endings, shorteners and keywords."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from threatlake import fixed_values_phishing as P

_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_HOSTNAME = rf"^(?=.{{1,253}}\z)(?:(?=[^.]{{1,63}}\.){_LABEL}\.)+(?=[^.]{{1,63}}\z){_LABEL}\z"
LIST_PATTERNS = {
    "tld": r"^[a-z0-9-]{2,63}\z",
    "shortener": _HOSTNAME,
    "keyword": r"^[a-z0-9-]{2,50}\z",
}
MAX_RULES = 20_000


@dataclass(frozen=True)
class DetectionRules:
    """Small policy lists. They become literals of the plan, so their number is checked on load."""

    brands: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default_factory=lambda: tuple((n, tuple(d)) for n, d in P.BRANDS)
    )
    tlds: tuple[str, ...] = tuple(P.SUSPICIOUS_TLDS)
    shorteners: tuple[str, ...] = tuple(P.URL_SHORTENERS)
    keywords: tuple[str, ...] = tuple(P.SUSPICIOUS_KEYWORDS)

    @property
    def official_domains(self) -> list[str]:
        return sorted({d for _, domains in self.brands for d in domains})


DEFAULT_RULES = DetectionRules()


def parse_rules(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rule lines (``kind, pos, line``) into valid rules and rejects.

    Valid: ``kind, pos, name, domains`` (brands keep their order by ``pos``; list entries appear once).
    Brand lines read ``name=domain, domain``; the other kinds hold items separated by commas.
    """
    text = F.trim(F.col("line"))
    rows = lines.select("kind", "pos", text.alias("line")).where(F.col("line") != "")
    brand = rows.where(F.col("kind") == "brand")
    at = F.instr("line", "=")
    parsed = brand.select(
        "kind", "pos", "line",
        F.lower(F.trim(F.substr("line", F.lit(1), F.greatest(at - 1, F.lit(0))))).alias("name"),
        F.array_distinct(
            F.filter(F.transform(F.split(F.lower(F.substr("line", at + 1)), "[\\n,]"), lambda d: F.trim(d)), lambda d: d != "")
        ).alias("domains"),
        (at > 1).alias("_sep"),
    )
    brand_ok = (
        F.col("_sep")
        & F.col("name").rlike(r"^[a-z0-9-]{2,40}\z")
        & (F.size("domains") > 0)
        & F.forall("domains", lambda d: d.rlike(_HOSTNAME))
    )
    items = (
        rows.where(F.col("kind") != "brand")
        .select("kind", "pos", "line", F.explode(F.split("line", "[\\n,]")).alias("name"))
        .withColumn("name", F.trim(F.lower("name")))
        .where(F.col("name") != "")
        .withColumn("name", F.when(F.col("kind") == "tld", F.regexp_replace("name", r"^\.", "")).otherwise(F.col("name")))
    )
    item_ok = F.lit(False)
    for kind, pattern in LIST_PATTERNS.items():
        item_ok = item_ok | ((F.col("kind") == kind) & F.col("name").rlike(pattern))
    no_domains = F.lit(None).cast("array<string>")
    good = parsed.where(brand_ok).select("kind", "pos", "name", "domains").unionByName(
        items.where(item_ok).groupBy("kind", "name").agg(F.min("pos").alias("pos")).select(
            "kind", "pos", "name", no_domains.alias("domains"))
    )
    bad = parsed.where(~brand_ok).select("kind", "pos", "line").unionByName(
        items.where(~item_ok).select("kind", "pos", "line")
    )
    return good, bad


def load_rules(lines: DataFrame) -> DetectionRules:
    """Rules from lines; any invalid line refuses the whole edit."""
    good, bad = parse_rules(lines)
    reject = bad.orderBy("kind", "pos").first()
    if reject is not None:
        raise ValueError(f"invalid {reject['kind']} rule: {reject['line']}")
    rows = good.orderBy("kind", "pos", "name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} detection rules")
    pick = lambda kind: tuple(r["name"] for r in rows if r["kind"] == kind)
    return DetectionRules(
        brands=tuple((r["name"], tuple(r["domains"])) for r in rows if r["kind"] == "brand"),
        tlds=pick("tld"), shorteners=pick("shortener"), keywords=pick("keyword"),
    )
