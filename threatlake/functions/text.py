"""Small string expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_array(values) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once. Inside a lambda a repeated expression is evaluated
    anew for every element, so anything costly is bound here first."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def staged(df, columns: dict):
    """Add columns through a one-row generator instead of a projection.

    Planning cost, not run time: a projection's aliases become constraints that the optimizer
    substitutes into each other above every join, which explodes for long expressions. A generator's
    output carries none, and each value is computed once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def first_truthy(*cols: Column | str) -> Column:
    """``a or b or c`` over strings: empty strings are skipped as well as nulls."""
    return F.coalesce(*[F.nullif(as_col(c), F.lit("")) for c in cols])


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def is_true(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(False))


def in_list(c: Column, values) -> Column:
    values = list(values)
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles], F.lit(False))


def first_match(c: Column, table, translate) -> Column:
    """Label of the first pattern that occurs in ``c``; lazy, so later patterns are not tried."""
    expr = None
    for pattern, label in table:
        test = c.rlike(translate(pattern))
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def char_count(c: Column, ch: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, ch, F.lit("")))


def shannon_entropy(c: Column) -> Column:
    """Bits per character; characters are visited in code order, so the sum is reproducible."""
    size = F.length(c).cast("double")
    distinct = F.array_sort(F.array_distinct(characters(c)))
    total = F.aggregate(
        distinct,
        F.lit(0.0),
        lambda acc, ch: acc - F.try_divide(char_count(c, ch), size) * F.log2(F.try_divide(char_count(c, ch), size)),
    )
    return F.when(F.length(c) > 0, total).otherwise(F.lit(0.0))


def windows_parts(path: Column) -> Column:
    """Path components split on both separators."""
    return F.split(path, r"[\\/]+")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)


def parent_directory(path: Column) -> Column:
    slashes = F.translate(path, "/", "\\")
    return F.when(slashes.contains("\\"), F.regexp_replace(slashes, r"\\[^\\]*$", "")).otherwise(F.lit("."))


def clip(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def size_label(n: Column) -> Column:
    """Byte count for people: whole bytes, one decimal up to MB, two for GB. Ties go to the even digit, as in the reference; format_string alone
    would round them up."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    label = (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.format_string("%.1f KB", F.bround(n / kb, 1)))
        .when(n < gb, F.format_string("%.1f MB", F.bround(n / mb, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / gb, 2)))
    )
    return F.when(n.isNotNull(), label)


def nfkc(c: Column) -> Column:
    """Compatibility composition by the ICU library that ships with Spark; ASCII text skips the call."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def idna_ascii(host: Column) -> Column:
    """Punycode form of an international host name; null where it cannot be encoded."""
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), nfkc(host))
    return F.when(host.rlike(r"[^\x00-\x7F]"), encoded).otherwise(host)
