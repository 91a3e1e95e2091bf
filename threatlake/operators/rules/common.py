"""Predicates shared by the rule families."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.patterns import from_python
from threatlake.functions.text import base_name, blank, contains_any, first_match, in_list, parent_directory, text_array, windows_parts


def is_writable_path(path: Column) -> Column:
    """A whole path component is a user-writable folder name."""
    return F.coalesce(
        F.arrays_overlap(windows_parts(F.lower(path)), text_array(V.WRITABLE_DIRS)), F.lit(False)
    )


def names_writable_folder(command: Column) -> Column:
    """The command contains ``\\name\\`` or ``/name/``: the same separator on both sides."""
    low = F.lower(blank(command))
    needles = [f"{sep}{d}{sep}" for d in V.WRITABLE_DIRS for sep in ("\\", "/")]
    return contains_any(low, needles)


def mentions_writable_name(path: Column) -> Column:
    """Plain substring form, used only by the malicious-address correlation."""
    return contains_any(F.lower(blank(path)), V.WRITABLE_DIRS)


def command_pattern(command: Column) -> Column:
    return first_match(blank(command), V.COMMAND_PATTERNS, from_python)


def lolbin_pattern(command: Column) -> Column:
    return first_match(blank(command), V.LOLBIN_PATTERNS, from_python)


def double_extension(filename: Column) -> Column:
    return F.coalesce(F.trim(filename).rlike("(?i)" + V.DOUBLE_EXTENSION), F.lit(False))


def masquerading(name: Column, path: Column) -> Column:
    """A core process name running outside the system directories."""
    inside = in_list(F.trim(F.lower(parent_directory(path))), V.SYSTEM_DIRECTORIES)
    return in_list(F.trim(F.lower(name)), V.CORE_PROCESSES) & (blank(path) != "") & ~inside


__all__ = [
    "is_writable_path", "names_writable_folder", "mentions_writable_name", "command_pattern",
    "lolbin_pattern", "double_extension", "masquerading", "base_name",
]
