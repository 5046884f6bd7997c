"""Path predicates: wildcard masks, excluded directories, the tool's own files, one excluded path."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, functions as F

from ..functions.constants import ARTEFACT_SUFFIXES, EXCLUDED_DIRECTORIES


def split_masks(text: str, separator: str = ",") -> list[str]:
    """Driver-side list of masks; ``separator`` is a comma or a newline."""
    return [m.strip() for m in text.split(separator) if m.strip()]


def split_masks_column(text: Column, separator: str = ",") -> Column:
    parts = F.transform(F.split(text, re.escape(separator)), lambda m: F.trim(m))
    return F.filter(parts, lambda m: m != "")


def mask_regex(mask: str) -> str:
    """Regex of one mask. ``*`` crosses directories; without a separator the mask means a file name."""
    anywhere = "/" not in mask and "\\" not in mask
    tokens = {"*": ".*", "?": "."}
    body = "".join(tokens.get(ch) or re.escape(ch) for ch in mask.replace("\\", "/"))
    # LF is the only line end, and case is folded over Unicode
    return "(?d)(?iu)^" + ("(?:.*/)?" if anywhere else "") + body + "$"


def matches_any(rel: Column, masks: list[str] | None, default: bool) -> Column:
    wanted = [m.strip() for m in masks or [] if m.strip()]
    if not wanted:
        # an empty list matches all paths, or none
        return rel.rlike(mask_regex("*")) if default else F.lit(False)
    hit = rel.rlike(mask_regex(wanted[0]))
    for mask in wanted[1:]:
        hit = hit | rel.rlike(mask_regex(mask))
    return hit


def included(rel: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    return matches_any(rel, include, True) & ~matches_any(rel, exclude, False)


def in_excluded_directory(rel: Column) -> Column:
    """Some directory above the file, below the base, bears an excluded name."""
    parts = F.split(rel, "/")
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.lower(d))
    return F.arrays_overlap(above, F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES]))


def is_artefact(rel: Column) -> Column:
    name = F.lower(F.element_at(F.split(rel, "/"), -1))
    hit = F.lit(False)
    for suffix in ARTEFACT_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit


def is_top_level(rel: Column) -> Column:
    return F.size(F.split(rel, "/")) == 1


def is_path(path: Column, excluded: str) -> Column:
    """Equality with one path, ignoring case; a relative path is taken from the working directory."""
    full = excluded if "://" in excluded or excluded.startswith("/") else os.path.abspath(excluded)
    return F.upper(path) == full.upper()


def candidate(
    rel: Column, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True
) -> Column:
    """All path rules together, as one filter."""
    keep = ~in_excluded_directory(rel) & ~is_artefact(rel) & included(rel, include, exclude)
    return keep if recursive else keep & is_top_level(rel)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name, dot included; empty when there is none or nothing follows it."""
    return F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
