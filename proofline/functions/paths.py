"""Path arithmetic on ``/``-separated locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.catalogs import COMPONENT_MARKERS, DEFAULT_COMPONENT
from proofline.functions.lookup import column, filled


def normalise(path: Column | str) -> Column:
    """Resolve ``.``, ``..`` and doubled separators; clean paths skip the fold."""
    path = column(path)

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when(climbs, F.slice(done, 1, F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)
    untidy = path.rlike(r"//|(^|/)\.\.?(/|$)|/$")
    return F.when(untidy, F.when(rooted == "", F.lit(".")).otherwise(rooted)).otherwise(path)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(column(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.]+.*?(\.[^.]*)$", 1))


def component(path: Column | str, markers: Sequence[str] = COMPONENT_MARKERS) -> Column:
    """The part after the first marker present (markers tried in order), else the parent directory.

    Expects a normalised path. One short pattern per marker keeps this cheap inside wide projections.
    """
    path = column(path)
    candidates = [filled(F.regexp_extract(path, f"(?:^|/){m}/([^/]+)", 1)) for m in markers]
    parent = filled(F.regexp_extract(path, "([^/]+)/[^/]+$", 1))
    return F.coalesce(*candidates, parent, F.lit(DEFAULT_COMPONENT))


def relative_path(path: Column | str, root: Column | str) -> Column:
    """Root-relative, percent-encoded path; null when the path is outside the root or has unsafe parts."""
    path = column(path)
    prefix = F.concat(F.rtrim(column(root), F.lit("/")), F.lit("/"))
    inside = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))
    parts = F.split(inside, "/")
    unsafe = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(~unsafe, F.array_join(F.transform(parts, _quote), "/"))


def _quote(part: Column) -> Column:
    encoded = F.url_encode(part)
    for written, kept in (("+", " "), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(written), F.lit(kept))
    return encoded


def safe_failure_path(path: Column | str) -> Column:
    """Whether a stored failure path is relative and free of separators, drives and control characters."""
    path = column(path)
    return F.coalesce(
        (path != "")
        & ~path.rlike(r"[\\:\x00-\x1f]")
        & ~path.startswith("/")
        & ~path.rlike(r"(^|/)\.\.(/|$)"),
        F.lit(False),
    )


def display_path(path: Column | str, segments: int = 3) -> Column:
    """The last segments of an absolute path behind an ellipsis; other paths with forward slashes only."""
    path = column(path)
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    absolute = path.rlike(r"^[A-Za-z]:[\\/]") | path.startswith("/")
    shortened = F.concat(F.lit("…/"), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (segments - 1)), segments), "/"))
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("—")).when(
        absolute & (F.size(parts) > segments), shortened
    ).otherwise(plain)


def repository_name(path: Column | str) -> Column:
    parts = F.filter(F.split(column(path), r"[\\/]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), filled(path), F.lit("Current repository"))
