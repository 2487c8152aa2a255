"""Column functions over labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names that hold a recording without naming its session.
CONTAINER_NAMES = ["raw", "ephys", "physiology", "continuous", "data"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_sync_label(label) -> Column:
    """A part of the label, cut at ';' and '#', reads SY with optional digits."""
    parts = F.split(F.lower(_c(label)), "[;#]")
    return F.exists(parts, lambda p: F.trim(p).rlike("^sy[0-9]*$"))


def path_parts(path) -> Column:
    """Non-empty parts of a slash- or backslash-separated path."""
    return F.filter(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), lambda p: F.length(p) > 0)


def session_name(path, containers=None) -> Column:
    """Last path part that is neither a container folder, a record node nor a drive."""
    skip = F.array(*[F.lit(c) for c in (containers or CONTAINER_NAMES)])
    named = F.filter(
        path_parts(path),
        lambda p: ~F.array_contains(skip, F.lower(p)) & ~F.lower(p).rlike("^record node|:$"))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), path_stem(path))


def path_stem(path) -> Column:
    """Last path part without its extension."""
    last = F.try_element_at(path_parts(path), F.lit(-1))
    return F.regexp_replace(last, r"(.)\.[^.]*$", "$1")


def is_ancestor(parent, child) -> Column:
    """`parent` is `child` or a folder above it."""
    p, c = F.rtrim(_c(parent), F.lit("/")), F.rtrim(_c(child), F.lit("/"))
    return (p == c) | c.startswith(F.concat(p, F.lit("/")))


def template_root(template) -> Column:
    """Folder part of a template before the first brace."""
    return F.regexp_extract(_c(template), r"^([^{]*)/[^/]*\{.*$", 1)
