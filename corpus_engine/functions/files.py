"""File-name expressions: base name, extension, safe output name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.text import safe_filename  # noqa: F401  (re-export)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path) -> Column:
    """``os.path.basename``: the part after the last '/'."""
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def file_name(path) -> Column:
    """``Path(path).name``: the last segment that is not empty (a trailing '/' does not hide it)."""
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def extension(path) -> Column:
    """``os.path.splitext(basename)[1].lower()``: last '.' segment, leading dots ignored."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def stem(path) -> Column:
    """Base name without its extension."""
    name = base_name(path)
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    return name.substr(F.lit(1), F.length(name) - F.length(ext))


def has_extension(ext_col, extensions) -> Column:
    """``ext.endswith(tuple)`` on an already lower-cased extension."""
    cond = F.lit(False)
    for e in extensions:
        cond = cond | F.endswith(_col(ext_col), F.lit(e))
    return cond
