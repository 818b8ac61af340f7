"""Column expressions on paths: globs, suffixes, safety, order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Java regular expression of a shell pattern; ``*`` and ``?`` match slashes, too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := pattern.find("]", i + (pattern[i : i + 1] == "!") + 1)) > 0:
            inner = pattern[i:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]")
            i = close + 1
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
    return "".join(out)


def globs_regex(patterns: list[str] | tuple[str, ...]) -> str:
    """One expression for any of ``patterns``; a pattern that begins with ``**/`` also matches at the root."""
    every = [p for x in patterns for p in ((x, x[3:]) if x.startswith("**/") else (x,))]
    return r"(?s)\A(?:" + "|".join(glob_regex(p) for p in every) + r")\z"


def matches_any(path: Column | str, patterns: list[str] | tuple[str, ...]) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike(globs_regex(patterns)) if patterns else F.lit(False)


def parts(path: Column | str) -> Column:
    """Components of a path; ordering by them puts ``a/b`` before ``a-b/c``."""
    return F.split(path, "/")


def name(path: Column | str) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column | str) -> Column:
    """Last suffix with its dot, else empty: none for a leading or a final dot."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def allowed(path: Column | str, extensions: tuple[str, ...], filenames: tuple[str, ...], excluded: tuple[str, ...]) -> Column:
    """Excluded patterns first, then a listed name or a listed suffix in any case."""
    return ~matches_any(path, excluded) & (name(path).isin(*filenames) | F.lower(suffix(path)).isin(*(e.lower() for e in extensions)))


def is_unsafe(path: Column | str) -> Column:
    """Absolute, or with a component that leads upwards."""
    c = F.col(path) if isinstance(path, str) else path
    return c.startswith("/") | F.array_contains(parts(c), "..")


def is_sensitive(path: Column | str) -> Column:
    """Inside a git folder, an environment file or a key file."""
    n = F.lower(name(path))
    return F.array_contains(parts(path), ".git") | (n == ".env") | n.startswith(".env.") | F.lower(suffix(path)).isin(".key", ".pem")
