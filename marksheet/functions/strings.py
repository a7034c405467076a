"""Column helpers with Python ``str`` semantics, built from Spark built-ins only.

Spark's ``trim`` removes spaces only and Java's ``\\s``/``\\W``/``\\b`` are ASCII unless ``(?U)``
is set; these helpers pin the Python behaviour the grading rules were written against.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes when called without arguments
# (str.isspace() is true for exactly these code points).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c, fn) -> Column:
    """Bind ``c`` once and use it many times inside ``fn`` (a one-element ``transform``).

    Chained rewrite steps that reference their input more than once would otherwise copy the
    whole upstream expression tree at each step (exponential growth, repeated evaluation).
    """
    return F.element_at(F.transform(F.array(col_(c)), fn), 1)


def let2(a, b, fn) -> Column:
    z = F.struct(col_(a).alias("a"), col_(b).alias("b"))
    return F.element_at(F.transform(F.array(z), lambda v: fn(v["a"], v["b"])), 1)


def strip(c, chars: str | None = None) -> Column:
    """``s.strip(chars)``; whitespace when ``chars`` is None."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE if chars is None else chars))


def rstrip(c, chars: str | None = None) -> Column:
    return F.rtrim(col_(c), F.lit(PY_WHITESPACE if chars is None else chars))


def lstrip(c, chars: str | None = None) -> Column:
    return F.ltrim(col_(c), F.lit(PY_WHITESPACE if chars is None else chars))


def count_sub(c, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring, like ``s.count(sub)``."""
    c = col_(c)
    return F.floor((F.char_length(c) - F.char_length(F.replace(c, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def has(c, sub: str) -> Column:
    return F.contains(col_(c), F.lit(sub))


def replace(c, old: str, new: str = "") -> Column:
    return F.replace(col_(c), F.lit(old), F.lit(new))


def after_first(c, sep: str) -> Column:
    """``s.split(sep, 1)[1]``; only meaningful where ``sep in s``."""
    c = col_(c)
    return F.substring(c, F.instr(c, sep) + F.lit(len(sep)), F.lit(2**31 - 1))


def before_first(c, sep: str) -> Column:
    """``s.split(sep, 1)[0]`` (the whole string if ``sep`` is absent)."""
    return F.substring_index(col_(c), sep, 1)


def after_last(c, sep: str) -> Column:
    """``s.split(sep)[-1]`` (the whole string if ``sep`` is absent)."""
    return F.substring_index(col_(c), sep, -1)


def drop_first_char_if(c, ch: str) -> Column:
    return let(c, lambda c: F.when(F.startswith(c, F.lit(ch)), F.substring(c, 2, 2**31 - 1)).otherwise(c))


def drop_last_char_if(c, ch: str) -> Column:
    return let(c, lambda c: F.when(F.endswith(c, F.lit(ch)), F.left(c, F.char_length(c) - F.lit(1))).otherwise(c))


def split_literal(c, sep: str) -> Column:
    """``s.split(sep)`` for a literal separator (regex-quoted for Spark's ``split``)."""
    return F.split(col_(c), _quote(sep), -1)


def _quote(sep: str) -> str:
    out = []
    for ch in sep:
        out.append("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch)
    return "".join(out)
