"""Regex fragments with one meaning in every engine: ASCII classes, explicit boundaries and white space."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelled out: ASCII, no-break and typographic spaces, line and paragraph separators.
WS = r"\t\n\x0B\f\r    -     　﻿"
#: A word boundary over ASCII word characters only.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Before and after a whole token: no word character and no dash.
LEFT, RIGHT = r"(?<![A-Za-z0-9_-])", r"(?![A-Za-z0-9_-])"


def whole(body: str) -> str:
    return f"{LEFT}(?:{body}){RIGHT}"


def portable(pattern: str) -> str:
    r"""A user's pattern for this engine: \b with ASCII meaning, \s with all white space."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(B)
        elif two == r"\s":
            out.append(WS if in_class else f"[{WS}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def with_flags(pattern: str, flags: str | None) -> str:
    return ("(?i)" if "i" in (flags or "") else "") + pattern


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_of(column: Column) -> str:
    """The SQL of a plain column, which is its name."""
    return repr(column)[len("Column<'") : -len("'>")]


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scalar(build: Callable[..., str]) -> Callable:
    """A function from SQL of its argument to SQL, which given a plain column gives a column.

    Large expressions are built as text: one call to the engine makes them, and they can be registered as SQL functions.
    """

    @wraps(build)
    def apply(value: Column | str, *args) -> Column | str:
        return F.expr(build(sql_of(value), *args)) if isinstance(value, Column) else build(value, *args)

    return apply
