"""One pattern source, two dialects.

Patterns are written once with ECMAScript meaning: ASCII word boundaries and case folding, Unicode white space, and line ends
at \\n, U+2028 and U+2029. ``jvm`` states that meaning for java.util.regex; ``re2`` gives the form for the SQL oracle, which
needs neither look-around nor possessive loops. Loops over alternatives are possessive (``*+``) on the JVM, where a plain one
recurses once a turn and overflows the stack on long pages.
"""

from __future__ import annotations

import re

from . import taxonomy as tx

#: White space of ECMAScript's trim and \s.
BLANK = r"\s\x0B   -     　﻿"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: A boundary beside a known word character needs one look only.
_EDGE_BEFORE, _EDGE_AFTER = r"(?<!\w)", r"(?!\w)"
_LINE_START, _LINE_END = r"(?<![^\n  ])", r"(?![^\n  ])"


def jvm(pattern: str, lines: bool = False, fold: bool = True) -> str:
    out = re.sub(r"\\b(?=[A-Za-z0-9])", lambda _: _EDGE_BEFORE, pattern)
    out = re.sub(r"(?<=[A-Za-z0-9])(?<!\\[A-Za-z])\\b", lambda _: _EDGE_AFTER, out)
    out = out.replace(r"\b", _EDGE).replace(r"\s", f"[{BLANK}]")
    if lines:
        out = out.replace("^", _LINE_START, 1)
        if out.endswith("$"):
            out = out[:-1] + _LINE_END
    return ("(?i)" if fold else "") + out


def re2(pattern: str, lines: bool = False, fold: bool = True) -> str:
    flags = ("i" if fold else "") + ("m" if lines else "")
    return (f"(?{flags})" if flags else "") + pattern.replace("*+", "*")


def sql(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def context_patterns() -> dict[str, tuple[str, bool]]:
    """The context patterns with names filled in, and whether they are bound to lines."""
    name = f"(?:{'|'.join(tx.HEADINGS.values())}|{tx.NOUNS})"
    thing = tx.OBJECT.replace("{name}", name)
    return {k: (p.replace("{object}", thing).replace("{name}", name), p.startswith("^")) for k, p in tx.CONTEXT.items()}
