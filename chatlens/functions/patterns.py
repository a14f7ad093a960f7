"""Search text -> LIKE pattern (traps of user input).

User text goes into ``ILIKE '%text%'`` unescaped, so ``%`` and ``_`` typed by
the user stay wildcards. Backslash handling is normalized over the whole
pattern, in escape pairs, left to right: ``\\%``, ``\\_`` and ``\\\\`` are kept
as escapes; any other ``\\x`` becomes ``x`` (Spark would raise on it, the
original database matches the character). A single trailing backslash escapes
the closing ``%``, as there.
"""

from __future__ import annotations

import re

_KEEP = {"%", "_", "\\"}
_PAIR = re.compile(r"\\(.)", flags=re.S)


def normalize_like(pattern: str) -> str:
    """Rewrite escape pairs so Spark's LIKE (escape ``\\``) accepts them."""
    return _PAIR.sub(lambda m: m.group(0) if m.group(1) in _KEEP else m.group(1),
                     pattern)


def contains_pattern(text: str) -> str:
    """``%text%`` with escapes normalized."""
    return normalize_like(f"%{text}%")

