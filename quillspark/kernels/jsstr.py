"""Strings as a UTF-16 platform sees them: white space, lengths and slices."""

from __future__ import annotations

import re

#: The characters that count as white space there.
WS_CHARS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{re.escape(WS_CHARS)}]"
WS_RUN = re.compile(f"{WS}+")


def trim(text: str) -> str:
    """Without white space at either end."""
    return text.strip(WS_CHARS)


def wide(text: str) -> bool:
    """Whether a character needs two units."""
    return bool(text) and max(text) > "\uffff"


def units(text: str) -> str:
    """The text with one character per UTF-16 unit."""
    if not wide(text):
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def text_of(unit_text: str) -> str:
    """The text that units spell; a lone half becomes the replacement character."""
    return unit_text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def length(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text) if wide(text) else len(text)


def head(text: str, n: int) -> str:
    """The first ``n`` units."""
    return text_of(units(text)[:n]) if wide(text) else text[:n]
