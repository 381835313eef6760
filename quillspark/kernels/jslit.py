"""The value of a named export in JavaScript source, if it is a literal.

A table of regular expressions turns the source into tokens, and a stack of
open containers puts the value together.  Nothing is executed.
"""

from __future__ import annotations

import json
import math
import re

from quillspark.kernels import jsstr

_SKIP = re.compile(r"(?:[ \t\r\n]+|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))*", re.DOTALL)
_STRING = re.compile(r"""(["'])((?:\\(?:.|\n)|(?!\1)[^\\\n])*)\1""", re.DOTALL)
_TEMPLATE = re.compile(r"`((?:\\.|[^`\\])*)`", re.DOTALL)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]*|[0-9]*(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?)")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.|\n))", re.DOTALL)
# Fixed values.
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "\n": ""}
_IN_TEMPLATE = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "null": None, "undefined": None}


class LiteralError(ValueError):
    """What is wrong, and where."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(message)
        self.position = position


def _unescape(body: str) -> str:
    def one(m: re.Match[str]) -> str:
        for g in (1, 2, 3):
            if m.group(g) is not None:
                return chr(int(m.group(g), 16))
        return _PLAIN.get(m.group(4), m.group(4))

    return _ESCAPE.sub(one, body) if "\\" in body else body


def _untemplate(body: str, at: int) -> str:
    out = []
    for m in re.finditer(r"\\(.)|\$\{|[^\\$]+|\$", body, re.DOTALL):
        if m.group(1) is not None:
            out.append(_IN_TEMPLATE.get(m.group(1), m.group(1)))
        elif m.group(0) == "${":
            raise LiteralError("interpolation is not supported", at + m.start())
        else:
            out.append(m.group(0))
    return "".join(out)


def _scalar(src: str, at: int) -> tuple[object, int]:
    """A string, number or word at ``at``, and where it ends."""
    first = src[at : at + 1]
    if first in ('"', "'"):
        if m := _STRING.match(src, at):
            return jsstr.text_of(_unescape(m.group(2))), m.end()
        raise LiteralError("unterminated string", at)
    if first == "`":
        if m := _TEMPLATE.match(src, at):
            return _untemplate(m.group(1), at + 1), m.end()
        if "${" in src[at:]:
            raise LiteralError("interpolation is not supported", src.index("${", at))
        raise LiteralError("unterminated template", at)
    if first and first in "+-0123456789":
        m = _NUMBER.match(src, at)
        body = m.group(0)
        try:
            value = float(int(body, 16)) if "x" in body.lower() else float(body)
        except ValueError:
            raise LiteralError("invalid number", at) from None
        if not math.isfinite(value):
            raise LiteralError("invalid number", at)
        return (int(value) if value.is_integer() and abs(value) < 2**53 else value), m.end()
    if m := _NAME.match(src, at):
        if m.group(0) in _WORDS:
            return _WORDS[m.group(0)], m.end()
        raise LiteralError(f"unsupported identifier {m.group(0)}", at)
    if not first:
        raise LiteralError("unexpected end of input", at)
    raise LiteralError(f"unexpected character {first}", at)


def _key(src: str, at: int) -> tuple[str, int]:
    if src.startswith("[", at):
        raise LiteralError("computed keys are not supported", at)
    if src[at : at + 1] in ('"', "'"):
        key, at = _scalar(src, at)
    elif m := _NAME.match(src, at):
        key, at = m.group(0), m.end()
    else:
        raise LiteralError("expected a key", at)
    at = _SKIP.match(src, at).end()
    if not src.startswith(":", at):
        raise LiteralError("expected a colon", at)
    return key, at + 1


def value_at(src: str, at: int) -> tuple[object, int]:
    """The literal at ``at``, and where it ends; code after it is not looked at."""
    open_: list[tuple[object, str | None]] = []  # containers, and the key being filled
    while True:
        at = _SKIP.match(src, at).end()
        if open_:
            container = open_[-1][0]
            if src.startswith("]" if isinstance(container, list) else "}", at):
                value, at = open_.pop()[0], at + 1
                done = True
            else:
                if src.startswith("...", at):
                    raise LiteralError("spread is not supported", at)
                if isinstance(container, dict):
                    key, at = _key(src, at)
                    open_[-1] = (container, key)
                    at = _SKIP.match(src, at).end()
                done = False
        else:
            done = False
        if not done:
            if src[at : at + 1] in ("[", "{"):
                open_.append(([] if src[at] == "[" else {}, None))
                at += 1
                continue
            value, at = _scalar(src, at)
        # Put a finished value into what holds it.
        while True:
            if not open_:
                return value, at
            container, key = open_[-1]
            if isinstance(container, list):
                container.append(value)
            else:
                container[key] = value
            at = _SKIP.match(src, at).end()
            close = "]" if isinstance(container, list) else "}"
            if src.startswith(",", at):
                at += 1
                break
            if not src.startswith(close, at):
                raise LiteralError(f"expected , or {close}", at)
            value, at = open_.pop()[0], at + 1


def export(source: str, name: str) -> object:
    """The value of ``export const|let|var name = literal``."""
    found = re.search(
        rf"(?:^|\n){jsstr.WS}*export{jsstr.WS}+(?:const|let|var){jsstr.WS}+{re.escape(name)}{jsstr.WS}*={jsstr.WS}*",
        source,
    )
    if not found:
        raise LiteralError(f"no export named {name}", 0)
    return value_at(source, found.end())[0]


def export_json(source: str, name: str) -> tuple[str | None, str | None, int | None]:
    """``(json, error, position)``: one of json and error is null."""
    try:
        return json.dumps(export(source, name), ensure_ascii=False, allow_nan=False), None, None
    except LiteralError as error:
        return None, str(error), error.position
