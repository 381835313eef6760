"""Front matter: the simple key and value lines at the head of a markdown file."""

from __future__ import annotations

import json
import re

from quillspark.kernels import jsstr

_HEAD = re.compile(r"---\r?\n(.*?)\r?\n---\r?\n?", re.DOTALL)
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?\Z")


def scalar(raw: str) -> object:
    """A value as it is meant: empty, boolean, number, quoted or plain text."""
    if raw in ("true", "false"):
        return raw == "true"
    if _NUMBER.match(raw):
        number = float(raw)
        return int(number) if number.is_integer() else number
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    return raw


def parse(block: str) -> dict[str, object]:
    """Keys and values; comments, blank lines and lines without a colon are skipped."""
    lines = (jsstr.trim(x) for x in block.split("\n"))
    pairs = (x.split(":", 1) for x in lines if x and x[0] != "#" and ":" in x)
    return {jsstr.trim(k): scalar(jsstr.trim(v)) for k, v in pairs}


def split(text: str) -> tuple[dict[str, object], str]:
    """Front matter and body."""
    m = _HEAD.match(text)
    return (parse(m.group(1)), text[m.end() :]) if m else ({}, text)


def as_json(text: str) -> str:
    """The front matter of a text as a JSON object."""
    return json.dumps(split(text)[0], ensure_ascii=False)
