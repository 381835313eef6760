"""Overlapping chunks of markdown, in the published way and in a clean one.

``compat`` follows the published boundary rules exactly, stall included: after
a cut closer than the overlap the next chunks advance one character at a time.
``clean`` accepts a cut only beyond the previous end plus the overlap, so ends
strictly increase and chunks stay few.  Offsets count UTF-16 units; headings
are found once per document and looked up by bisection.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from quillspark.kernels import jsstr

CHARS_PER_TOKEN = 4
CHUNK_SIZE = 800
OVERLAP = 100

_FENCE_LINE = re.compile(r"(?:^|(?<=\n))(```|~~~)[^\n]*")
_HEADING = re.compile(rf"(?:^|(?<=\n))#{{1,6}}{jsstr.WS}+(?!{jsstr.WS})")
_TITLE = re.compile(rf"(?m)^(#{{1,6}}){jsstr.WS}+([^\n\r\u2028\u2029]+?){jsstr.WS}*$")
_SENTENCE = re.compile(rf"[.!?]{jsstr.WS}+(?=[A-Za-z0-9_])")


@dataclass(frozen=True)
class Chunk:
    """A chunk and where it came from (``start`` and ``end`` in units)."""

    id: str
    ordinal: int
    text: str
    token_count: int
    heading_path: list[str]
    start: int
    end: int


def token_count(text: str) -> int:
    """A quarter of the length in units, rounded up."""
    return -(-jsstr.length(text) // CHARS_PER_TOKEN)


def mask_fences(text: str) -> str:
    """Lines inside fences become blanks of the same length."""
    out, at, fence = [], 0, None
    for m in _FENCE_LINE.finditer(text):
        if fence is None:
            out.append(text[at : m.start()])
            out.append(m.group(0))
            fence, at = m.group(1), m.end()
        elif m.group(1) == fence:
            out.append(re.sub(r"[^\n]", " ", text[at : m.start()]))
            out.append(m.group(0))
            fence, at = None, m.end()
    rest = text[at:]
    out.append(rest if fence is None else re.sub(r"[^\n]", " ", rest))
    return "".join(out)


def heading_offsets(text: str) -> list[int]:
    """The start, and the start of every heading outside fences."""
    return sorted({0, *(m.start() for m in _HEADING.finditer(mask_fences(text)))})


class Outline:
    """The heading path at any offset, from one pass over the text."""

    def __init__(self, text: str) -> None:
        self.starts: list[int] = []
        self.paths: list[list[str]] = []
        stack: list[tuple[int, str]] = []
        for m in _TITLE.finditer(text):
            level = len(m.group(1))
            stack = [h for h in stack if h[0] < level]
            stack.append((level, f"{m.group(1)} {m.group(2)}"))
            self.starts.append(m.start())
            self.paths.append([title for _, title in stack])

    def at(self, offset: int) -> list[str]:
        """Headings that begin strictly before the offset."""
        n = bisect_left(self.starts, offset)
        return self.paths[n - 1] if n else []


def _compat_end(text: str, start: int, budget: int, headings: list[int]) -> int:
    limit = start + budget
    if limit >= len(text):
        return len(text)
    n = bisect_right(headings, limit)
    if n and headings[n - 1] > start:
        return headings[n - 1]
    blank = text.rfind("\n\n", 0, limit + 2)
    if blank > start:
        return blank + 2
    # The first sentence end of the window; one at its very start counts for nothing.
    m = _SENTENCE.search(text, start, limit)
    return m.end() if m and m.start() > start else limit


def _clean_end(text: str, start: int, budget: int, headings: list[int], beyond: int) -> int:
    limit = start + budget
    if limit >= len(text):
        return len(text)
    n = bisect_right(headings, limit)
    if n and headings[n - 1] > beyond:
        return headings[n - 1]
    blank = text.rfind("\n\n", beyond, limit)
    if blank >= 0 and beyond < blank + 2 <= limit:
        return blank + 2
    last = None
    for last in _SENTENCE.finditer(text, max(beyond, start), limit):
        pass
    return last.end() if last and last.end() > beyond else limit


def chunks(
    markdown: str, doc_id: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, mode: str = "clean"
) -> list[Chunk]:
    """The chunks of one document; sizes in tokens of four units."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    if mode not in ("clean", "compat"):
        raise ValueError("mode is clean or compat")
    text = jsstr.units(markdown)
    budget, back = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    headings = heading_offsets(text)
    outline = Outline(text if mode == "compat" else mask_fences(text))
    out: list[Chunk] = []
    start, previous = 0, -back
    while start < len(text) or not out:
        if mode == "compat":
            end = _compat_end(text, start, budget, headings)
        else:
            end = _clean_end(text, start, budget, headings, max(start, previous + back))
        body = jsstr.text_of(jsstr.trim(text[start:end]))
        digest = hashlib.sha256(f"{doc_id}|{len(out)}|{body}".encode("utf-8", "replace")).hexdigest()
        path = [jsstr.text_of(h) for h in outline.at(start)]
        out.append(Chunk(digest, len(out), body, token_count(body), path, start, end))
        if end >= len(text):
            break
        start, previous = max(end - back, start + 1), end
    return out
