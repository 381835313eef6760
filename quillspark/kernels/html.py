"""HTML to markdown: a lenient reader and a renderer, both without recursion.

The reader is one regular expression over the input and a stack of open
elements; it stores nodes in flat lists.  The renderer walks the chosen subtree
once with its own stack: every element opens a buffer, and closing it hands the
finished piece to the buffer of its parent.  Depth is therefore limited by
memory only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quillspark.kernels import jsstr

# Fixed values.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
DROPPED = {
    "script", "style", "nav", "footer", "aside", "header", "form", "iframe", "noscript", "svg", "button", "select",
    "textarea",
}
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…", "copy": "©", "reg": "®", "trade": "™",
    "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’",
}

_PIECE = re.compile(
    r"(?P<text>[^<]+)"
    r"|<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[^>]*)(?P<closed>>|\Z)"
    r"|<(?P<open>[^<>]*)>"
    r"|(?P<stray><)",
    re.DOTALL,
)
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);")
# Fixed value: what an attribute looks like.
_ATTR = re.compile(
    rf"""([a-zA-Z_:][A-Za-z0-9_:.\-]*){jsstr.WS}*={jsstr.WS}*(?:"([^"]*)"|'([^']*)'|([^{re.escape(jsstr.WS_CHARS)}>]+))"""
)
_SPACE = re.compile(jsstr.WS)
_LANGUAGE = re.compile(r"language-([a-zA-Z0-9_-]+)")
_HEADING = re.compile(r"h[1-6]\Z")


def decode(text: str, names: dict[str, str] = NAMED, fold: bool = True) -> str:
    """Entities decoded; unknown ones stay as they are."""

    def one(m: re.Match[str]) -> str:
        body = m.group(1)
        if body[0] != "#":
            return names.get(body.lower() if fold else body, m.group(0))
        digits, base = (body[2:], 16) if body[1] in "xX" else (body[1:], 10)
        found = re.match(r"[0-9a-fA-F]+" if base == 16 else r"[0-9]+", digits)
        point = int(found.group(0), base) if found else -1
        return chr(point) if 0 <= point < 0x110000 else m.group(0)

    return _ENTITY.sub(one, text) if "&" in text else text


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag; those without a value are left out, the last of a name counts."""
    return {
        m.group(1).lower(): decode(next((g for g in m.groups()[1:] if g is not None), ""))
        for m in _ATTR.finditer(raw)
    }


@dataclass
class Tree:
    """Nodes by number; node 0 is the root.  A text node has no name."""

    names: list[str | None] = field(default_factory=lambda: ["#root"])
    texts: list[str] = field(default_factory=lambda: [""])
    attrs: list[dict[str, str]] = field(default_factory=lambda: [{}])
    children: list[list[int]] = field(default_factory=lambda: [[]])

    def add(self, parent: int, name: str | None, text: str, attrs: dict[str, str]) -> int:
        self.names.append(name)
        self.texts.append(text)
        self.attrs.append(attrs)
        self.children.append([])
        self.children[parent].append(len(self.names) - 1)
        return len(self.names) - 1


def read(html: str) -> Tree:
    """The tree of a page, whatever its faults."""
    tree, path, at = Tree(), [0], 0
    lowered: str | None = None
    while at < len(html):
        m = _PIECE.match(html, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "closed":
            if not m.group("closed"):
                break
            name = jsstr.trim(m.group("close")).lower()
            for depth in range(len(path) - 1, 0, -1):
                if tree.names[path[depth]] == name:
                    del path[depth:]
                    break
        elif kind == "open":
            body = m.group("open")
            alone = body.endswith("/")
            body = body[:-1] if alone else body
            gap = _SPACE.search(body)
            name = (body[: gap.start()] if gap else body).lower()
            node = tree.add(path[-1], name, "", attributes(body[gap.start() :]) if gap else {})
            if alone or name in VOID:
                continue
            path.append(node)
            if name in ("script", "style"):
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find(f"</{name}", at)
                at = len(html) if end < 0 else end
        elif kind == "text":
            tree.add(path[-1], None, decode(m.group("text")), {})
        elif kind == "cdata":
            if m.group("cdata"):
                tree.add(path[-1], None, m.group("cdata"), {})
        elif kind == "stray":
            tree.add(path[-1], None, "<", {})
    return tree


def prose(tree: Tree) -> int:
    """The first article, else main, else body, else the root, in document order."""
    best = {"article": 0, "main": 0, "body": 0}
    todo = list(reversed(tree.children[0]))
    while todo:
        n = todo.pop()
        if not best.get(tree.names[n] or "", 1):
            best[tree.names[n]] = n
        todo.extend(reversed(tree.children[n]))
    return next((n for n in best.values() if n), 0)


def _wrapped(mark: str):
    return lambda inner, *_: f"{mark}{jsstr.trim(inner)}{mark}" if jsstr.trim(inner) else ""


def _link(inner: str, attrs: dict[str, str], *_) -> str:
    inner, href = jsstr.trim(inner), attrs.get("href", "")
    return f"[{inner}]({href})" if inner and href else inner


def _image(_inner: str, attrs: dict[str, str], *_) -> str:
    return f"[{attrs.get('alt') or 'image'}]({attrs['src']})" if attrs.get("src") else ""


def _fence(inner: str, _attrs, language: str, *_) -> str:
    return f"\n\n```{language}\n" + inner.rstrip("\n") + "\n```\n\n"


def _quote(inner: str, *_) -> str:
    return "\n\n" + "\n".join("> " + line for line in jsstr.trim(inner).split("\n")) + "\n\n"


_RULES = {
    "p": lambda inner, *_: f"\n\n{jsstr.trim(inner)}\n\n" if jsstr.trim(inner) else "",
    "br": lambda *_: "  \n",
    "hr": lambda *_: "\n\n---\n\n",
    "a": _link,
    "img": _image,
    "strong": _wrapped("**"),
    "b": _wrapped("**"),
    "em": _wrapped("*"),
    "i": _wrapped("*"),
    "pre": _fence,
    "blockquote": _quote,
}


def render(tree: Tree, top: int) -> str:
    """The children of ``top`` as markdown, before tidying."""
    out: list[str] = []
    # A frame: node, its next child, its finished pieces, depth of lists,
    # white space kept, inside pre, and the parent's buffer.
    frames = [[top, 0, out, 0, False, False]]
    while frames:
        frame = frames[-1]
        node, nth, buffer, depth, keep, pre = frame
        kids = tree.children[node]
        name = tree.names[node]
        if nth < len(kids):
            frame[1] += 1
            kid = kids[nth]
            kind = tree.names[kid]
            listing = node != top and name in ("ul", "ol")
            if kind is None:
                if not listing:
                    text = tree.texts[kid]
                    buffer.append(text if keep else jsstr.WS_RUN.sub(" ", text))
            elif listing and kind != "li":
                continue
            elif kind not in DROPPED:
                deeper = depth + 1 if listing else depth
                kept = keep or kind == "pre" or (kind == "code" and not pre)
                frames.append([kid, 0, [], deeper, kept, pre or kind == "pre"])
            continue
        frames.pop()
        if not frames:
            break
        parent = frames[-1]
        above = tree.names[parent[0]] if parent[0] != top else None
        if name in ("ul", "ol"):
            piece = "\n\n" + "\n".join(buffer) + "\n\n"
        else:
            inner = "".join(buffer)
            if name == "li" and above in ("ul", "ol"):
                bullet = f"{len(parent[2]) + 1}." if above == "ol" else "-"
                piece = f"{'  ' * (depth - 1)}{bullet} {jsstr.trim(inner)}"
            elif name == "code" and not pre:
                piece = "`" + inner.replace("`", "\\`") + "`"
            elif _HEADING.match(name):
                piece = f"\n\n{'#' * int(name[1])} {jsstr.trim(inner)}\n\n"
            else:
                language = _code_language(tree, node) if name == "pre" else ""
                rule = _RULES.get(name)
                piece = rule(inner, tree.attrs[node], language) if rule else inner
        parent[2].append(piece)
    return "".join(out)


def _code_language(tree: Tree, pre: int) -> str:
    code = next((k for k in tree.children[pre] if tree.names[k] == "code"), None)
    found = _LANGUAGE.search(tree.attrs[code].get("class", "")) if code is not None else None
    return found.group(1) if found else ""


def tidy(markdown: str) -> str:
    """No trailing blanks, no more than one empty line, trimmed."""
    markdown = markdown.replace("\u00a0", " ")
    markdown = re.sub(r"[ \t]+\n", "\n", markdown)
    return jsstr.trim(re.sub(r"\n{3,}", "\n\n", markdown))


def to_markdown(html: str, limit: int | None = None) -> tuple[str, bool, int]:
    """``(markdown, truncated, length)``; the limit cuts the output, in UTF-16 units."""
    tree = read(html)
    markdown = tidy(render(tree, prose(tree)))
    size = jsstr.length(markdown)
    if limit is None or size <= limit:
        return markdown, False, size
    return jsstr.head(markdown, limit), True, limit
