"""XML as a node table, and selection over it.

A strict reader: one regular expression per piece, a stack of open nodes, and a
``ValueError`` for anything unterminated or mismatched.  Text after the root is
ignored; CDATA joins the text before entities are decoded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quillspark.kernels import html

# Fixed values.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

_PROLOG = re.compile(r"[ \t\r\n]+|<\?.*?\?>|<!--.*?-->|<!(?:DOCTYPE|doctype)[^>]*>", re.DOTALL)
_PIECE = re.compile(
    r"(?P<text>[^<]+)"
    r"|</(?P<close>[^>]*)>?"
    r"|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    r"|(?P<comment><!--.*?-->)"
    r"|<(?P<open>[^ \t\r\n/>]*)(?P<attrs>(?:[^>/]|/(?!>))*)(?P<alone>/?)>",
    re.DOTALL,
)
# Fixed value: what an attribute looks like.
_ATTR = re.compile(r"""([a-zA-Z_:][A-Za-z0-9_:.\-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_STEP = re.compile(r"([A-Za-z0-9_:*\-]+)(?:\[(\d+)\])?\Z")


@dataclass
class XmlNode:
    """A row of the node table; ``parent`` is -1 for the root."""

    node: int
    parent: int
    depth: int
    ord: int
    path: str
    name: str
    attrs: dict[str, str]
    text: str = ""
    children: list[int] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    """Attributes with a value, names in their case, entities decoded."""
    return {
        m.group(1): html.decode(next(g for g in m.groups()[1:] if g is not None), NAMED, fold=False)
        for m in _ATTR.finditer(raw)
    }


def nodes(xml: str) -> list[XmlNode]:
    """The nodes in document order; raises ``ValueError`` on faulty input."""
    at = 1 if xml.startswith("\ufeff") else 0
    while m := _PROLOG.match(xml, at):
        at = m.end()
    if xml.startswith(("<?", "<!"), at):
        raise ValueError("unterminated prolog")
    if not xml.startswith("<", at):
        raise ValueError("no root element")
    table: list[XmlNode] = []
    texts: list[list[str]] = []
    path: list[int] = []
    while True:
        m = _PIECE.match(xml, at)
        if not m:
            raise ValueError(f"unterminated piece at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            texts[path[-1]].append(m.group("text"))
        elif kind == "cdata":
            texts[path[-1]].append(m.group("cdata"))
        elif kind == "close":
            if not path or m.group("close").strip() != table[path[-1]].name:
                raise ValueError(f"mismatched close tag </{m.group('close').strip()}>")
            closed = path.pop()
            table[closed].text = html.decode("".join(texts[closed]), NAMED, fold=False)
        elif kind == "alone":
            if not m.group("open"):
                raise ValueError(f"empty tag name at {m.start()}")
            parent = path[-1] if path else -1
            above = table[parent] if path else None
            node = XmlNode(
                len(table), parent, len(path), len(above.children) if above else 0,
                f"{above.path if above else ''}/{m.group('open')}", m.group("open"), attributes(m.group("attrs")),
            )
            if above:
                above.children.append(node.node)
            table.append(node)
            texts.append([])
            if not m.group("alone"):
                path.append(node.node)
        if not path:
            return table
        if at >= len(xml):
            raise ValueError(f"unterminated element <{table[path[-1]].name}>")


def select(table: list[XmlNode], selector: str) -> list[XmlNode]:
    """Nodes that a selector names: ``/a/b``, ``//a``, ``*`` and ``[n]`` per parent.

    ``//`` looks at the children of every node, so it never yields the root.
    """
    anywhere = selector.startswith("//")
    steps = [s for s in selector.lstrip("/" if not anywhere else "").split("/") if s]
    if selector.startswith("///") or not steps:
        steps = [s for s in steps if s]
    if not steps:
        return table[:1]
    pool: list[list[XmlNode]] = [[table[0]]] if not anywhere else [
        [table[c] for c in n.children] for n in table
    ]
    for i, step in enumerate(steps):
        m = _STEP.match(step)
        if not m:
            return []
        if i:
            pool = [[table[c] for c in n.children] for group in pool for n in group]
        pool = [[n for n in group if m.group(1) in ("*", n.name)] for group in pool]
        if m.group(2) is not None:
            n = int(m.group(2))
            pool = [group[n - 1 : n] if n > 0 else [] for group in pool]
    return [n for group in pool for n in group]
