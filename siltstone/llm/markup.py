"""A small forgiving HTML scanner shared by the operators that read pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of the HTML standard by how they are read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", decoded text, ""), ("open", tag, attribute source) and ("close", tag, "") in page
    order; comments, declarations and the contents of raw elements are left out."""
    at, n = 0, len(page)
    end_of_tags = page.rfind(">") + 1  # nothing after it is looked through for tags
    while at < n:
        m = TOKEN.search(page, at, max(at, end_of_tags))
        if m is None:
            yield "text", html.unescape(page[at:]), ""
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            yield "close", tag, ""


def one_spaced(text: str) -> str:
    return " ".join(text.split())
