"""The tags of a page, folded into a tree with a stack of open elements. Everything that is asked of the
tree afterwards is a DataFrame operation on its nodes (gleaner.operators.dom)."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

#: Fixed values of HTML: elements without content, with text alone, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Fixed values of HTML: what an opening tag ends, and the elements beyond which it doesn't look.
_ROWS, _CELLS = ("thead", "tbody", "tfoot"), ("td", "th")
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "body": (("head",), ("html",))}
ENDS |= {"tr": (("tr", *_CELLS), ("table", *_ROWS)), **{c: (_CELLS, ("tr", "table")) for c in _CELLS}, **{g: ((*_ROWS, "tr", *_CELLS), ("table",)) for g in _ROWS}}
END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPE = ("td", "th", "caption", "table", "html", "button", "object")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW if name not in ("noscript", "svg")}

SCHEMA = (
    "node int, parent int, last int, depth int, name string, names array<string>, attributes map<string,string>, first int, inner_first int, inner_last int, end int, "
    "place int, siblings int, of_type int, same_type int, text string"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def tree(html: str | None) -> list[list]:
    """The nodes of a page in document order, as rows of SCHEMA: elements, and text that isn't empty as
    ``#text``. node counts from 0, last is the node's last descendant (or itself), parent -1 is the page,
    names are its ancestors'. first, inner_first, inner_last and end are places in the page: the element,
    and what is between its tags. place counts elements among their siblings from 1, of_type those of one
    name. Open elements end with their parent; a closing tag without an open element is passed over; a
    table's row gets a table body if it is in none. Null is an empty page."""
    html = html or ""
    rows: list[list] = []
    open_: list[list] = []  # rows of open elements

    def add(name: str, first: int, inner: int, attributes: dict | None, text: str | None) -> list:
        parent = open_[-1] if open_ else None
        names = [*parent[5], parent[4]] if parent else []
        row = [len(rows), parent[0] if parent else -1, len(rows), len(open_), name, names, attributes, first, inner, inner, inner, None, None, None, None, text]
        rows.append(row)
        return row

    def close(depth: int, inner_last: int, end: int) -> None:
        """Ends the elements from a depth on; only the outermost one has a closing tag."""
        for row in open_[depth:]:
            row[2], row[9], row[10] = len(rows) - 1, inner_last, inner_last
        if len(open_) > depth:
            open_[depth][10] = end
            del open_[depth:]

    def ended(names: tuple[str, ...], scope: tuple[str, ...]) -> int | None:
        """Depth of the outermost open element of these names within the scope."""
        found = None
        for depth in range(len(open_) - 1, -1, -1):
            if open_[depth][4] in names:
                found = depth
            elif open_[depth][4] in scope:
                break
        return found

    at = 0
    while at <= len(html):
        tag = _TOKEN.search(html, at)
        begin = tag.start() if tag else len(html)
        if begin > at:
            add("#text", at, begin, None, entities.unescape(html[at:begin]))[10] = begin
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            scope = SCOPE[:4] if name not in ("table", "body", "html", "tr", *_ROWS, *_CELLS) else ("table",) if name != "table" else ()
            depth = next((d for d in range(len(open_) - 1, -1, -1) if open_[d][4] == name or (open_[d][4] in scope and d < len(open_))), None)
            if depth is not None and open_[depth][4] == name:
                close(depth, begin, at)
            continue
        if name in END_P and (depth := ended(("p",), SCOPE)) is not None:
            close(depth, begin, begin)
        if name in ENDS and (depth := ended(*ENDS[name])) is not None:
            close(depth, begin, begin)
        if name == "tr" and open_ and open_[-1][4] == "table":
            open_.append(add("tbody", begin, begin, {}, None))
        attributes = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in reversed(_ATTRIBUTE.findall(tag[3]))}
        row = add(name, begin, at, attributes, None)
        if name in VOID or tag[3].endswith("/") and name not in BLOCKS and name not in RAW:
            row[9] = row[10] = at
        elif name in _RAW_END:
            stop = _RAW_END[name].search(html, at)
            inner_last, at = (stop.start(), stop.end()) if stop else (len(html), len(html))
            open_.append(row)
            if name in ("title", "textarea") and inner_last > row[8]:
                add("#text", row[8], inner_last, None, entities.unescape(html[row[8] : inner_last]))[10] = inner_last
            close(len(open_) - 1, inner_last, at)
        else:
            open_.append(row)
    close(0, len(html), len(html))
    total, typed = Counter(), Counter()
    for row in rows:
        if row[4] != "#text":
            total[row[1]] += 1
            typed[row[1], row[4]] += 1
            row[11], row[13] = total[row[1]], typed[row[1], row[4]]
    for row in rows:
        if row[4] != "#text":
            row[12], row[14] = total[row[1]], typed[row[1], row[4]]
    return rows
