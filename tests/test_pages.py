"""Pages as nodes against trees of objects: structure, selectors, clean-up and markdown."""

import random
import re
from html.parser import HTMLParser

import pytest

from gleaner.functions import dom as T
from gleaner.operators import dom as O


class Node:
    def __init__(self, name, parent, attributes=None, text=None):
        self.name, self.parent, self.attributes, self.text, self.children = name, parent, attributes or {}, text, []
        if parent:
            parent.children.append(self)

    def walk(self):
        yield self
        for c in list(self.children):
            yield from c.walk()

    def elements(self):
        return [c for c in self.children if c.name != "#text"]

    def ancestors(self):
        return [self.parent, *self.parent.ancestors()] if self.parent.parent else []

    def attached(self, root):
        return self is root or (self.parent and self in self.parent.children and self.parent.attached(root))


class Builder(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", None)
        self.feed(html)
        self.close()

    def end(self, names, scope):
        at, found = self.now, None
        while at.parent:
            if at.name in names:
                found = at
            elif at.name in scope:
                break
            at = at.parent
        if found:
            self.now = found.parent

    def handle_starttag(self, name, attributes):
        if name in T.END_P:
            self.end(("p",), T.SCOPE)
        if name in T.ENDS:
            self.end(*T.ENDS[name])
        if name == "tr" and self.now.name == "table":
            self.now = Node("tbody", self.now)
        new = Node(name, self.now, {k: v or "" for k, v in reversed(attributes)})
        if name not in T.VOID:
            self.now = new

    def handle_endtag(self, name):
        at = self.now
        while at.parent:
            if at.name == name:
                self.now = at.parent
                return
            if at.name in ("td", "th", "caption", "table") and name not in ("table", "tr", "td", "th"):
                return
            if at.name == "table":
                return
            at = at.parent

    def handle_data(self, data):
        Node("#text", self.now, None, data)


def soup(rnd):
    """Tags as they come, some never closed, some closed in the wrong place."""
    out, open_ = [], []
    for _ in range(rnd.randint(1, 45)):
        kind = rnd.random()
        if kind < 0.45:
            name = rnd.choice(["div", "p", "ul", "ol", "li", "b", "i", "a", "span", "blockquote", "h2", "table", "tr", "td", "section", "code", "pre"])
            extra = rnd.choice(["", "", ' class="x"', ' class="y main"', ' id="k"', " role=x", ' href="/u"'])
            out.append(f"<{name}{extra}>")
            open_.append(name)
        elif kind < 0.7 and open_:
            out.append(f"</{open_.pop(rnd.choice([-1, -1, -1, rnd.randrange(len(open_))]))}>")
        elif kind < 0.8:
            out.append(rnd.choice(["<br>", "<br>", "<hr>", '<img src="s" alt="t">', "<br/>"]))
        else:
            out.append(rnd.choice(["word ", " two words ", " ", "\n", "&amp;", "​", "x"]))
            out.append("")
    return re.sub(r"(?<=[\w\s;​])<!---->", "", "".join(out))


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(31)
    return [(i, soup(rnd)) for i in range(250)]


@pytest.fixture(scope="module")
def table(spark, pages):
    nodes = O.nodes(spark.createDataFrame(pages, "id long, html string").repartition(3), "id", "html").persist()
    yield nodes
    nodes.unpersist()


def numbered(html):
    return {i: n for i, n in enumerate(list(Builder(html).root.walk())[1:])}


def test_tree(table, pages):
    got = {}
    for r in table.collect():
        got.setdefault(r.key, {})[r.node] = r
    for key, html in pages:
        want = numbered(html)
        number = {id(n): i for i, n in want.items()}
        rows = got.get(key, {})
        assert {i: (r.name, r.parent, r.last, r.depth, r.names[::-1], r.text, r.place, r.of_type) for i, r in rows.items()} == {
            i: (n.name, number.get(id(n.parent), -1), max(number[id(x)] for x in n.walk()), len(n.ancestors()), [a.name for a in n.ancestors()], n.text, *((n.parent.elements().index(n) + 1, [x for x in n.parent.elements() if x.name == n.name].index(n) + 1) if n.name != "#text" else (None, None)))
            for i, n in want.items()
        }
        for r in rows.values():  # an element's own HTML parses to the same element
            assert r.first <= r.inner_first <= r.inner_last <= r.end
            if r.name not in ("#text", "tr", "td", "tbody", "li") and html[r.first :].startswith("<"):
                assert T.tree(html[r.first : r.end])[0][4] == r.name and len(T.tree(html[r.first : r.end])) == r.last - r.node + 1


SELECTORS = {
    "div p": lambda n: n.name == "p" and any(a.name == "div" for a in n.ancestors()),
    "ul > li": lambda n: n.name == "li" and n.parent.name == "ul",
    "p + p, b": lambda n: n.name == "b" or n.name == "p" and (e := n.parent.elements()).index(n) > 0 and e[e.index(n) - 1].name == "p",
    "div ~ .x": lambda n: "x" in n.attributes.get("class", "").split() and any(x.name == "div" for x in n.parent.elements()[: n.parent.elements().index(n)]),
    "div > span *": lambda n: any(a.name == "span" and a.parent.name == "div" for a in n.ancestors()),
    "[class*='ma'] *": lambda n: any("ma" in a.attributes.get("class", "") for a in n.ancestors()),
    "li:nth-child(2n+1)": lambda n: n.name == "li" and n.parent.elements().index(n) % 2 == 0,
    "p:last-of-type:not(#k)": lambda n: n.name == "p" and n.attributes.get("id") != "k" and [x for x in n.parent.elements() if x.name == "p"][-1] is n,
    "div div": lambda n: n.name == "div" and any(a.name == "div" for a in n.ancestors()),
}


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors(table, pages, selector):
    want = [(k, i) for k, html in pages for i, n in numbered(html).items() if n.name != "#text" and SELECTORS[selector](n)]
    assert sorted((r.key, r.node) for r in O.select(table, selector).collect()) == want and want


@pytest.mark.parametrize("selector", ["", ">", "p >", "> p", "p:unknown", "p:nth-child(x)", "p[", "p..x"])
def test_what_is_no_selector(table, selector):
    with pytest.raises(ValueError):
        O.select(table, selector)


def has_content(n):
    return any((x.text or "").strip() or x.name in O.MEANINGFUL for x in n.walk())


def structural(n):
    classes = n.attributes.get("class", "").lower()
    return bool(n.attributes.get("id")) or "role" in n.attributes or any(s in classes for s in O.STRUCTURAL)


def plain_clean(root):
    """The steps on a tree that changes, list items until nothing is removed any more."""
    items = quotes = others = 0
    every = lambda *names: [n for n in root.walk() if n.name in names]
    empty = lambda n: not has_content(n)

    def remove(n):
        n.parent.children.remove(n)

    while found := [n for n in every("li") if empty(n)]:
        for n in found:
            remove(n)
            items += 1
    for n in [n for n in every("ul", "ol") if not n.elements()]:
        remove(n)
        others += 1
    for q in every("blockquote"):
        for n in [n for n in q.elements() if empty(n)]:
            remove(n)
            quotes += 1
    for n in [n for n in every("blockquote") if empty(n)]:
        remove(n)
        others += 1
    for name in ("p", "div", "span", "section", "article"):
        for n in [n for n in every(name) if empty(n) and not structural(n)]:
            remove(n)
            others += 1
    for parent in list(root.walk()):
        run = 0
        for n in list(parent.children):
            if n.name == "br":
                run += 1
                if run > 2:
                    remove(n)
            elif n.name != "#text" or n.text.strip():
                run = 0
    for n in [n for n in root.walk() if n.parent and n.parent.parent and n.name not in ("#text", "br", "hr", "img", "input", "meta", "link") and not n.elements() and not structural(n) and re.fullmatch("[\\s ​‌‍﻿]*", "".join(c.text for c in n.children))]:
        remove(n)
        others += 1
    return items, quotes, others


def test_clean_up(spark, table, pages):
    kept = {}
    for r in O.clean_up(table).filter("goes is null").collect():
        kept.setdefault(r.key, set()).add(r.node)
    counts = {r.id: (r.empty_items, r.empty_quote_children, r.empty_elements) for r in O.cleaned(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()}
    for key, html in pages:
        nodes = numbered(html)
        root = Builder(html).root
        order = {id(n): i for i, n in enumerate(list(root.walk())[1:])}
        got = plain_clean(root)
        left = {order[id(n)] for n in list(root.walk())[1:]}
        assert kept.get(key, set()) == left, html
        assert counts[key] == got, html
        assert len(nodes) == len(order)


def test_clean_up_shuffles_nodes_once_and_no_text(spark):
    """Nodes are made once and shuffled by page as numbers and flags; the page itself meets its cuts once."""
    df = spark.createDataFrame([(1, "<ul><li> </li></ul><p class='a'>x<b></b></p>"), (2, None), (None, "<blockquote><p></p>y</blockquote><br><br><br>"), (3, "z")], "id long, html string")
    found = O.cleaned(df, "id", "html")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 3 and "Broadcast" not in plan
    exchanged = re.findall(r"Exchange hashpartitioning\(key#.*\n.*Project \[(.*)\]", plan)
    assert exchanged and not re.search(r"\b(text|attributes|names)#\d+(,|$)", exchanged[-1])
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    assert got == {1: ("<p class='a'>x</p>", 1, 0, 2), 2: (None, 0, 0, 0), None: ("<blockquote>y</blockquote><br><br>", 0, 1, 0), 3: ("z", 0, 0, 0)}


def plain_markdown(html):
    blocks, current = [], []  # a block: head node, signs

    def start(node):
        current.clear()
        current.extend([node, []])
        blocks.append((node, current[1]))

    def put(node, text):
        if not current:
            start(node)
        current[1].append(text)

    def visit(node):
        if node.name in O._SKIPPED:
            return
        block = node.name in T.BLOCKS
        if block or not current:
            start(node)
        inside_pre = any(a.name == "pre" for a in node.ancestors())
        if node.name == "#text":
            put(node, node.text if inside_pre else re.sub("[\\s ]+", " ", node.text))
        around = not block and any(x.name in T.BLOCKS for x in node.walk())
        mark = "" if around else {"b": "**", "i": "*", "code": "" if inside_pre else "`"}.get(node.name, "")
        link = not around and node.name == "a" and node.attributes.get("href")
        put(node, {"br": "\n", "hr": "---", "table": "\x03"}.get(node.name, "[" if link else mark))
        if node.name == "img":
            put(node, f"![{node.attributes['alt']}]({node.attributes['src']})")
        if node.name != "table":
            for c in node.children:
                visit(c)
        if mark or link:
            put(node, f"]({node.attributes['href']})" if link else mark)
        if block:
            current.clear()

    for n in Builder(html).root.children:
        visit(n)
    return blocks


def test_markdown(spark, table, pages):
    """Lines and their marks, for pages without tables, whose text is tested by itself."""
    some = [(k, h) for k, h in pages if "<table" not in h and "<tr" not in h and "<td" not in h]
    got = {r.key: r.markdown for r in O.markdown(table, spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()}
    checked = 0
    for key, html in some:
        out, seen = [], set()
        for head, signs in plain_markdown(html):
            line = "".join(signs)
            path = [head.name, *(a.name for a in head.ancestors())][::-1]
            if "pre" in path:
                line = re.sub(r"^\n|\s+\Z", "", line)
            else:
                line = re.sub(" *\n *", "\n", line)
                line = re.sub(r"(\*\*|\[) +(?=\S)", r"\1", re.sub(r"^\s+|\s+\Z", "", line))
            if not line or re.fullmatch(r"(\*|`|\s)+", line):
                continue
            li = next((a for a in [head, *head.ancestors()] if a.name == "li"), None)
            level, quotes = sum(n in ("ul", "ol", "menu") for n in path), path.count("blockquote")
            first = li is not None and id(li) not in seen
            lead = ""
            if li is not None:
                place = [x for x in li.parent.elements() if x.name == "li"].index(li) + 1
                lead = "  " * max(level - 1, 0) + (f"{place}. " if li.parent.name == "ol" else "* ") if first else "  " * level
                seen.add(id(li))
            heading = next((n for n in path if re.fullmatch("h[1-6]", n)), None)
            if "pre" in path:
                line = f"```\n{line}\n```"
            elif heading:
                line = "#" * int(heading[1]) + " " + line.replace("\n", " ")
            line = "> " * quotes + lead + line.replace("\n", "\n" + "> " * quotes + " " * len(lead))
            if not out:
                glue = ""
            elif first and out[-1][1]:
                glue = "\n"
            else:
                glue = "\n" + ">" * quotes + "\n" if quotes and out[-1][2] >= quotes else "\n\n"
            out.append((glue + line, li is not None, quotes))
        assert got.get(key, "") == "".join(o[0] for o in out), html
        checked += bool(out)
    assert checked > 40


FIXTURE = """<html><head><title>T</title><style>p{}</style></head><body><div class="ad"><div class=in>inner <b>bold</b></div>tail</div><h1>Head <i>it</i></h1>
<p>One<p>Two <a href="/x">li<b>n</b>k</a> <img src=a.png alt="pic"><br>next</p><ul><li>a<li>b<ol><li>c</li><li>d<p>para</p></li></ol></li></ul>
<blockquote><p>q1</p><p>q2</p></blockquote><pre>  x
   y</pre><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2<b>z</b></td></tr></table><hr><p>end</p></body></html>"""


def test_fixture(spark):
    df = spark.createDataFrame([(1, FIXTURE), (2, None), (3, ""), (None, "<p>no id</p>")], "id long, html string")
    got = {r.key: r.markdown for r in O.markdown(O.nodes(df, "id", "html"), df, "id", "html").collect()}
    assert got == {
        None: "no id",
        1: "inner **bold**\n\ntail\n\n# Head *it*\n\nOne\n\nTwo [li**n**k](/x) ![pic](a.png)\nnext\n\n* a\n* b\n  1. c\n  2. d\n\n    para\n\n> q1\n>\n> q2\n\n```\n  x\n   y\n```\n\n| h | k |\n| --- | --- |\n| 1 | 2 z |\n\n---\n\nend",
    }
    new = {r.id: r.html for r in O.replace_elements(df, "id", "html", {"div.ad": "[ad]", "li": None, "table > tr": "row"}).collect()}
    assert new[1].startswith("<html><head><title>T</title><style>p{}</style></head><body><span>[ad]</span><h1>") and "<ul></ul>" in new[1]
    assert "<table><span>row</span><span>row</span></table>" in new[1] and new[2] is None and new[3] == "" and new[None] == "<p>no id</p>"


def test_markdown_shuffles_nodes_once(spark):
    """One shuffle by page and no join; tables' texts come from pages that have tables, within items and quotes too."""
    table = "<TABLE><tr><th>h</th></tr><tr><td>1</td></tr></TABLE>"
    df = spark.createDataFrame([(1, f"<ul><li>a<ul><li>b{table}c</li></ul>d</li></ul>"), (None, f"<blockquote>q{table}</blockquote>"), (2, "<table></table>"), (3, "<b>x</b>z")], "id long, html string")
    found = O.markdown(O.nodes(df, "id", "html"), df, "id", "html")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    got = {r.key: r.markdown for r in found.collect()}
    assert got == {1: "* a\n  * b\n\n    | h |\n    | --- |\n    | 1 |\n\n    c\n\n  d", None: "> q\n>\n> | h |\n> | --- |\n> | 1 |", 3: "**x**z"}
