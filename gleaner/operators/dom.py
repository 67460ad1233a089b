"""Pages as tables of nodes: selectors, cutting, clean-up and markdown.

A page's nodes are numbered in document order and an element's descendants are the numbers after its
own up to ``last``. So these intervals nest: a node lies within some element of a set if, and only if,
the largest ``last`` among that set's earlier elements reaches it. One window over a page's nodes
answers that for all nodes at once, without a pair of nodes for each ancestor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleaner.functions import dom, html as H

STRUCTURAL = ("container", "wrapper", "main", "content", "body", "row", "col", "column", "grid", "flex")
MEANINGFUL = ("img", "svg", "video", "audio", "canvas", "iframe", "input", "textarea", "select", "button", "object", "embed")
BLANK = "^[\\s\\u00A0\\u200B\\u200C\\u200D\\uFEFF]*$"


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each node of each page: key and the columns of gleaner.functions.dom.SCHEMA."""
    schema = StructType([*pages.select(F.col(key).alias("key")).schema, *StructType.fromDDL(dom.SCHEMA)])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns: list[list] = [[] for _ in arrow]
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for row in dom.tree(text):
                        row[6] = None if row[6] is None else list(row[6].items())
                        for column, value in zip(columns, (k, *row)):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(fold, schema)


def _in_order() -> Window:
    return Window.partitionBy("key").orderBy("node")


def inside(flag: Column) -> Column:
    """Whether a node lies within an element for which the flag holds, itself not counted."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(before) >= F.col("node"), F.lit(False))


def _next(flag: Column, distance: int) -> Column:
    """The first node with the flag at this distance or later. From the end of the page on: Spark works a frame
    up to the end out anew for each row."""
    after = Window.partitionBy("key").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -distance)
    return F.min(F.when(flag, F.col("node"))).over(after)


def contains(flag: Column) -> Column:
    """Whether a node, or one within it, has the flag."""
    return F.coalesce(_next(flag, 0) <= F.col("last"), F.lit(False))


# -- selectors
_SIMPLE = re.compile(r"""\*|[a-zA-Z][\w-]*|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([\^$*~|]?=)["']?([^"'\]]*)["']?)?\]|:([a-z-]+)(?:\(([^)]*)\))?""")
_POSITIONS = {"first-child": "place = 1", "last-child": "place = siblings", "only-child": "siblings = 1", "first-of-type": "of_type = 1", "last-of-type": "of_type = same_type", "only-of-type": "same_type = 1", "root": "parent = -1"}


def _nth(column: str, argument: str) -> Column:
    argument = {"odd": "2n+1", "even": "2n"}.get(argument.strip(), argument.replace(" ", ""))
    parts = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", argument)
    if parts is None or not argument:
        raise ValueError(f"not a position: {argument}")
    step = 0 if parts[1] is None else int(parts[1] + "1" if parts[1] in ("", "+", "-") else parts[1])
    rest = F.col(column) - int(parts[2] or 0)
    return rest == 0 if step == 0 else (rest % step == 0) & (rest / step >= 0)


def matches(compound: str) -> Column:
    """Whether an element fits a selector without blanks: name, ``.class``, ``#id``, ``[attribute]`` with =, ^=,
    $=, *=, ~= or |=, and positions such as ``:nth-child(2n+1)``, ``:last-of-type``, ``:not(...)``."""
    found, at = [F.col("name") != "#text"], 0
    while at < len(compound):
        part = _SIMPLE.match(compound, at)
        if part is None:
            raise ValueError(f"not a selector: {compound}")
        class_, id_, name, operator, value, pseudo, argument = part.groups()
        has = F.col("attributes")[name] if name else None
        if class_ or id_:
            found.append(F.array_contains(F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+"), class_) if class_ else F.col("attributes")["id"] == id_)
        elif name:
            empty = F.lit(value != "")
            test = {
                None: lambda: has.isNotNull(), "=": lambda: has == value, "^=": lambda: has.startswith(value) & empty, "$=": lambda: has.endswith(value) & empty, "*=": lambda: F.contains(has, F.lit(value)) & empty,
                "~=": lambda: F.array_contains(F.split(has, r"\s+"), value), "|=": lambda: (has == value) | has.startswith(f"{value}-"),
            }
            found.append(test[operator]())
        elif pseudo in _POSITIONS:
            found.append(F.expr(_POSITIONS[pseudo]))
        elif pseudo in ("nth-child", "nth-of-type"):
            found.append(_nth("place" if pseudo == "nth-child" else "of_type", argument or ""))
        elif pseudo == "not" and argument:
            found.append(~matches(argument))
        elif pseudo:
            raise ValueError(f"not a selector: {compound}")
        elif part[0] != "*":
            found.append(F.col("name") == part[0].lower())
        at = part.end()
    return F.coalesce(reduce(lambda a, b: a & b, found), F.lit(False))


def _steps(selector: str) -> list[tuple[str, str]]:
    """Pairs of a combinator (blank, >, + or ~) and a selector without blanks."""
    pattern = r"""([>+~])|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+)"""
    if re.sub(pattern, "", selector).strip():
        raise ValueError(f"not a selector: {selector}")
    parts, steps, sign = re.findall(pattern, selector), [], " "
    for combinator, compound in parts:
        if combinator:
            sign = combinator
        else:
            steps.append((sign, compound))
            sign = " "
    if not steps or sign != " " or steps[0][0] != " ":
        raise ValueError(f"not a selector: {selector}")
    return steps


def flagged(table: DataFrame, selector: str, name: str) -> DataFrame:
    """A table of nodes with a boolean column: whether a node is an element that the selector (or one of
    several, with commas between) selects."""
    columns = table.columns
    chosen = []
    for number, one in enumerate(re.split(r",(?![^\[]*\])", selector)):
        now = None
        for step, (sign, compound) in enumerate(_steps(one)):
            column, fits = f"__{name}{number}_{step}", matches(compound)
            siblings = Window.partitionBy("key", "parent", F.col("name") == "#text").orderBy("node")
            if now is None:
                table = table.withColumn(column, fits)
            elif sign == " ":
                table = table.withColumn(column, fits & inside(F.col(now)))
            elif sign == ">":
                parents = table.filter(now).select(F.col("key").alias("__key"), F.col("node").alias("__node"))
                table = table.join(parents, F.col("key").eqNullSafe(F.col("__key")) & (F.col("parent") == F.col("__node")), "left")
                table = table.withColumn(column, fits & F.col("__node").isNotNull()).drop("__key", "__node")
            elif sign == "+":
                table = table.withColumn(column, fits & F.coalesce(F.lag(now).over(siblings), F.lit(False)))
            else:
                earlier = F.max(now).over(siblings.rowsBetween(Window.unboundedPreceding, -1))
                table = table.withColumn(column, fits & F.coalesce(earlier, F.lit(False)))
            now = column
        chosen.append(F.col(now))
    return table.select(*columns, reduce(lambda a, b: a | b, chosen).alias(name))


def select(table: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector selects."""
    return flagged(table, selector, "__selected").filter("__selected").drop("__selected")


# -- cutting
def _outer() -> Column:
    """Whether a part (first and end) of a page lies within no earlier one."""
    reach = F.max("end").over(Window.partitionBy("key").orderBy("first", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return reach.isNull() | (F.col("first") >= reach)


def _without(page: Column, cuts: Column) -> Column:
    """A page with the parts of a sorted array (first, end, text) replaced."""
    piece = lambda p, i: F.concat(F.substr(page, F.when(i == 0, 1).otherwise(F.get(cuts, i - 1)["end"] + 1), p["first"] - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])), F.coalesce(p["text"], F.lit("")))
    rest = F.substr(page, F.try_element_at(cuts, F.lit(-1))["end"] + 1)
    return F.when(cuts.isNull() | (F.size(cuts) == 0), page).otherwise(F.concat(F.array_join(F.transform(cuts, piece), ""), rest))


def cut(pages: DataFrame, key: str, html: str, parts: DataFrame) -> DataFrame:
    """pages with parts of the HTML replaced; parts has key, first, end and text (null: nothing comes in its
    place). Parts within earlier ones are passed over."""
    outer = parts.withColumn("__outer", _outer()).filter("__outer")
    lists = outer.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("first", "end", "text"))).alias("__parts"))
    names = pages.columns
    joined = pages.join(lists, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(*[_without(F.col(html), F.col("__parts")).alias(c) if c == html else F.col(c) for c in names])


def replace_elements(pages: DataFrame, key: str, html: str, replacements: Mapping[str, str | None]) -> DataFrame:
    """pages with the elements of each selector replaced by a text in a span, or removed for None. All
    selectors see the page as it is; of nested elements the outer one counts, of selectors for one
    element the first. ``table > tr`` also finds rows in a table's body."""
    table = nodes(pages, key, html)
    chosen = F.lit(None).cast("struct<text:string>")
    for number, (selector, text) in reversed(list(enumerate(replacements.items()))):
        table = flagged(table, re.sub(r"(?i)table\s*>\s*tr\b", "table > tr, table > tbody > tr", selector), f"__s{number}")
        new = F.lit(None).cast("string") if text is None else F.lit("<span>" + text.replace("&", "&amp;").replace("<", "&lt;") + "</span>")
        chosen = F.when(F.col(f"__s{number}"), F.struct(new.alias("text"))).otherwise(chosen)
    return cut(pages, key, html, table.select("key", "first", "end", chosen.alias("r")).filter("r is not null").select("key", "first", "end", "r.text"))


def element_texts(table: DataFrame, selector: str) -> DataFrame:
    """key, html_first (place and end of the first element) and text: on one line, of the last element."""
    chosen = flagged(table, selector, "__selected")
    number = F.max(F.when(F.col("__selected"), F.col("node"))).over(_in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chosen = chosen.withColumn("__last", number)
    start = F.min(F.when(F.col("__selected"), F.struct("node", "first", "end")))
    end = F.max(F.when(F.col("node") == F.col("__last"), F.col("last")))
    ends = chosen.groupBy("key").agg(start.alias("found"), end.alias("to"), F.max("__last").alias("from")).filter("found is not null")
    texts = table.filter("name = '#text'").select(F.col("key").alias("__key"), F.col("node").alias("__node"), "text")
    joined = ends.join(texts, F.col("key").eqNullSafe(F.col("__key")) & F.col("__node").between(F.col("from"), F.col("to")), "left")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("__node").isNotNull(), F.struct("__node", "text")))), lambda p: p["text"])
    return joined.groupBy("key").agg(F.any_value("found").alias("found"), F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")).alias("text")).select("key", "found.first", "found.end", "text")


# -- clean-up before markdown
def _with_children(table: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """A whole table of nodes, and whether a node has a child with each flag. Siblings tell one another, and the
    first of them, which comes right after its parent, tells it; so rows stay where they are."""
    siblings = Window.partitionBy("key", "parent")
    table = table.withColumns({f"{name}_here": F.max(flag).over(siblings) for name, flag in flags.items()})
    told = {name: (F.col("last") > F.col("node")) & F.lead(f"{name}_here").over(_in_order()) for name in flags}
    return table.withColumns({name: F.coalesce(value, F.lit(False)) for name, value in told.items()})


def clean_up(table: DataFrame) -> DataFrame:
    """The table of nodes without what leaves empty marks in markdown, and with ``goes``: the step at which a
    node goes (itself or with an ancestor), null if it stays.

    1 empty list items, 2 lists without other items, 3 empty children of quotes, 4 empty quotes, 5 to 9 empty
    p, div, span, section and article that have no structural role, 10 line breaks after two others, 11 other
    elements without children whose text can't be seen. Empty means: no text but blanks, no picture, control
    or other such element, no placeholder in it. That doesn't change when empty items go, so what a tree walk
    repeats until nothing changes is one condition here."""
    role = F.lower(F.coalesce(F.col("attributes")["class"], F.lit("")))
    structural = (F.coalesce(F.col("attributes")["id"], F.lit("")) != "") | F.col("attributes")["role"].isNotNull() | reduce(lambda a, b: a | b, [F.contains(role, F.lit(s)) for s in STRUCTURAL])
    text = F.col("name") == "#text"
    placeholder = F.exists(F.map_values(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda v: F.contains(v, F.lit("{{")))
    content = (text & (F.regexp_replace("text", r"\s+", "") != "")) | F.col("name").isin(*MEANINGFUL)
    # all that texts, attributes and ancestors' names are asked for is a flag before the first window: a query that
    # doesn't return these columns doesn't shuffle or sort them
    table = table.withColumns({
        "__structural": F.coalesce(structural, F.lit(False)), "__placeholder": placeholder, "__content": content, "__quoted": F.coalesce(F.try_element_at("names", F.lit(-1)) == "blockquote", F.lit(False)),
        "__blank": text & (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""), "__visible": text & ~F.col("text").rlike(BLANK),
    })

    def empty(stays: Column) -> Column:
        # an element's own attributes aren't within it
        marks = _next(F.col("__placeholder") & stays, 1)
        return ~text & ~contains(F.col("__content") & stays) & ~F.coalesce(marks <= F.col("last"), F.lit(False))

    table = table.withColumn("__empty", empty(F.lit(True)))
    table = table.withColumn("__item", F.col("__empty") & (F.col("name") == "li"))
    table = _with_children(table, {"__others": ~text & ~F.col("__item")})
    table = table.withColumn("__list", F.when(F.col("__item"), 1).when(F.col("name").isin("ul", "ol") & ~F.col("__others"), 2))
    # a list without items may hold text, which goes with it
    table = table.withColumn("__stays", F.col("__list").isNull() & ~inside(F.col("__list").isNotNull())).withColumn("__empty", empty(F.col("__stays")))
    rank = F.when(F.col("__list").isNotNull(), F.col("__list")).when(F.col("__empty") & F.col("__quoted"), 3).when(F.col("__empty") & (F.col("name") == "blockquote"), 4)
    for number, name in enumerate(("p", "div", "span", "section", "article"), 5):
        rank = rank.when(F.col("__empty") & (F.col("name") == name) & ~F.col("__structural"), number)
    # line breaks that follow one another among siblings, blank text between them aside
    siblings = Window.partitionBy("key", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_break = F.col("name") == "br"
    table = table.withColumn("__rank", rank)
    other = ~is_break & F.col("__rank").isNull() & ~F.col("__blank")
    table = table.withColumn("__breaks", F.sum(F.when(is_break, 1).otherwise(0)).over(siblings))
    number = F.col("__breaks") - F.coalesce(F.max(F.when(other, F.col("__breaks"))).over(siblings), F.lit(0))
    table = table.withColumn("__number", number).withColumn("__own", F.coalesce("__rank", F.when(is_break & (F.col("__number") > 2), 10)))
    table = _with_children(table, {"__left": ~text & F.col("__own").isNull(), "__seen": F.col("__visible")})
    invisible = ~text & ~F.col("__left") & ~F.col("__seen") & ~F.col("__structural") & ~F.col("name").isin("br", "hr", "img", "input", "meta", "link") & (F.col("parent") >= 0)
    table = table.withColumn("__own", F.coalesce("__own", F.when(invisible, 11)))
    cover = reduce(F.least, [F.when(inside(F.col("__own") <= r), r) for r in range(1, 12)])
    drop = [c for c in table.columns if c.startswith("__") and c != "__own"]
    return table.withColumn("__cover", cover).withColumn("goes", F.least("__own", "__cover")).withColumn("own_step", F.when(F.col("__cover").isNull() | (F.col("__own") <= F.col("__cover")), F.col("__own"))).drop(*drop, "__own", "__cover")


def cleaned(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages without empty elements, and three counts: empty_items, empty_quote_children, empty_elements."""
    gone = clean_up(nodes(pages, key, html)).filter("goes is not null").withColumn("__outer", _outer())
    some = lambda low, high: F.count(F.when(F.col("own_step").between(low, high), 1))
    parts = F.array_sort(F.collect_list(F.when(F.col("__outer"), F.struct("first", "end", F.lit(None).cast("string").alias("text")))))
    found = gone.groupBy(F.col("key").alias("__key")).agg(parts.alias("__parts"), some(1, 1).alias("empty_items"), some(3, 3).alias("empty_quote_children"), (some(2, 2) + some(4, 9) + some(11, 11)).alias("empty_elements"))
    names = pages.columns
    joined = pages.join(found.hint("merge"), F.col(key).eqNullSafe(F.col("__key")), "left")
    new = [_without(F.col(html), F.col("__parts")).alias(c) if c == html else F.col(c) for c in names]
    return joined.select(*new, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("empty_items", "empty_quote_children", "empty_elements")])


# -- markdown
_SKIPPED = (*H.SKIPPED, "title")


def markdown(table: DataFrame, pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and markdown of each page that has nodes: headings, paragraphs, quotes, fenced code, lists with
    their levels and numbers, tables, rules, links, pictures, bold, italic and code.

    A block is a run of nodes between two edges of block elements. Each node gives the sign that opens it and
    the one that closes it after its last descendant; a block's signs in order are its line, and the block's
    ancestors give what stands before it. What ancestors and attributes are asked for is a number or a flag
    before nodes are shuffled, once, by page: all else is windows and groups within a page. Pages in which there
    is a table come along, each as a row after its nodes, as a table's text is made from its source."""
    own, block_names = F.concat("names", F.array("name")), sorted(dom.BLOCKS)
    skipped = F.exists(own, lambda n: n.isin(*_SKIPPED))
    in_table = F.exists("names", lambda n: n == "table")
    attribute = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    name, pre = F.col("name"), F.exists("names", lambda n: n == "pre")
    text = F.when(pre, F.col("text")).otherwise(F.regexp_replace("text", r"[\s ]+", " "))
    sign = (
        F.when(name == "#text", text).when(name.isin("b", "strong"), "**").when(name.isin("i", "em"), "*").when(name.isin("code", "kbd", "samp") & ~pre, "`").when((name == "a") & (attribute("href") != ""), "[")
        .when(name == "br", "\n").when(name == "hr", "---").when((name == "img") & (attribute("src") != ""), F.concat(F.lit("!["), attribute("alt"), F.lit("]("), attribute("src"), F.lit(")"))).when(name == "table", "\u0003")
    )
    after = F.when(name.isin("b", "strong"), "**").when(name.isin("i", "em"), "*").when(name.isin("code", "kbd", "samp") & ~pre, "`").when((name == "a") & (attribute("href") != ""), F.concat(F.lit("]("), attribute("href"), F.lit(")")))
    among = lambda *names: F.size(F.filter(own, lambda n: n.isin(*names)))
    heading = F.try_element_at(F.filter(own, lambda n: n.rlike("^h[1-6]$")), F.lit(1))
    table = table.filter(~skipped & ~in_table).select(
        "key", "node", "last", "depth", name.isin(*block_names).alias("is_block"), F.size("names").alias("above"), F.coalesce(F.array_max(F.transform(own, lambda n, i: F.when(n.isin(*block_names), i + 1))), F.lit(0)).alias("lowest"),
        sign.alias("sign"), after.alias("after"), F.col("first").alias("from"), F.col("end").alias("to"), F.exists(own, lambda n: n == "pre").alias("code"), F.substr(heading, F.lit(2)).cast("int").alias("heading"), among("ul", "ol", "menu").alias("level"), among("blockquote").alias("quotes"),
        among("li").alias("items"), F.when(name == "li", F.struct(F.col("node").alias("li"), "of_type", F.try_element_at("names", F.lit(-1)).alias("list"))).alias("item"),
    )
    sources = pages.filter(F.col(html).rlike("(?i)<table")).select(
        F.col(key).alias("key"), F.lit(2**31 - 1).alias("node"), F.lit(2**31 - 1).alias("last"), F.lit(0).alias("depth"), F.lit(True).alias("is_block"), F.lit(0).alias("items"), F.col(html).cast("string").alias("source")
    )
    table = table.unionByName(sources, allowMissingColumns=True)
    # between a node and the one before it a block ends, if the other's lowest block is below what is above both
    edge = F.col("is_block") | F.coalesce(F.lag("lowest").over(_in_order()) > F.col("above"), F.lit(True))
    table = table.withColumn("edge", edge).withColumn("block", F.sum(F.when(F.col("edge"), 1).otherwise(0)).over(_in_order()))
    # inline elements around blocks give no signs; the others lie in one block, where their closing signs follow their last descendants, if these are left
    table = table.withColumn("plain", F.col("is_block") | ~contains(F.col("is_block")))
    table = table.withColumn("whole", F.max("node").over(Window.partitionBy("key", "last")) == F.col("last"))
    opening = F.struct(F.col("node").alias("at"), F.lit(0).alias("then"), "sign")
    closing = F.struct(F.col("last").alias("at"), (1_000_000 - F.col("depth")).alias("then"), F.col("after").alias("sign"))
    listed_signs = F.concat(F.collect_list(F.when(F.col("plain") & F.col("sign").isNotNull(), opening)), F.collect_list(F.when(F.col("plain") & F.col("whole") & F.col("after").isNotNull(), closing)))
    line = F.array_join(F.transform(F.array_sort(listed_signs), lambda s: s["sign"]), "").alias("line")
    head = F.min(F.when(F.col("edge"), F.struct("node", "source", "from", "to", "code", "heading", "level", "quotes", "items", "item")))
    blocks = table.groupBy("key", "block").agg(line, head.alias("head")).select("key", "block", "line", "head.*")
    # the innermost list item around a block is the last one before it that is as deep in items: each is the head of a block
    items = Window.partitionBy("key", "items").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("item", F.last("item", ignorenulls=True).over(items))
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", " *\n *", "\n"), "^\\s+|\\s+$", ""), "(\\*\\*|\\[) +(?=\\S)", "$1")
    blocks = blocks.withColumn("line", F.when(F.col("code"), F.regexp_replace("line", "^\n|\\s+$", "")).otherwise(trimmed)).filter("source is not null or line != '' and not line rlike '^(\\\\*|`|\\\\s)+$'")
    # the number among its list's items, and the first block in it that has text
    inner = blocks.withColumn("first", F.row_number().over(Window.partitionBy("key", "item.li").orderBy("block")) == 1)
    level, listed = F.col("level"), F.col("item.li").isNotNull()
    mark = F.when(F.col("item.list") == "ol", F.concat(F.col("item.of_type").cast("string"), F.lit(". "))).otherwise("* ")
    lead = F.when(listed & F.col("first"), F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), mark)).when(listed, F.repeat(F.lit("  "), level)).otherwise("")
    part = F.struct("block", "line", (listed & F.col("first")).alias("tight"), listed.alias("listed"), "quotes", lead.alias("lead"), "code", "heading", "from", "to")
    made = inner.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("source").isNull(), part))).alias("parts"), F.any_value("source", ignoreNulls=True).alias("source"))
    of_table = lambda p: H.table_markdown(F.substr(F.col("source"), p["from"] + 1, p["to"] - p["from"]))
    texts = F.transform("parts", lambda p: p.withField("line", F.when(p["line"] == "\u0003", of_table(p)).otherwise(p["line"])))
    made = made.withColumn("parts", F.filter(texts, lambda p: p["line"] != ""))

    def written(p: Column) -> Column:
        line = p["line"]
        body = F.when(p["code"], F.concat(F.lit("```\n"), line, F.lit("\n```"))).when(p["heading"].isNotNull(), F.concat(F.repeat(F.lit("#"), p["heading"]), F.lit(" "), F.replace(line, F.lit("\n"), F.lit(" ")))).otherwise(line)
        prefix = F.concat(F.repeat(F.lit("> "), p["quotes"]), F.repeat(F.lit(" "), F.length(p["lead"])))
        return F.concat(F.repeat(F.lit("> "), p["quotes"]), p["lead"], F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), prefix)))

    joiner = lambda p, i, all_: F.when(i == 0, "").when(p["tight"] & F.get(all_, i - 1)["listed"], "\n").when((p["quotes"] > 0) & (F.get(all_, i - 1)["quotes"] >= p["quotes"]), F.concat(F.lit("\n"), F.repeat(F.lit(">"), p["quotes"]), F.lit("\n"))).otherwise("\n\n")
    whole = F.array_join(F.transform("parts", lambda p, i: F.concat(joiner(p, i, F.col("parts")), written(p))), "")
    # a filter would have it worked out a second time
    return made.select("key", F.explode(F.filter(F.array(whole), lambda m: m != "")).alias("markdown"))


# -- comparison tables
def _mode(rows: DataFrame, parent: str) -> DataFrame:
    """For each key and parent the most frequent number of icons of at least two, of equals the one that comes
    first, how often it occurs, and how many rows have any."""
    counts = rows.filter("icons >= 2").groupBy("key", parent, "icons").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counts.groupBy("key", parent).agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "icons")).alias("m"))
    return best.select("key", parent, F.col("m.n").alias("n_rows"), F.col("m.icons").alias("n_columns"))


def comparison_tables(table: DataFrame, mark: str = "data-ds-local") -> DataFrame:
    """key, id, n_rows and n_columns of marked elements whose children repeat a number of svg icons: either most
    children have as many icons within them, or runs of icons of one length follow the other children. At
    least three such rows, half of all, and two icons a row; in pages with four icons. Elements within one
    that is found don't count."""
    names = Window.partitionBy("key").orderBy("node")
    is_icon = F.col("name") == "svg"
    so_far = table.withColumn("__so_far", F.sum(F.when(is_icon, 1).otherwise(0)).over(names))
    total = so_far.withColumn("__all", F.max("__so_far").over(Window.partitionBy("key"))).filter("__all >= 4")
    # as many rows as elements, in few bytes each: joined by sorting, never sent to all by way of the driver
    ends = total.select(F.col("key").alias("__key"), F.col("node").alias("__node"), F.col("__so_far").alias("__to"))
    children = total.filter("name != '#text'").join(ends.hint("merge"), F.col("key").eqNullSafe(F.col("__key")) & (F.col("last") == F.col("__node")))
    children = children.select("key", "parent", F.col("node").alias("at"), (F.col("__to") - F.col("__so_far") + F.when(is_icon, 1).otherwise(0)).alias("icons"), is_icon.alias("icon"))
    sizes = children.groupBy("key", "parent").agg(F.count("*").alias("n_children")).filter("n_children >= 3")
    nested = _mode(children, "parent").join(sizes.hint("merge"), ["key", "parent"]).filter("n_rows >= 3 and n_rows >= 0.5 * n_children").select("key", "parent", F.lit(1).alias("way"), "n_rows", "n_columns")
    runs = children.withColumn("run", F.sum(F.when(F.col("icon"), 0).otherwise(1)).over(Window.partitionBy("key", "parent").orderBy("at")))
    runs = runs.filter("icon").groupBy("key", "parent", "run").agg(F.count("*").alias("icons"), F.min("at").alias("at"))
    n_runs = runs.groupBy("key", "parent").agg(F.count("*").alias("n_runs")).filter("n_runs >= 3")
    flat = _mode(runs, "parent").join(n_runs.hint("merge"), ["key", "parent"]).join(sizes.hint("merge"), ["key", "parent"]).filter("n_rows >= 3 and n_rows >= 0.5 * n_runs").select("key", "parent", F.lit(2).alias("way"), "n_rows", "n_columns")
    best = nested.unionByName(flat).groupBy(F.col("key").alias("__key"), F.col("parent").alias("__parent")).agg(F.min(F.struct("way", "n_rows", "n_columns")).alias("found"))
    joined = total.join(best.hint("merge"), F.col("key").eqNullSafe(F.col("__key")) & (F.col("node") == F.col("__parent")), "left")
    local = F.col("attributes")[mark]
    hit = F.col("found").isNotNull() & (F.coalesce(local, F.lit("")) != "")
    joined = joined.withColumn("__hit", hit)
    chosen = joined.withColumn("__inside", inside(F.col("__hit"))).filter("__hit and not __inside")
    return chosen.select("key", local.alias("id"), F.col("found.n_rows").cast("int").alias("n_rows"), F.col("found.n_columns").cast("int").alias("n_columns"))


#: Words of headers, icons, and what no row of a comparison begins with or has in it.
TIERS = ("free", "pro", "premium", "enterprise", "basic", "starter", "business", "team", "plus")
_ICON, _INFO = r"\{(?:tick|cross|checkmark|check mark) icon\}", r"\{information icon\}"


def comparison_headers(lines: Column) -> Column:
    """The columns' names: the cells of the first table row with three words of tiers, without a first cell that
    names the rows; else the labels of ``label: value - label: value`` lines that occur most, at least twice."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c.rlike(r"\S") & ~c.rlike("^-+$"))
    tiers = lambda c: F.size(F.filter(c, lambda x: F.lower(x).rlike("|".join(TIERS))))
    rows = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"\|([^|]+\|){3,}")), cells), lambda c: (F.size(c) >= 3) & (tiers(c) >= 3))
    first = F.get(rows, F.lit(0))
    named = F.when(F.lower(F.get(first, F.lit(0))).rlike("plan|feature|name"), F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0)))).otherwise(first)
    labels = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(" - ")) & F.contains(x, F.lit(":"))), lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\w[\w\s]*?):\s"), F.lit(1)), lambda y: F.trim(y)))
    labels = F.filter(labels, lambda x: F.size(x) >= 3)
    counted = F.transform(F.array_distinct(labels), lambda x, i: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    best = F.array_max(counted)
    return F.coalesce(named, F.when(best["n"] >= 2, best["x"]))


def linearised(pages: DataFrame, key: str, text: str) -> DataFrame:
    """pages with comparisons in the markdown on one line: a line of text, perhaps an information icon, and just as
    many tick and cross icons, each on a line, as there are headers become ``text: header: icon - ...``.

    Lines of icons belong to the line before them, so a page's lines make islands of a line and its icons; an
    island whose icons fit is one line. All of that is within a page's array of lines: no line is a row, so
    a task holds one page's lines at a time. A page without headers stays as it is."""
    names = pages.columns
    lines = F.split(F.col(text), r"\r\n|\n|\r", -1)
    rows = pages.withColumn("__lines", lines).withColumns({"__headers": comparison_headers(F.col("__lines")), "__icon": F.transform("__lines", lambda x: x.rlike(_ICON))})
    rows = rows.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: (i == 0) | ~F.get("__icon", i)))
    part = lambda s, n: F.slice("__lines", s + 1, F.coalesce(F.get("__starts", n + 1), F.size("__lines")) - s)
    rows = rows.withColumn("__islands", F.transform("__starts", lambda s, n: F.struct(part(s, n).alias("lines"), F.get("__icon", s).alias("headless"))))
    tick = lambda x: F.when(F.regexp_extract(x, "\\{(tick|cross|checkmark|check mark) icon\\}", 1) == "cross", "❌").otherwise("✅")

    def described(x: Column) -> Column:
        head = F.when(~x["headless"], F.get(x["lines"], F.lit(0)))
        icons = F.transform(F.when(x["headless"], x["lines"]).otherwise(F.slice(x["lines"], F.lit(2), F.size(x["lines"]))), tick)
        return F.struct(x["lines"].alias("lines"), F.trim(F.regexp_replace(head, r"^\s+|\s+$", "")).alias("line"), icons.alias("icons"), F.coalesce(head.rlike(_INFO), F.lit(False)).alias("info"))

    def fitted(x: Column, n: Column) -> Column:
        line, following = x["line"], F.get("__islands", n + 1)
        allowed = line.rlike(r"\S") & ~x["info"] & ~line.rlike(r"Free:|Pro AI:|^- |^URL:|^Title:|^#|^\||^```|^\[|^!") & F.length(line).between(2, 199)
        by_next = F.coalesce(following["info"], F.lit(False)) & (F.size(x["icons"]) == 0)
        used = F.when(by_next, following["icons"]).otherwise(x["icons"])
        fits = F.coalesce(allowed & (F.size(used) == F.size("__headers")), F.lit(False))
        return F.struct(x["lines"].alias("lines"), line.alias("line"), used.alias("used"), fits.alias("fits"), (fits & by_next).alias("takes"))

    def written(x: Column, n: Column) -> Column:
        gone = F.coalesce(F.get("__fitted", n - 1)["takes"], F.lit(False))
        pairs = F.array_join(F.zip_with("__headers", x["used"], lambda h, i: F.concat(h, F.lit(": "), i)), " - ")
        return F.when(gone, F.array().cast("array<string>")).when(x["fits"], F.array(F.concat(x["line"], F.lit(": "), pairs))).otherwise(x["lines"])

    rows = rows.withColumn("__islands", F.transform("__islands", described)).withColumn("__fitted", F.transform("__islands", fitted))
    new = F.when(F.col("__headers").isNotNull(), F.array_join(F.flatten(F.transform("__fitted", written)), "\n"))
    return rows.select(*[F.coalesce(new, c).alias(c) if c == text else F.col(c) for c in names])
