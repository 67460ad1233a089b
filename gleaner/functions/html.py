"""HTML functions as column expressions over regular expressions: text, links, tables and lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without visible text.
SKIPPED = ("script", "style", "noscript", "template", "svg", "head", "iframe", "object", "embed", "canvas", "meta")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def without_elements(html: Column, names: tuple[str, ...] = SKIPPED) -> Column:
    """The HTML without comments and without the named elements."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for name in names:
        out = F.regexp_replace(out, f"(?is)<{name}\\b[^>]*>.*?</{name}\\s*>", "")
    return out


def visible_text(html: Column, image_marks: bool = False) -> Column:
    """Text nodes in order, trimmed, one a line; with image_marks, images with a text for them as marks."""
    out = without_elements(html)
    if image_marks:
        out = F.regexp_replace(out, "(?is)<img\\b[^>]*?\\balt=\"\\s*([^\"]*?[^\"\\s])\\s*\"[^>]*>", "\n\u0001$1\u0002\n")
    nodes = F.filter(F.transform(F.split(out, "<[^>]*>|\n(?=\u0001)|(?<=\u0002)\n" if image_marks else "<[^>]*>"), lambda t: F.trim(F.regexp_replace(unescape(t), r"\s+", " "))), lambda t: t != "")
    joined = F.array_join(nodes, "\n")
    return F.replace(F.replace(joined, F.lit("\u0001"), F.lit('<image placeholder alt="')), F.lit("\u0002"), F.lit('"/>')) if image_marks else joined


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    """href of all anchors, in order, non-blank ones, duplicates kept."""
    found = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    return F.filter(found, lambda h: F.trim(h) != "")


def absolute(href: Column, page: Column) -> Column:
    """An href against its page's URL; null for other schemes and bare fragments."""
    base = F.regexp_extract(page, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(page, "^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike("^(?i)https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(base, href)).when(href.startswith("#") | href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None).otherwise(F.concat(folder, href))
    )


def cell_text(cell: Column) -> Column:
    """A cell's text on one line, pipes escaped."""
    plain = F.trim(F.regexp_replace(unescape(F.regexp_replace(cell, "<[^>]*>", " ")), r"\s+", " "))
    return F.replace(plain, F.lit("|"), F.lit("\\|"))


def table_markdown(table: Column, repeat_spans: bool = False) -> Column:
    """A table as pipe-separated markdown, or an empty string without rows. A column span adds empty
    cells, or repeats of the cell with repeat_spans; ragged rows are padded; row spans are ignored. The
    first row is the header if it has header cells, else the header is empty."""
    rows = F.filter(F.regexp_extract_all(table, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: r.rlike("(?i)<t[dh]\\b"))

    def cells(row: Column) -> Column:
        whole = F.regexp_extract_all(row, F.lit("(?is)<t[dh]\\b[^>]*>.*?</t[dh]>"), F.lit(0))
        spans = F.transform(whole, lambda c: F.coalesce(F.regexp_extract(c, "(?is)^<t[dh]\\b[^>]*?colspan=[\"']?([0-9]+)", 1).try_cast("int"), F.lit(1)))
        texts = F.transform(whole, lambda c: cell_text(F.regexp_replace(c, "(?is)^<t[dh]\\b[^>]*>|</t[dh]>$", "")))
        return F.flatten(F.zip_with(texts, spans, lambda t, n: F.concat(F.array(t), F.array_repeat(t if repeat_spans else F.lit(""), n - 1))))

    grid = F.transform(rows, cells)
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    headed = F.try_element_at(rows, F.lit(1)).rlike("(?i)<th\\b")
    empty = F.concat(F.lit("|"), F.repeat(F.lit("  |"), width))
    header = F.when(headed, line(F.try_element_at(grid, F.lit(1)))).otherwise(empty)
    body = F.transform(F.when(headed, F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))).otherwise(grid), line)
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(header, rule), body), "\n"))


def _put(row: Column, first: Column, n: Column, text: Column) -> Column:
    """A row of cells with a text in n cells from a place (counted from 0) on, made longer if it has to be."""
    longer = F.concat(row, F.array_repeat(F.lit(""), F.greatest(first + n - F.size(row), F.lit(0))))
    return F.transform(longer, lambda c, i: F.when((i >= first) & (i < first + n), text).otherwise(c))


def _span(cell: Column, name: str) -> Column:
    """A span as HTML allows it, 1 if it is none."""
    found = F.regexp_extract(cell, f"(?is)^<t[dh]\\b[^>]*?\\b{name}\\s*=\\s*[\"']?\\s*([0-9]+)", 1).try_cast("int")
    return F.least(F.coalesce(found, F.lit(1)), F.lit(1000))


def filled_grid(table: Column) -> Column:
    """A table's cells as an array of rows, with a cell's text wherever its row and column spans reach. A fold
    over the rows carries what is open from rows above; a cell takes the first place without text."""
    none = F.array().cast("array<array<string>>")
    rows = F.regexp_extract_all(table, F.lit("(?is)<tr\\b[^>]*>(.*?)(?=</tr|<tr\\b|</table|\\z)"), F.lit(1))
    make = lambda done, row, ahead, at: F.struct(done.alias("done"), row.alias("row"), ahead.alias("ahead"), at.cast("int").alias("at"))

    def cell(s: Column, c: Column) -> Column:
        text = F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))
        n, down = _span(c, "colspan"), _span(c, "rowspan")
        free = F.filter(F.sequence(s["at"], F.greatest(F.size(s["row"]), s["at"])), lambda i: F.coalesce(F.get(s["row"], i), F.lit("")) == "")
        at = F.get(free, F.lit(0))
        reach = F.greatest(F.size(s["ahead"]), down - 1)
        below = F.transform(F.sequence(F.lit(0), F.greatest(reach - 1, F.lit(0))), lambda r: F.when(r < down - 1, _put(F.coalesce(F.get(s["ahead"], r), F.array().cast("array<string>")), at, n, text)).otherwise(F.get(s["ahead"], r)))
        placed = make(s["done"], _put(s["row"], at, n, text), F.when(reach > 0, below).otherwise(none), at + n)
        return F.when(down > 0, placed).otherwise(make(s["done"], s["row"], s["ahead"], at + n))

    def row(s: Column, r: Column) -> Column:
        cells = F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>.*?(?=</t[dh]|<t[dh]\\b|\\z)"), F.lit(0))
        begun = make(s["done"], F.coalesce(F.get(s["ahead"], F.lit(0)), F.array().cast("array<string>")), F.slice(s["ahead"], 2, F.greatest(F.size(s["ahead"]) - 1, F.lit(0))), F.lit(0))
        ended = F.aggregate(cells, begun, cell)
        return make(F.array_append(ended["done"], ended["row"]), F.array().cast("array<string>"), ended["ahead"], F.lit(0))

    start = make(none, F.array().cast("array<string>"), none, F.lit(0))
    return F.aggregate(rows, start, row, lambda s: F.concat(s["done"], s["ahead"]))


def span_table_markdown(table: Column) -> Column:
    """A table as pipe-separated markdown in which the text of a cell stands in all the cells that it spans; the
    caption is a line before it. The header is the last row of the table's head, else the first row with a
    header cell, else the first row. A table without cells is empty."""
    rows = F.regexp_extract_all(table, F.lit("(?is)<tr\\b[^>]*>(.*?)(?=</tr|<tr\\b|</table|\\z)"), F.lit(1))
    in_head = F.regexp_count(F.regexp_extract(table, "(?is)^(.*?</thead)", 1), F.lit("(?i)<tr\\b")) - 1
    with_header = F.array_position(F.transform(rows, lambda r: r.rlike("(?i)<th\\b")), F.lit(True)) - 1
    place = F.when(in_head >= 0, in_head).when(with_header >= 0, with_header).otherwise(0).cast("int")
    caption = F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_extract(table, "(?is)<caption\\b[^>]*>(.*?)</caption", 1), "<[^>]*>", " ")), r"\s+", " "))

    def text(grid: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
        cells = lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
        line = lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        body = F.transform(F.filter(grid, lambda r, i: i != place), line)
        whole = F.array_join(F.concat(F.when(caption != "", F.array(caption)).otherwise(F.array().cast("array<string>")), F.array(line(F.get(grid, place)), rule), body), "\n")
        return F.when(width == 0, F.lit("")).otherwise(whole)

    return F.get(F.transform(F.array(filled_grid(table)), text), F.lit(0))


def with_tables_as_markdown(text: Column) -> Column:
    """A text in which HTML tables have become markdown (span_table_markdown), all else as it is."""
    pattern = "(?is)<table\\b.*?</table>"
    tables = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.concat(F.lit("\n"), span_table_markdown(t), F.lit("\n")))
    pieces = F.zip_with(F.split(text, pattern, -1), tables, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.regexp_replace(F.array_join(pieces, ""), "^\\s+|\\s+$", "")


def list_markdown(html: Column) -> Column:
    """A list as markdown: ``*`` or ``n.``, two blanks a level; empty items keep their mark.

    Tags are folded in order; the state is the stack of open lists (the items so far, -1 for unordered)
    and the lines."""
    tokens = F.regexp_extract_all(html, F.lit("(?s)<[^>]*>|[^<]+"), F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, t: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        popped = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        mark = F.concat(F.repeat(F.lit("  "), F.size(s["open"]) - 1), F.when(top < 0, "*").otherwise(F.concat((top + 1).cast("string"), F.lit("."))))
        text = F.trim(F.regexp_replace(unescape(t), r"\s+", " "))
        last = F.try_element_at(s["lines"], F.lit(-1))
        make = lambda o, l: F.struct(o.alias("open"), l.alias("lines"))
        return (
            F.when(t.rlike("(?i)^<ul"), make(F.array_append(s["open"], F.lit(-1)), s["lines"]))
            .when(t.rlike("(?i)^<ol"), make(F.array_append(s["open"], F.lit(0)), s["lines"]))
            .when(t.rlike("(?i)^</(ul|ol)"), make(popped, s["lines"]))
            .when(t.rlike("(?i)^<li") & (F.size(s["open"]) > 0), make(F.array_append(popped, F.when(top < 0, -1).otherwise(top + 1)), F.array_append(s["lines"], mark)))
            .when(t.startswith("<") | (text == "") | (F.size(s["lines"]) == 0), s)
            .otherwise(make(s["open"], F.array_append(F.slice(s["lines"], 1, F.greatest(F.size(s["lines"]) - 1, F.lit(0))), F.concat(last, F.lit(" "), text))))
        )

    return F.array_join(F.aggregate(tokens, start, step)["lines"], "\n")


def to_markdown(html: Column) -> Column:
    """Headings, paragraphs, items, links, bold and breaks of a page's body as markdown."""
    out = without_elements(html)
    for level in range(1, 7):
        out = F.regexp_replace(out, f"(?is)<h{level}\\b[^>]*>(.*?)</h{level}\\s*>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, "(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, "(?is)<(?:b|strong)\\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    out = F.regexp_replace(out, "(?is)<li\\b[^>]*>", "\n* ")
    out = F.regexp_replace(out, "(?is)<br\\s*/?>", "\n")
    out = F.regexp_replace(out, "(?is)</?(?:p|div|article|section|ul|ol|table|tr|nav|header|footer)\\b[^>]*>", "\n\n")
    out = unescape(F.regexp_replace(out, "<[^>]*>", ""))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "^\\s+|\\s+$", ""))


def link_html(html: Column) -> Column:
    """What a ranking of links needs of a page: no scripts, styles, pictures or comments; anchors with
    href and label only; long texts cut to 100 characters; no empty elements (two passes)."""
    out = without_elements(html, ("script", "style", "svg", "noscript"))
    out = F.regexp_replace(out, "(?is)<a\\s[^>]*?(href=\"[^\"]*\")[^>]*>", "<a $1>")
    out = F.regexp_replace(out, "(?is)<(?!a\\s)([a-z0-9]+)\\s[^>]*>", "<$1>")
    out = F.regexp_replace(out, "(?s)>([^<]{100})[^<]+<", ">$1...<")
    for _ in range(2):
        out = F.regexp_replace(out, "(?is)<(?!a\\b)([a-z0-9]+)>\\s*</\\1>", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def element_pattern(selector: str) -> str:
    """A regular expression of the elements of a simple selector: a tag, alone or with one ``.class``,
    ``#id`` or ``[name="value"]``. An element ends at the first closing tag of its name, so elements
    nested in one of the same name aren't told apart; images and breaks have no closing tag."""
    parts = re.fullmatch(r"([a-z][a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)=\"([^\"]*)\"\])?", selector)
    if parts is None:
        raise ValueError(f"not a simple selector: {selector}")
    tag, class_, id_, name, value = parts.groups()
    asked = ""
    if class_:
        asked = f'\\bclass="(?:[^"]*\\s)?{re.escape(class_)}(?:\\s[^"]*)?"'
    elif id_:
        asked = f'\\bid="{re.escape(id_)}"'
    elif name:
        asked = f'\\b{name}="{re.escape(value)}"'
    opening = f"<{tag}\\b[^>]*?{asked}[^>]*>" if asked else f"<{tag}\\b[^>]*>"
    return f"(?is){opening}" if tag in ("img", "br", "hr", "input") else f"(?is){opening}.*?</{tag}\\s*>"


def replace_elements(html: Column, replacements: dict[str, str | None]) -> Column:
    """The HTML with a selector's elements replaced by a text in a span, or removed for None."""
    for selector, text in replacements.items():
        with_ = "" if text is None else f"<span>{text}</span>"
        html = F.regexp_replace(html, element_pattern(selector), with_.replace("\\", "\\\\").replace("$", "\\$"))
    return html


def element_html(html: Column, selector: str) -> Column:
    """The first element of a selector, or null."""
    return F.nullif(F.regexp_extract(html, element_pattern(selector), 0), F.lit(""))


def element_text(html: Column, selector: str) -> Column:
    """The text of the last element of a selector, on one line, or null."""
    found = F.regexp_extract_all(html, F.lit(element_pattern(selector)), F.lit(0))
    last = F.try_element_at(found, F.lit(-1))
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(last, "<[^>]*>", " ")), r"\s+", " "))


def with_placeholders(html: Column, selector: str, prefix: str) -> Column:
    """A struct of the HTML in which a selector's elements are ``{{PREFIX_n}}`` in a span, counted from 0
    in order, and the map from ``PREFIX_n`` to the element."""
    pattern = element_pattern(selector)
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    names = F.transform(found, lambda _, i: F.concat(F.lit(f"{prefix}_"), i.cast("string")))
    marks = F.transform(names, lambda n: F.concat(F.lit("<span>{{"), n, F.lit("}}</span>")))
    pieces = F.zip_with(F.split(html, pattern, -1), marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.struct(F.array_join(pieces, "").alias("html"), F.map_from_arrays(names, found).alias("elements"))


def restored(html: Column, elements: Column) -> Column:
    """The HTML with each ``<span>{{NAME}}</span>`` or ``{{NAME}}`` of the map put back."""
    def put(text: Column, e: Column) -> Column:
        mark = F.concat(F.lit("{{"), e["key"], F.lit("}}"))
        return F.replace(F.replace(text, F.concat(F.lit("<span>"), mark, F.lit("</span>")), e["value"]), mark, e["value"])

    return F.aggregate(F.map_entries(elements), html, put)


def link_descriptors(html: Column) -> Column:
    """path and text of a page's links within the site, one a path (the first): relative paths only; the
    text (80 characters), else its aria-label, an image's alt, its title, else ``[no text]``."""
    anchors = F.regexp_extract_all(without_elements(html), F.lit("(?is)<a\\s[^>]*>.*?</a\\s*>"), F.lit(0))

    def of(name: str, a: Column) -> Column:
        return F.nullif(F.trim(unescape(F.regexp_extract(a, f'(?is)^[^>]*?\\s{name}="([^"]*)"', 1))), F.lit(""))

    def describe(a: Column) -> Column:
        text = F.trim(F.regexp_replace(unescape(F.regexp_replace(a, "<[^>]*>", " ")), r"\s+", " "))
        alt = F.nullif(F.trim(unescape(F.regexp_extract(a, '(?is)<img\\b[^>]*?\\balt="([^"]*)"', 1))), F.lit(""))
        path = F.regexp_replace(F.coalesce(of("href", a), F.lit("")), "#.*$", "")
        return F.struct(path.alias("path"), F.coalesce(F.nullif(F.left(text, F.lit(80)), F.lit("")), of("aria-label", a), alt, of("title", a), F.lit("[no text]")).alias("text"))

    links = F.filter(F.transform(anchors, describe), lambda d: d["path"].rlike("^/(?!/)"))
    paths = F.transform(links, lambda d: d["path"])
    return F.filter(links, lambda d, i: F.array_position(paths, d["path"]) == i + 1)
