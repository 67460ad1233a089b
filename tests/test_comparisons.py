"""Tables with spans, comparison patterns and comparison lines against plain versions."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.operators import dom as O


class Cells(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.rows, self.head, self.in_head = [], -1, False
        self.feed(html)

    def handle_starttag(self, name, attributes):
        a = dict(attributes)
        if name == "thead":
            self.in_head = True
        elif name == "tr":
            self.rows.append([])
            self.head = len(self.rows) - 1 if self.in_head else self.head
        elif name in ("td", "th"):
            span = lambda n: int(a[n]) if re.fullmatch(r"\d+", a.get(n) or "") else 1
            self.rows[-1].append([name, span("colspan"), span("rowspan"), ""])

    def handle_endtag(self, name):
        if name == "thead":
            self.in_head = False

    def handle_data(self, data):
        if self.rows and self.rows[-1]:
            self.rows[-1][-1][3] += data


def plain_table(html):
    parsed = Cells(html)
    grid = []
    for r, cells in enumerate(parsed.rows):
        while len(grid) <= r:
            grid.append([])
        at = 0
        for _, n, down, text in cells:
            text = " ".join(text.split())
            while at < len(grid[r]) and grid[r][at]:
                at += 1
            for k in range(r, r + down):
                while len(grid) <= k:
                    grid.append([])
                grid[k] += [""] * (at + n - len(grid[k]))
                for c in range(at, at + n):
                    grid[k][c] = text
            at += n
    width = max(map(len, grid), default=0)
    if not width:
        return ""
    header = parsed.head if parsed.head >= 0 else next((i for i, r in enumerate(parsed.rows) if any(c[0] == "th" for c in r)), 0)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(grid[header]), "| " + " | ".join(["---"] * width) + " |", *(line(r) for i, r in enumerate(grid) if i != header)])


def test_tables_with_spans(spark):
    rnd = random.Random(15)
    cases = []
    for n in range(120):
        rows = []
        for r in range(rnd.randint(0, 5)):
            cells = "".join(f"<{(t := rnd.choice(['td', 'td', 'th']))}{rnd.choice(['', '', ' colspan=2', ' rowspan=\"2\"', ' rowspan=3 colspan=\"2\"', ' colspan=x'])}> {rnd.choice(['a', 'b c', 'd|e', '', str(n)])} </{t}>" for _ in range(rnd.randint(0, 4)))
            rows.append(f"<tr>{cells}</tr>")
        body = "".join(rows)
        cases.append((n, f"<table class='x'>{body}</table>" if n % 3 else f"<table><thead>{''.join(rows[:1])}</thead><tbody>{''.join(rows[1:])}</tbody></table>" if rows else "<table></table>"))
    df = spark.createDataFrame(cases, "n int, html string")
    for r in df.select("n", H.span_table_markdown(F.col("html")).alias("m")).collect():
        assert r.m == plain_table(cases[r.n][1]), cases[r.n][1]


def test_tables_in_a_text(spark):
    text = "Before <b>x</b>\n<TABLE><caption> A <i>title</i> </caption><tr><th>h</th><th colspan=2>k</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></TABLE> between <table></table> after "
    got = spark.createDataFrame([(text,), (None,), ("none",)], "t string").select(H.with_tables_as_markdown(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == ["Before <b>x</b>\n\nA title\n| h | k | k |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 1 | 4 |  |\n between \n\n after", None, "none"]


def plain_patterns(html):
    """By a walk over the tree of tests.test_pages."""
    from tests.test_pages import Builder

    root = Builder(html).root
    if sum(n.name == "svg" for n in root.walk()) < 4:
        return []
    out, found = [], []

    def mode(counts, least_of):
        some = [c for c in counts if c >= 2]
        if not some:
            return None
        n, rows = max(Counter(some).items(), key=lambda x: x[1])
        return (rows, n) if rows >= 3 and rows / least_of >= 0.5 else None

    for e in root.walk():
        if not e.attributes.get("data-ds-local") or any(f in e.ancestors() for f in found):
            continue
        children = e.elements()
        if len(children) < 3:
            continue
        hit = mode([sum(n.name == "svg" for n in c.walk()) for c in children], len(children))
        if not hit:
            runs, now = [], 0
            for c in children:
                if c.name == "svg":
                    now += 1
                else:
                    runs, now = [*runs, now] if now else runs, 0
            runs = [*runs, now] if now else runs
            hit = mode(runs, len(runs)) if len(runs) >= 3 else None
        if hit:
            found.append(e)
            out.append((e.attributes["data-ds-local"], *hit))
    return out


def test_comparison_patterns(spark):
    rnd, cases, number = random.Random(18), [], iter(range(10**6))
    svg = "<svg></svg>"

    def part(depth):
        kind, n = rnd.random(), rnd.randint(1, 3)
        if depth < 2 and kind < 0.35:
            inner = "".join(part(depth + 1) for _ in range(rnd.randint(1, 3)))
        elif kind < 0.65:
            inner = "".join(f"<div>f{svg * rnd.choice([n, n, n, 1])}</div>" for _ in range(rnd.randint(2, 6)))
        else:
            inner = "".join(f"<p>f</p>{svg * rnd.choice([n, n, 0, 2])}" for _ in range(rnd.randint(2, 6)))
        return f'<section data-ds-local="e{next(number)}">{inner}</section>' if rnd.random() < 0.8 else f"<section>{inner}</section>"

    cases = [(n, f"<div>{part(0)}{part(0)}</div>") for n in range(120)]
    df = spark.createDataFrame(cases, "id int, html string").repartition(3)
    got = {}
    for r in O.comparison_tables(O.nodes(df, "id", "html")).collect():
        got.setdefault(r.key, []).append((r.id, r.n_rows, r.n_columns))
    for n, html in cases:
        assert sorted(got.get(n, [])) == sorted(plain_patterns(html)), html
    assert len(got) > 40


def plain_linearised(text):
    lines, headers = re.split(r"\r\n|\n|\r", text), None
    for line in lines:
        cells = [c.strip() for c in line.split("|") if c.strip() and set(c.strip()) != {"-"}]
        if re.search(r"\|([^|]+\|){3,}", line) and len(cells) >= 3 and sum(any(t in c.lower() for t in O.TIERS) for c in cells) >= 3:
            headers = cells[1:] if re.search("plan|feature|name", cells[0].lower()) else cells
            break
    if headers is None:
        counts = Counter(tuple(h.strip() for h in re.findall(r"([A-Za-z0-9_][A-Za-z0-9_\s]*?):\s", x)) for x in lines if " - " in x and ":" in x)
        counts = {k: v for k, v in counts.items() if len(k) >= 3}
        best = max(counts, key=counts.get, default=None)
        if best is None or counts[best] < 2:
            return text
        headers = list(best)
    out, i = [], 0
    icon = re.compile(r"\{(tick|cross|checkmark|check mark) icon\}")
    while i < len(lines):
        line = lines[i].strip()
        if line and not icon.search(line) and "{information icon}" not in line and not re.search(r"Free:|Pro AI:", line) and not re.match(r"- |URL:|Title:|#|\||```|\[|!", line) and 1 < len(line) < 200:
            j = i + 1
            if j < len(lines) and "{information icon}" in lines[j]:
                j += 1
            icons = []
            while j < len(lines) and (m := icon.search(lines[j])):
                icons.append("❌" if m[1] == "cross" else "✅")
                j += 1
            if len(icons) == len(headers):
                out.append(f"{line}: " + " - ".join(f"{h}: {x}" for h, x in zip(headers, icons)))
                i = j
                continue
        out.append(lines[i])
        i += 1
    return "\n".join(out)


@pytest.mark.parametrize("head", ["| Plan name | Free | Pro AI | Team |", "| Free | Pro | Plus |", "A: 1 - B c: 2 - D: 3\nx\nA: 4 - B c: 5 - D: 6", "A: 1 - B c: 2 - D: 3", ""])
def test_comparison_lines(spark, head):
    rnd = random.Random(len(head))
    some = ["Feature one", " Feature two ", "# Title", "{tick icon}", "{tick icon}", "{cross icon}", "{checkmark icon}", "{information icon}", "", "- item", "x", "| a | b |", "Free: yes"]
    cases = [(n, head + "\n" + "\n".join(rnd.choices(some, [4, 2, 1, 5, 5, 5, 3, 2, 1, 1, 1, 1, 1], k=rnd.randint(0, 30)))) for n in range(80)]
    cases += [(100, head + "\r\nFeature\r\n{information icon}\r\n{tick icon}\r\n{check mark icon}\r\n{cross icon}\r\nend"), (101, "{tick icon}\nno headers"), (102, "")]
    got = {r.id: r.text for r in O.linearised(spark.createDataFrame([*cases, (103, None)], "id int, text string").repartition(3), "id", "text").collect()}
    assert got.pop(103) is None
    for n, text in cases:
        assert got[n] == plain_linearised(text), text


def test_comparison_tables_broadcast_no_elements(spark):
    row = "<div>Order" + "<svg></svg>" * 3 + "</div>"
    pages = spark.sql("select 1L as id").select("id", F.lit('<body><section data-ds-local="c1">' + row * 4 + "</section></body>").alias("html"))
    found = O.comparison_tables(O.nodes(pages, "id", "html"))
    assert [(r.id, r.n_rows, r.n_columns) for r in found.collect()] == [("c1", 4, 3)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_comparison_lines_stay_within_their_page(spark):
    head = "| Plan | Free | Pro | Team |"
    block = ["Storage", "{tick icon}", "{cross icon}", "{tick icon}", "Users", "{information icon}", "{tick icon}", "{tick icon}", "{cross icon}", "plain"]
    pages = [(1, "\n".join([head, *block * 2000])), (2, "{tick icon}\r\n" + head + "\r\n{tick icon}"), (3, None), (4, "no header\n{tick icon}"), (None, head + "\nStorage\n{tick icon}\n{tick icon}\n{tick icon}")]
    found = O.linearised(spark.createDataFrame(pages, "k long, md string"), "k", "md")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.md for r in found.collect()}
    assert got.pop(1).split("\n") == [head, *["Storage: Free: ✅ - Pro: ❌ - Team: ✅", "Users: Free: ✅ - Pro: ✅ - Team: ❌", "plain"] * 2000]
    assert got == {2: "{tick icon}\n" + head + "\n{tick icon}", 3: None, 4: "no header\n{tick icon}", None: head + "\nStorage: Free: ✅ - Pro: ✅ - Team: ✅"}
