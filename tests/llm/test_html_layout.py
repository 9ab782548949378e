"""Lists, tables and selectors of random pages against plain rules of their own."""

import random

from vespera.llm import html_text


def listing(rng, depth):
    """A list: kind, attributes, items (value, text, nested list)."""
    kind = rng.choice(["ul", "ol", "reversed", "start"])
    start = rng.randint(-3, 120)
    items = [(rng.randint(0, 500) if kind != "ul" and rng.random() < 0.2 else None, "x" * rng.randint(1, 4), listing(rng, depth - 1) if depth and rng.random() < 0.4 else None) for _ in range(rng.choice([1, 2, 3, 12]))]
    return kind, start, items


def list_page(node):
    kind, start, items = node
    head = {"ul": "<ul>", "ol": "<ol>", "reversed": "<ol reversed>", "start": f"<ol start={start}>"}[kind]
    body = "".join(f"<li{'' if v is None else f' value={v}'}>{t}{list_page(sub) if sub else ''}" for v, t, sub in items)
    return head + body + ("</ul>" if kind == "ul" else "</ol>")


def list_lines(node, indent, most):
    kind, start, items = node
    number = {"ol": 1, "start": start, "reversed": len(items)}.get(kind, 0)
    out = []
    for v, t, sub in items:
        number = number if v is None else v
        mark = "- " if kind == "ul" else f"{number}. "
        number += -1 if kind == "reversed" else 1
        out.append(indent + mark + t)
        if sub:
            out += list_lines(sub, indent + " " * len(mark) if len(indent) < most else indent, most)
    return out


def test_lists_of_lists():
    rng = random.Random(2)
    for _ in range(300):
        node = listing(rng, 4)
        for most in (40, 3):
            assert html_text.render(list_page(node), max_indent=most)[0] == "\n".join(list_lines(node, "", most)), list_page(node)


def table_lines(rows, max_cell, max_row):
    """rows of cells (lines): each column is as wide as its widest line of max_cell or fewer."""
    count = max(map(len, rows), default=0)
    wide = [max((len(x) for r in rows if c < len(r) for x in r[c] if len(x) <= max_cell), default=0) for c in range(count)]
    begins = [min(sum(w + 3 for w in wide[:c]), max_row) for c in range(count + 1)]
    out = []
    for r in rows:
        for k in range(max(map(len, r), default=0)):
            if any(k < len(c) for c in r):
                cells = [(c[k] if k < len(c) else "").ljust(max(0, begins[i + 1] - begins[i] - 3)) for i, c in enumerate(r)]
                out.append(" | ".join(cells).rstrip(" "))
    return out


def test_tables_of_lines_and_lists():
    rng = random.Random(3)
    for _ in range(300):
        rows, page = [], "<table>"
        for _ in range(rng.randint(1, 6)):
            row, page = [], page + "<tr>"
            for _ in range(rng.randint(1, 5)):
                if rng.random() < 0.3:
                    node = listing(rng, 1)
                    lines, body = list_lines(node, "", 40), list_page(node)
                else:
                    lines = ["y" * rng.choice([1, 3, 9, 70]) for _ in range(rng.randint(1, 3))]
                    body = "<br>".join(lines)
                row.append(lines)
                page += f"<td>{body}"
            rows.append(row)
        for max_cell, max_row in ((60, 400), (8, 400), (60, 20)):
            assert html_text.render(page + "</table>", max_cell=max_cell, max_row=max_row)[0] == "\n".join(table_lines(rows, max_cell, max_row)), page


def test_one_rule_for_tables_of_any_size():
    row = "<tr><td>a<td>b"
    for n in (1, 3000):
        lines = html_text.render(f"<table><tr><td>{'w' * 3000}<td>x" + row * n + f"<tr><td>{'z' * 60}<td>y</table>")[0].split("\n")
        assert lines[0] == "w" * 3000 + " | x" and set(lines[1:-1]) == {"a" + " " * 59 + " | b"} and len(lines) == n + 2


TAGS, MARKS = ("b", "i", "u"), (".p", ".q", "#r")


def styled_tree(rng, depth):
    tag, own = rng.choice(TAGS), {m for m in MARKS if rng.random() < 0.3}
    return tag, own, [styled_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []


def styled_page(node, path="0"):
    tag, own, children = node
    classes, ids = " ".join(m[1:] for m in sorted(own) if m[0] == "."), "".join(f" id={m[1:]}" for m in own if m[0] == "#")
    return f"<{tag}{f' class={chr(34)}{classes}{chr(34)}' if classes else ''}{ids}> {path} " + "".join(styled_page(c, f"{path}.{i}") for i, c in enumerate(children)) + f"</{tag}>"


def met(parts, way):
    """Whether the last element of way meets a selector: parts (must be a child, tag or *, marks) in order."""
    child, tag, marks = parts[-1]
    if not (way and tag in ("*", way[-1][0]) and marks <= way[-1][1]):
        return False
    if len(parts) == 1:
        return True
    return any(met(parts[:-1], way[:n]) for n in ([len(way) - 1] if child else range(len(way))))


def seen(node, rules, way=(), path="0", visible=True):
    way = (*way, node)
    found = []
    for order, (parts, prop, value, important) in enumerate(rules):
        if met(parts, way):
            weight = (sum("#" in m for _, _, of in parts for m in of), sum("." in m for _, _, of in parts for m in of), sum(t != "*" for _, t, _ in parts))
            found.append((important, weight, order, prop, value))
    shown = True
    for *_, prop, value in sorted(found):
        if prop == "display":
            shown = value != "none"
        else:
            visible = value == "visible"
    if not shown:
        return []
    return [path] * visible + [p for i, c in enumerate(node[2]) for p in seen(c, rules, way, f"{path}.{i}", visible)]


def test_selectors_of_any_length():
    rng = random.Random(4)
    for _ in range(400):
        rules, text = [], ""
        for _ in range(rng.randint(1, 6)):
            parts = [(bool(k) and rng.random() < 0.4, rng.choice([*TAGS, "*"]), {m for m in MARKS if rng.random() < 0.25}) for k in range(rng.randint(1, 3))]
            prop, value = rng.choice([("display", "none"), ("display", "inline"), ("visibility", "hidden"), ("visibility", "visible")])
            important = rng.random() < 0.2
            rules.append((parts, prop, value, important))
            text += " ".join(("> " if child else "") + ("" if tag == "*" and marks else tag) + "".join(sorted(marks)) for child, tag, marks in parts) + f" {{ {prop}: {value}{' !important' * important} }} "
        node = styled_tree(rng, 4)
        page = f"<style>{text}</style>" + styled_page(node)
        assert html_text.render(page)[0].split() == seen(node, rules), page


def test_many_rules_and_deep_pages_stay_fast():
    import time

    deep = "<style>" + "".join(f".a{k} .b{k} {{display:none}} " for k in range(3000)) + "</style>" + "".join(f"<i class='a{k}'>" for k in range(3000)) + "x" + "<b class=b7>no</b>" + "<u>" * 30_000 + "y"
    began = time.process_time()
    assert html_text.render(deep)[0] == "xy" and time.process_time() - began < 30


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a", "x", "y", 2)], "page_id long, html string, __r string, __rendered string, n_links int")
    out = html_text.extract_text(rows)
    assert out.columns == ["page_id", "__r", "__rendered", *html_text.COLUMNS] and tuple(out.first()) == (1, "x", "y", "a", None, 1, 0)
