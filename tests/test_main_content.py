"""The content of made-up pages: menus, frames and related links go, text, headings, lists, tables and code stay."""

from __future__ import annotations

import random

from quern.functions import html

WORDS = "river stone market bridge morning people trade winter summer road house garden paper letter engine water light north".split()
MENU = "".join(f'<li><a href="/m{k}">Menu entry {k}</a></li>' for k in range(8))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rng, marked):
    """(html, blocks that must be there, strings that must not): a page with a planted body."""
    body, want = [], []
    for s in range(rng.randint(2, 4)):
        head = f"Section {s} {rng.choice(WORDS)}"
        body.append(f"<h2>{head}</h2>")
        want.append(f"## {head}")
        for _ in range(rng.randint(1, 3)):
            p = sentence(rng, rng.randint(25, 60))
            body.append(f"<p>{p}</p>")
            want.append(p)
        if rng.random() < 0.5:
            items = [f"Item {k} {rng.choice(WORDS)}" for k in range(3)]
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            body.append(f"<p>{(last := sentence(rng, 30))}</p>")
            want += [*(f"- {i}" for i in items), last] if len(items) <= 3 else [last]
        if rng.random() < 0.5:
            body.append("<table><tr><th>Name</th><th>Size</th></tr><tr><td><p>alpha</p></td><td>12</td></tr></table>")
            want += ["|Name |Size |", "|alpha |12 |"]
    tag = ("main", "main") if marked else ("div class=c", "div")
    out = f"""<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul>{MENU}</ul></nav><div class=menu><ul>{MENU}</ul></div>
        <header><p>Site claim that is long enough to look like a paragraph of text, were it not in the page's head at all, is it.</p></header>
        <{tag[0]}>{''.join(body)}</{tag[1]}>
        <div><h3>Related</h3><ul>{''.join(f'<li><a href="/r{k}">Related page {k}</a></li>' for k in range(6))}</ul></div>
        <footer><p>Imprint, privacy, and a sentence of legal words that goes on for more than eighty characters so as to look like text.</p></footer></body></html>"""
    return out, want, ["Menu entry", "Related", "Site claim", "Imprint"]


def test_planted_bodies_are_found():
    rng, lost, extra, total = random.Random(3), 0, 0, 0
    for k in range(200):
        text, want, never = page(rng, marked=k % 2 == 0)
        got = html.to_markdown(text)
        lines = got.split("\n")
        lost += sum(w not in lines for w in want)
        total += len(want)
        extra += sum(n in got for n in never)
    assert extra == 0 and lost <= 0.01 * total, (lost, extra, total)


def test_short_pages_keep_all_but_the_frame():
    assert html.to_markdown("<nav><a href='/'>x</a></nav><h1>Head</h1><p>One line.</p><footer>foot</footer>") == "# Head\n\nOne line."
    assert html.to_markdown("<footer>only a foot</footer>") is None


def test_code_tables_and_nesting():
    long = "Long text that is certainly more than eighty characters of plain words, so that it counts as content. "
    doc = f"<article><header><h1>Title</h1></header><p>{long}</p><pre>def f():\n    return 1</pre><table><tr><td>a</td><td><b>b</b></td></tr></table><p>{long}</p></article>"
    assert html.to_markdown(doc) == f"# Title\n\n{long.strip()}\n\n```\ndef f():\n    return 1\n```\n\n|a |b |\n\n{long.strip()}"
    assert html.to_markdown(f"<p>{long}</p></div></nav></article><p>{long}</p>") == f"{long.strip()}\n\n{long.strip()}"  # ends without beginnings


def test_a_heading_of_a_list_of_links_goes():
    long = "Long text that is certainly more than eighty characters of plain words, so that it counts as content. "
    doc = f"<h1>Top</h1><p>{long}</p><h2>More</h2><ul>{MENU}</ul><h2>Text</h2><p>{long}</p>"
    assert html.to_markdown(doc) == f"# Top\n\n{long.strip()}\n\n## Text\n\n{long.strip()}"
