"""Visible text by brute force, closed details, and pages made to be slow."""

import random
import re
import time
from collections import Counter

import pytest

from tidemark.llm import html_render
from tidemark.llm.html_render import numbered, render

FLOW = "div p span b i ul ol blockquote section h2 pre a details table".split()
HIDES = ("hidden", "style='display:none'", "style='color:red; display: none !important'", 'HIDDEN=""')
HIDDEN_TAGS = ("script", "style", "template", "noscript", "video")


def grow(rng, words, depth, shown):
    """(markup, words shown) of random well-formed content."""
    out, seen = [], []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth == 0:
            word = f"w{next(words)}"
            out.append(f" {word} ")
            seen += [word] * shown
        elif kind < 0.55:
            tag = rng.choice(HIDDEN_TAGS)
            out.append(f"<{tag}>h{next(words)}</{tag}>")
        else:
            tag = rng.choice(FLOW)
            hide = rng.random() < 0.15
            attrs = f" {rng.choice(HIDES)}" if hide else rng.choice(["", " class='opener' data-style='--display:none'"])
            now = shown and not hide
            if tag in ("ul", "ol"):
                parts = [grow(rng, words, depth - 1, now) for _ in range(rng.randrange(3))]
                inner, found = "".join(f"<li>{m}</li>" for m, _ in parts), [w for _, f in parts for w in f]
            elif tag == "table":
                rows = [[grow(rng, words, depth - 1, now) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 3))]
                span = lambda: rng.choice(["", "", " colspan=2", " rowspan=3", " colspan=1000"])
                inner = "".join("<tr>" + "".join(f"<td{span()}>{m}</td>" for m, _ in r) + "</tr>" for r in rows)
                found = [w for r in rows for _, f in r for w in f]
            elif tag == "details":
                (a, fa), (b, fb) = grow(rng, words, 0, now), grow(rng, words, depth - 1, now)
                open_ = rng.random() < 0.5
                inner, found = f"<summary>{a}</summary>{b}", fa + (fb if open_ else [])
                attrs += " open" * open_
            else:
                inner, found = grow(rng, words, depth - 1, now) if tag not in ("p", "h2") else grow(rng, words, 0, now)
            out.append(f"<{tag}{attrs}>{inner}</{tag}>")
            seen += found
    return "".join(out), seen


@pytest.mark.parametrize("seed", range(60))
def test_all_visible_text_once(seed):
    rng = random.Random(seed)
    markup, want = grow(rng, iter(range(10**6)), 5, True)
    assert Counter(render(f"<html><head><title>t</title></head><body>{markup}</body>").split()) - Counter(["-", *(f"{i}." for i in range(1, 9))] * 99) == Counter(want)


@pytest.mark.parametrize("seed", range(60))
def test_tag_soup_keeps_every_word(seed):
    """Tags in any order: whatever the tree, no element here is hidden, so every word shows once."""
    rng = random.Random(seed)
    tags = "div p b table tr td th tbody thead caption form li ul span colgroup col select option h1 dl dd center".split()
    parts, want = [], []
    for k in range(120):
        if rng.random() < 0.4:
            parts.append(f" w{k} ")
            want.append(f"w{k}")
        else:
            parts.append(rng.choice(["<%s>", "</%s>"]) % rng.choice(tags))
    assert sorted(w for w in render("".join(parts)).split() if w != "-") == sorted(want)


def test_closed_details_and_dialogs():
    assert render("<details><summary>more</summary>body</details><details open><summary>s</summary>shown</details>") == "more\ns\nshown"
    assert render("<dialog class=opener>a</dialog><dialog open>b</dialog><p style='--display:none'>c</p>") == "b\n\nc"


def test_wide_tables_are_not_padded():
    page = "<table><tr><td>" + "x" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(render(page)) < 2 * len(page)
    assert render("<table><tr><td colspan=1000>all<tr><td>a<td>b</table>") == "all\na  b"
    tall = "<table><tr><td rowspan=300>r<td>x" + "<tr><td>y" * 299 + "<tr><td>z</table>"
    assert render(tall).split("\n")[298:] == ["   y", "   y", "z"]


@pytest.mark.parametrize("seed", range(40))
def test_cells_wrap_to_their_columns(seed):
    """Words name their row and column: each lies within its column, rows follow one another, and a cell reads in order."""
    rng = random.Random(seed)
    columns, rows = rng.randrange(2, 7), rng.randrange(1, 6)
    cells = [[[f"r{r}c{c}w{k}" for k in range(rng.choice([0, 1, 3, 60, 200]))] for c in range(columns)] for r in range(rows)]
    cells[0] = [[f"r0c{c}w{k}" for k in range(70)] for c in range(columns)]  # wider than a line, no column empty
    lines = render("<table>" + "".join("<tr>" + "".join(f"<td>{' '.join(w)}" for w in row) for row in cells) + "</table>").split("\n")
    assert max(map(len, lines)) <= html_render.WIDTH
    found = [(n, m.start(), m.end(), *map(int, re.findall(r"\d+", m[0]))) for n, line in enumerate(lines) for m in re.finditer(r"\S+", line)]
    assert sorted(x[3:] for x in found) == sorted((r, c, k) for r, row in enumerate(cells) for c, w in enumerate(row) for k in range(len(w)))
    left = [min(a for _, a, _, _, c, _ in found if c == col) for col in range(columns)] + [html_render.WIDTH + 2]
    assert all(left[c] <= a and b + 2 <= left[c + 1] for _, a, b, _, c, _ in found)
    firsts = {(n, c): a for n, a, _, _, c, _ in reversed(found)}  # the first word of each line of a cell
    assert all(a == left[c] for (_, c), a in firsts.items())
    for r, row in enumerate(cells):
        for c, w in enumerate(row):
            assert [k for _, _, _, rr, cc, k in found if (rr, cc) == (r, c)] == list(range(len(w)))
        assert max((n for n, _, _, rr, *_ in found if rr == r), default=-1) < min((n for n, _, _, rr, *_ in found if rr > r), default=10**9)


def test_one_cell_of_prose_leaves_the_table_aligned():
    prose = " ".join(f"word{k}" for k in range(60))
    lines = render(f"<table><tr><td>a<td>b<tr><td>{prose}<td>x<tr><td>c<td>d</table>").split("\n")
    at = lines[0].index("b")
    assert lines[0] == "a".ljust(at) + "b" and lines[1][at] == "x" and lines[-1] == "c".ljust(at) + "d"
    assert " ".join(line[:at].strip() for line in lines[1:-1]) == prose


def test_what_is_not_wrapped():
    code = "x = 1  # " + "y" * 30 + "   " + "z " * 120
    lines = render(f"<table><tr><td>a<td><pre>{code}</pre><tr><td>c<td>d</table>").split("\n")
    assert code.rstrip() in "\n".join(lines) and lines[-1] == "c" + " " * (len(lines[-1]) - 2) + "d"
    inner = "<table>" + "<tr><td>" + "k " * 50 + "<td>v</table>"
    lines = render(f"<table><tr><td>{'p ' * 200}<td>{inner}</table>").split("\n")
    assert any(("k " * 50 + " v") in line for line in lines)
    assert render(f"<table><tr><td>{'q ' * 300}</table>") == ("q " * 300).strip()  # one column needs no share
    long = "u" * 300
    lines = render(f"<table><tr><td>{long} after<td>b<tr><td>c<td>d</table>").split("\n")
    assert lines[0] == long and lines[1].split() == ["b"] and lines[2] == "after" and lines[1].index("b") == lines[3].index("d")


def test_more_columns_than_a_line_holds():
    head = "".join(f"<td>head{c}" for c in range(100))
    lines = render(f"<table><tr>{head}<tr>{''.join(f'<td>v{c}' for c in range(100))}</table>").split("\n")
    half = len(lines) // 2
    assert max(map(len, lines)) <= html_render.WIDTH and len(lines) == 2 * half
    for a, b in zip(lines[:half], lines[half:], strict=True):
        assert [m.start() for m in re.finditer(r"\S+", a)] == [m.start() for m in re.finditer(r"\S+", b)]
    assert " ".join(lines).split() == [f"head{c}" for c in range(100)] + [f"v{c}" for c in range(100)]


@pytest.mark.parametrize("seed", range(30))
def test_spans_of_wide_tables_keep_every_word(seed):
    rng = random.Random(seed)
    page, want = ["<table>"], []
    for r in range(8):
        page.append("<tr>")
        for c in range(rng.randrange(1, 12)):
            words = [f"r{r}c{c}w{k}" + "l" * rng.choice([0, 0, 0, 50, 250]) for k in range(rng.choice([0, 1, 2, 40]))]
            page.append(f"<td colspan={rng.choice([1, 1, 2, 5])} rowspan={rng.choice([1, 1, 3])}>{' '.join(words)}")
            want += words
    assert sorted(render("".join(page)).split()) == sorted(want)


SLOW = {
    "a cell of a megabyte": "<table><tr><td>" + "word " * 150_000 + "<td>b<tr><td>" + "w" * 300_000 + "<td>c",
    "indented prose": "<table><tr><td><ul><li>" + "word " * 150_000 + "</ul><td>b<td>c",
    "prose in nested tables": ("<table><tr><td>a<td>" + "word " * 2_000) * 80,
    "many wide columns": "<table>" + ("<tr>" + "<td>some words to wrap in a cell" * 200) * 150,
    "unclosed tags": "<a " * 300_000,
    "unclosed quotes": '<x y="' * 150_000,
    "closed after open quotes": "<a b=\"" + "<i>x" * 200_000,
    "deep blocks": "<div>" * 150_000 + "deep",
    "deep quotes": "<blockquote>a" * 60_000,
    "deep lists": "<ul><li>a" * 100_000,
    "deep tables": "<table><tr><td>a" * 50_000,
    "paragraphs behind a cell": "<p><table><tr><td>" + "<div>x" * 150_000,
    "row spans": "<table><tr>" + "<td rowspan=65534>a" * 900 + "<tr><td>b" * 80_000,
    "column spans": "<table><tr>" + "<td colspan=1000 rowspan=65534>a" * 20_000 + "<tr><td>b" * 30_000,
    "declarations": "<!" * 400_000,
    "comments": "<!--" * 250_000,
    "fostered": "<table>" + "<b>x" * 200_000,
    "options": "<select>" + "<option>a" * 100_000,
}


@pytest.mark.parametrize("name", sorted(SLOW))
def test_pages_of_a_megabyte_take_seconds(name):
    began = time.monotonic()
    out = render(SLOW[name])
    assert time.monotonic() - began < 20 and len(out) < 6 * len(SLOW[name])


def test_numbers_of_lists():
    items = "".join(f"<li>{c}" for c in "xyz")
    assert render(f"<ol type=a start=26>{items}</ol>") == "z. x\naa. y\nab. z"
    assert render(f"<ol type=I start=8>{items}</ol>") == "VIII. x\nIX. y\nX. z"
    assert render(f"<ol reversed>{items}</ol>") == "3. x\n2. y\n1. z"
    assert render(f"<ol reversed start=1 type=i>{items}</ol>") == "i. x\n0. y\n-1. z"
    assert render("<ol><li>x<li value=7>y<li>z<li value=no>w</ol>") == "1. x\n7. y\n8. z\n9. w"
    assert render(f"<ul type=a>{items}</ul>") == "- x\n- y\n- z"
    assert [numbered(n, "A") for n in (1, 26, 27, 702, 703, 0)] == ["A", "Z", "AA", "ZZ", "AAA", "0"]
    assert [numbered(n, "i") for n in (1, 4, 9, 1994, 3999, 4000)] == ["i", "iv", "ix", "mcmxciv", "mmmcmxcix", "4000"]


def test_buttons_and_ruby():
    assert render("a <input type=submit value='Send &amp; go'> b <input type=hidden value=h> <input value=typed>") == "a Send & go b"
    assert render("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"
    assert render("<p style='visibility:hidden'><input type=button value=x>") == ""
