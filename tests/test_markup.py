"""Pieces of pages against the patterns that describe them, and in time that grows with the page."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from walkspark.functions import markup
from walkspark.functions import text as tx
from walkspark.operators import pages

ROW_BLOCK = re.compile(r"<th[^>]*>\s*(.*?)\s*</th>\s*<td[^>]*>(.*?)(?=<tr\b|</table>)", re.I | re.S)
CELLS = re.compile(r"<td[^>]*>(.*?)</td>", re.I | re.S)
ROWS = re.compile(r"<tr[^>]*>(.*?)</tr>", re.I | re.S)
BOLDS = re.compile(r"<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", re.I | re.S)
DIRECTIONS = re.compile(r'id="[^"]*walk-instructions[^"]*"[^>]*>.*?</h2>(.*?)(?=<h4>\s*Donate|<div[^>]*donate|$)', re.I | re.S)
PIECES = ["<th>", "<TH x='1'>", "</th>", "</TH>\n ", "<td>", "<td class=a>", "</td>", "<tr>", "</tr>", "<TR ", "</table>", ">", "<", "Length", " ", "<thead>", "<b>", "<br>", "</b>", "<strong>", "</strong>", "<h2", '<h2 id="my-walk-instructions-title">', "</h2>", "<div", "<div class='donate'>", "<h4> Donate", "donate", "é"]


def test_pieces_equal_their_patterns():
    rng = random.Random(61)
    for _ in range(6000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40)))
        assert [(a.strip(), b) for a, b in markup.labelled_rows(page)] == [(a.strip(), b) for a, b in ROW_BLOCK.findall(page)]
        for pair, pattern in ((markup.ROW, ROWS), (markup.CELL, CELLS), (markup.BOLD, BOLDS)):
            assert [page[a:b] for _, a, b, _ in markup.between(page, *pair)] == pattern.findall(page)
        found = DIRECTIONS.search(page)
        marked, word = re.compile(r'id="[^"]*walk-instructions[^"]*"', re.I), re.compile("donate", re.I)
        assert (markup.instructions(page, marked, word) or "").rstrip("\n") == (found[1] if found else "").rstrip("\n")


OPENERS = ["<th>", "<th", "<th></th>", "<th></th><td", "<th></th> <td>", "<tr>", "<tr", "<td>", "<td", '<td data-text="', "<b>", "<b", "<h1>", "<h1", '<h2 id="walk-instructions">', '<h2 id="walk-instructions"></h2><div', "<div", "<p", "<", "<br ", "<th>length</th><td>"]


@pytest.mark.parametrize("opener", OPENERS)
def test_scans_are_linear(opener):
    page = opener * (1_000_000 // len(opener))
    began = time.perf_counter()
    list(markup.labelled_rows(page))
    for pair in (markup.ROW, markup.CELL, markup.BOLD, markup.HEADING, (markup.OPTION_LABEL, markup.CELL[1])):
        list(markup.between(page, *pair))
    markup.instructions(page, re.compile(r'id="[^"]*walk-instructions[^"]*"', re.I), re.compile("donate", re.I))
    markup.instructions('<h2 id="walk-instructions"></h2>' + page, re.compile(r'id="[^"]*walk-instructions[^"]*"', re.I), re.compile("donate", re.I))
    assert time.perf_counter() - began < 2


def test_text_of_large_markup_is_linear(spark):
    rows = [(x * (1_000_000 // len(x)),) for x in ("<", "<p", "<br ", "<li <", "a < b ")]
    df = spark.createDataFrame(rows, "t string")
    df.limit(1).select(tx.paragraphs_of("t")).collect()
    began = time.perf_counter()
    df.select(F.length(tx.text_of("t")), F.size(tx.paragraphs_of("t"))).collect()
    assert time.perf_counter() - began < 15


def test_pages_of_large_markup(spark):
    made = [x * (300_000 // len(x)) for x in OPENERS]
    raw = spark.createDataFrame([("s", f"w{i}", p) for i, p in enumerate(made)] + [("s", "good", "<h1>Good Walk</h1><table><tr><th>Length</th><td>8 km, 2 hours</td></tr></table>"), ("s", "none", None)], "source string, slug string, page string")
    pages.parse_pages(raw.limit(1)).collect()
    began = time.perf_counter()
    got = {r["slug"]: r for r in pages.parse_pages(raw).collect()}
    assert time.perf_counter() - began < 60
    assert len(got) == len(made) + 2 and got["good"]["h1"] == "Good Walk" and got["good"]["length_items"] == ["8 km, 2 hours"] and got["none"]["length_items"] is None


def test_tags_without_an_end_are_text(spark):
    one = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f("t")).first()[0]
    assert one("a <b>c</b> < d <e", tx.text_of) == "a c < d <e" and one("x<p>y<li z", tx.paragraphs_of) == ["x", "y<li z"] and one(None, tx.text_of) is None and one("<>a", tx.text_of) == "<>a"


def test_directions_of_any_marker(spark):
    page = '<h2 id="my-route-title">Walk Directions</h2><p>One.</p><p>Two.</p><DIV class="x-donate">Give</DIV><p>Three</p>'
    df = spark.createDataFrame([(page,), (page.replace("my-route", "a-walk-instructions"),), ("no",), (None,)], "p string")
    assert [r[0] for r in df.select(pages.directions(F.col("p"), marker="my-route")).collect()] == ["One.\nTwo.", None, None, None]
    assert [r[0] for r in df.select(pages.directions(F.col("p"))).collect()] == [None, "One.\nTwo.", None, None]


def test_two_sources_with_one_slug(spark):
    page = lambda t, km: f'<h1>{t} Walk</h1><table><tr><th>Length</th><td>{km} km</td></tr><tr><th>Walk options</th><td><li>A shorter walk of about {km - 1} km by the lake</td></tr><tr><th>Tea</th><td><b>The Inn {t}</b></td></tr></table>'
    row = lambda t: f'<tr><td>R</td><td></td><td></td><td><a href="/walk/a/">{t}</a></td><td>9</td><td>3</td><td>10</td><td>d</td><td></td></tr>'
    refs = pages.listing(spark.createDataFrame([("s1", row("One")), ("s2", row("Two"))], "source string, page string"))
    raw = spark.createDataFrame([("s1", "a", page("One", 8)), ("s2", "a", page("Two", 12))], "source string, slug string, page string")
    walks, variations, food = pages.parse_walks(refs, raw)
    assert sorted((r["source"], r["title"], r["published_distance_km"]) for r in walks.collect()) == [("s1", "One", 8.0), ("s2", "Two", 12.0)]
    assert sorted((r["source"], r["position"], r["distance_km"]) for r in variations.collect()) == [("s1", 0, 7.0), ("s2", 0, 11.0)]
    assert sorted((r["source"], r["name"]) for r in food.collect()) == [("s1", "The Inn One"), ("s2", "The Inn Two")]
