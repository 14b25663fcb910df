"""Pieces of HTML pages, found by a cursor that only moves forward.

A pattern such as `<th[^>]*>(.*?)</th>` looks from every opener to the end of the page when no closer follows. These
functions find the same pieces in one pass: each search starts where the last one ended, and a search that fails ends the
scan, as what it looked for isn't there for later openers either."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_struct = lambda **fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
_find = lambda pattern: re.compile(pattern, re.I)
#: The tags that hold rows, cells, headings, labelled rows and bold names.
ROW, CELL, HEADING = (_find(r"<tr"), _find(r"</tr>")), (_find(r"<td"), _find(r"</td>")), (_find(r"<h1"), _find(r"</h1>"))
LABEL, LABEL_END, BODY_END = _find(r"<th"), _find(r"</th>\s*<td"), _find(r"<tr\b|</table>")
BOLD = _find(r"<(?:b|strong)\b"), _find(r"</(?:b|strong)>")
DATA = _find(r'<td\s+data-text="([^"]*)"')
#: Labels of the rows whose sentences may speak of options; these rows need a closing cell.
OPTION_LABEL = _find(r"<th>\s*(?:walk options|walk notes|length|shortcuts?|options)\s*</th>\s*<td")
#: Where directions end.
HEADING_END, DONATE, DIVISION = _find(r"</h2>"), _find(r"<h4>\s*donate"), _find(r"<div")


def between(page: str, opening: re.Pattern, closing: re.Pattern, at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(start of the tag, start and end of what it holds, end of the closing tag) of each opening tag and the first closing one behind it."""
    while opened := opening.search(page, at):
        inside = page.find(">", opened.end()) + 1
        closed = closing.search(page, inside) if inside else None
        if not closed:
            return
        at = closed.end()
        yield opened.start(), inside, closed.start(), at


def labelled_rows(page: str) -> Iterator[tuple[str, str]]:
    """(label, body) of each heading cell that a cell follows; the body ends where the next row or the table does."""
    at = 0
    while opened := LABEL.search(page, at):
        label = page.find(">", opened.end()) + 1
        cell = LABEL_END.search(page, label) if label else None
        body = page.find(">", cell.end()) + 1 if cell else 0
        end = BODY_END.search(page, body) if body else None
        if not end:
            return
        at = end.start()
        yield page[label : cell.start()], page[body:at]


def instructions(page: str, marker: re.Pattern, until: re.Pattern) -> str | None:
    """What follows the heading whose id is marked, up to an appeal for donations (a heading, or a division with the word `until` in its tag) or the end."""
    marked = marker.search(page)
    inside = page.find(">", marked.end()) + 1 if marked else 0
    headed = HEADING_END.search(page, inside) if inside else None
    if not headed:
        return None
    start = headed.end()
    asked = DONATE.search(page, start)
    end = asked.start() if asked else len(page)
    word, gap = -1, -1  # the next word and the next end of a tag, looked for anew only when they are passed
    for tag in DIVISION.finditer(page, start, end):
        if word < tag.end():
            found = until.search(page, tag.end())
            if not found:
                break
            word = found.start()
        if gap < tag.end():
            gap = page.find(">", tag.end())
            gap = len(page) if gap < 0 else gap
        if word < gap:
            return page[start : tag.start()]
    return page[start:end]


def label_of(markup: str) -> str:
    """The text of a label in lower case: tags go, then entities are read."""
    closed = markup.rfind(">") + 1  # behind it no tag is closed
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", markup[:closed]) + markup[closed:]).split()).lower()


#: Fixed value: the most characters of a label that is remembered.
SHORT = 100


@lru_cache(4096)
def _short_label(markup: str) -> str:
    return label_of(markup)


#: Pages of an Arrow batch that are Python objects at once; a batch may hold 10,000.
PIECE = 64


def _in_pieces(run: Callable[[pa.Array], pa.Array], pages: pa.Array) -> pa.Array:
    return pa.concat_arrays([run(pages.slice(at, PIECE)) for at in range(0, max(len(pages), 1), PIECE)])


def _texts(rows: list[list[str]]) -> pa.Array:
    """An array of lists of texts."""
    return _lists(rows, pa.array([x for row in rows for x in row], pa.string()))


def _lists(rows: list, values: pa.Array) -> pa.Array:
    """values dealt to lists as long as rows; None becomes a null."""
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row or ()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([row is None for row in rows], pa.bool_()))


#: Fixed value: part of the id of the heading above a page's directions.
MARKER = "walk-instructions"


def page_parts(page: Column, marker: str = MARKER, until: str = "donate") -> Column:
    """struct<h1, directions, rows array<struct<label, body>>> of a route page, as markup but for the labels; rows without a label go. marker: part of the id of the directions' heading."""
    marked, word = _find(rf'id="[^"]*{re.escape(marker)}[^"]*"'), _find(re.escape(until))

    def rows_of(text: str) -> list[tuple[str, str]]:
        return [(label, body) for a, body in labelled_rows(text) if (label := _short_label(a) if len(a) <= SHORT else label_of(a))]

    def parts(pages: pa.Array) -> pa.Array:
        heads, ways, rows = [], [], []
        for x in pages:
            text = x.as_py() or ""
            head = next(between(text, *HEADING), None)
            heads.append(text[head[1] : head[2]] if head else None)
            ways.append(instructions(text, marked, word))
            rows.append(rows_of(text))
        labels, bodies = (pa.array([r[i] for row in rows for r in row], pa.string()) for i in (0, 1))
        of = _lists(rows, pa.StructArray.from_arrays([labels, bodies], ["label", "body"]))
        return pa.StructArray.from_arrays([pa.array(heads, pa.string()), pa.array(ways, pa.string()), of], ["h1", "directions", "rows"])

    @F.arrow_udf(_struct(h1=T.StringType(), directions=T.StringType(), rows=T.ArrayType(_struct(label=T.StringType(), body=T.StringType()))))
    def scan(pages: pa.Array) -> pa.Array:
        return _in_pieces(parts, pages)

    return scan(page)


def _index_rows(pages: pa.Array) -> pa.Array:
    rows, cells, data = [], [], []
    for x in pages:
        page = x.as_py()
        if page is None:
            rows.append(None)
            continue
        found = [page[a:b] for _, a, b, _ in between(page, *ROW)]
        rows.append(found)
        cells += [[row[a:b] for _, a, b, _ in between(row, *CELL)] for row in found]
        data += [DATA.findall(row) for row in found]
    return _lists(rows, pa.StructArray.from_arrays([_texts(cells), _texts(data)], ["cells", "data"]))


@F.arrow_udf(T.ArrayType(_struct(cells=_TEXTS, data=_TEXTS)))
def index_rows(pages: pa.Array) -> pa.Array:
    """The rows of an index page: their cells, as markup, and the sort keys that cells carry."""
    return _in_pieces(_index_rows, pages)


@F.arrow_udf(_TEXTS)
def option_bodies(pages: pa.Array) -> pa.Array:
    """Bodies of the rows that may speak of options."""
    closing = CELL[1]
    of_page = lambda page: [page[a:b] for _, a, b, _ in between(page, OPTION_LABEL, closing)]
    return pa.array([None if page is None else of_page(page) for page in (x.as_py() for x in pages)], pa.list_(pa.string()))


#: The markup looked at before and behind a bold name.
BEFORE, BEHIND = 120, 600


@F.arrow_udf(T.ArrayType(_struct(row=T.IntegerType(), name=T.StringType(), before=T.StringType(), behind=T.StringType())))
def bold_names(bodies: pa.Array) -> pa.Array:
    """The bold names of an array of bodies with the markup around each, numbered by body."""

    def of_page(rows: list) -> list[tuple]:
        return [(k, x[b:c], x[max(0, a - BEFORE) : a], x[d : d + BEHIND]) for k, x in enumerate(rows) for a, b, c, d in between(x or "", *BOLD)]

    found = [None if rows is None else of_page(rows) for rows in (x.as_py() for x in bodies)]
    column = lambda i, kind: pa.array([f[i] for page in found for f in page or ()], kind)
    columns = [column(0, pa.int32()), *(column(i, pa.string()) for i in (1, 2, 3))]
    return _lists(found, pa.StructArray.from_arrays(columns, ["row", "name", "before", "behind"]))
