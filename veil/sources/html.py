"""Markup to elements and blocks: the one place that needs a parser, run on Arrow batches of pages.

A page is read as events (tags and texts). What follows from the order of its tags alone, its shape, is worked out
once for all pages of that shape; everything after it is columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import spread

# Elements without text of their own, inline elements, elements without content, and what closes them.
SKIP = frozenset("SCRIPT STYLE NOSCRIPT TEMPLATE TEXTAREA SELECT OPTION IFRAME OBJECT EMBED HEAD TITLE META LINK".split())
INLINE = frozenset("A ABBR B BDI BDO CITE CODE DATA DFN EM FONT I INS DEL KBD LABEL MARK Q S SAMP SMALL SPAN STRONG SUB SUP TIME TT U VAR WBR BR IMG INPUT BUTTON".split())
VOID = frozenset("AREA BASE BR COL EMBED HR IMG INPUT LINK META SOURCE TRACK WBR".split())
CLOSES = {
    "LI": {"LI"}, "DT": {"DT", "DD"}, "DD": {"DT", "DD"}, "TR": {"TR", "TD", "TH"}, "TD": {"TD", "TH"}, "TH": {"TD", "TH"}, "OPTION": {"OPTION"},
    "TBODY": {"THEAD", "TBODY", "TR", "TD", "TH"}, "TFOOT": {"TBODY", "TR", "TD", "TH"},
}
LABEL_MOST = 40
# Input types that hold no text a user could have typed.
FIELD_TYPES_OUT = ["hidden", "password", "checkbox", "radio", "submit", "button", "reset", "file", "image", "range", "color"]
#: Steps of a CSS path by which elements of a page are told apart.
CSS_STEPS = 8
# Elements whose content the tokenizer reads by rules of its own; of the second it is plain text.
RAW, TEXT_ONLY = frozenset("SCRIPT STYLE XMP IFRAME NOEMBED NOFRAMES NOSCRIPT PLAINTEXT".split()), frozenset(["TEXTAREA", "TITLE"])
#: Tags, and events in all shapes, that a worker remembers.
TAGS_MOST, EVENTS_MOST = 20_000, 100_000

#: steps: tag and place of each element of ``path``; above: the attributes of each; alike: elements of the page with the same last CSS_STEPS steps.
#: row_index, col_index, column_label: of cells, by the head of their column.
ELEMENTS = (
    "page_id long, node_id int, parent_id int, path array<int>, tag string, attrs map<string,string>, nth int, nth_of_type int, of_type int,"
    " text_content string, is_inline boolean, block_node_id int, label string, label_source string, heading string,"
    " steps array<struct<tag: string, nth_of_type: int, of_type: int>>, above array<map<string,string>>, alike int, row_index int, col_index int, column_label string"
)
#: A block or a form field as scanning needs it: what its elements say travels with it, so that nothing is joined.
SCANNED = (
    "page_id long, block_id int, node_id int, is_input boolean, text string, segs array<struct<node_id: int, start: int, end: int, path: array<int>>>,"
    " near array<struct<node_id: int, attrs: map<string,string>, label: string, content: string, href: string>>"
)
BLOCKS = "page_id long, block_id int, node_id int, text string, segs array<struct<node_id: int, start: int, end: int, path: array<int>>>"

_LEAD = re.compile(r"([^.;:\n]{1,40})[:\s]*$").search
_PARTS = re.compile(r"(<[^<>]*>)").split
_START = re.compile(r'<([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z][A-Za-z0-9_-]*(?:="[^"&]*")?)*)(/?)>').fullmatch
_ATTRIBUTES = re.compile(r' ([A-Za-z][A-Za-z0-9_-]*)(?:="([^"]*)")?').findall
_END = re.compile(r"</([A-Za-z][A-Za-z0-9]*)>").fullmatch


class Events(HTMLParser):
    """codes: +TAG, /TAG (closed at once), -TAG, # (a text) and _ (a blank text); attrs of tags that open, and texts, in order."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.codes: list[str] = []
        self.attrs: list[dict] = []
        self.texts: list[str] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.codes.append("+" + tag.upper())
        self.attrs.append({k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.codes.append("/" + tag.upper())
        self.attrs.append({k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        self.codes.append("-" + tag.upper())

    def handle_data(self, data):
        self.codes.append("#" if data.strip() else "_")
        self.texts.append(data)


_TAGS: dict[str, tuple[str, dict | None] | None] = {}


def _plain_tag(part: str) -> tuple[str, dict | None] | None:
    """Code and attributes of a tag in its plainest spelling."""
    if part in _TAGS:
        return _TAGS[part]
    if m := _END(part):
        found = "-" + m[1].upper(), None
    elif (m := _START(part)) and m[1].upper() not in RAW and not (m[3] and m[1].upper() in TEXT_ONLY):
        found = ("/" if m[3] else "+") + m[1].upper(), {k.lower(): v for k, v in _ATTRIBUTES(m[2])}
    else:
        found = None
    if len(_TAGS) >= TAGS_MOST:
        _TAGS.clear()
    if len(part) < 200:
        _TAGS[part] = found
    return found


def _plain_events(markup: str) -> tuple[list[str], list[dict], list[str]] | None:
    """The events of plainly spelled markup, as the tokenizer gives them but many times faster; None: the tokenizer has to read it."""
    codes, attrs, texts = [], [], []
    parts = _PARTS(markup)
    last = len(parts) - 1
    for i, part in enumerate(parts):
        if i & 1:
            tag = _plain_tag(part)
            if tag is None:
                return None
            code, given = tag
            codes.append(code)
            if given is not None:
                attrs.append(given)
                if code[1:] in TEXT_ONLY and ("&" in parts[i + 1] or i + 2 > last or parts[i + 2].lower() != f"</{code[1:].lower()}>"):
                    return None
        elif part:
            if "<" in part or (i == last and "&" in part):
                return None
            if "&" in part:
                part = unescape(part)
            codes.append("_" if part.isspace() else "#")
            texts.append(part)
    return codes, attrs, texts


class Shape:
    """What the codes of a page's events say of its nodes, numbered as they open; 0 is the page. Implied end tags are put in.

    A kid is a node number, or ~k for the k-th text. ``shown`` are the texts outside scripts; a node's text is a run of them.
    """

    def __init__(self, codes: tuple[str, ...]):
        self.parent, self.tags, self.kids, self.blank = [-1], ["#ROOT"], [[]], []
        self.shown: list[int] = []
        self.first, self.end, secret = [0], [0], [False]
        is_open = [0]
        for code in codes:
            kind, tag, top = code[0], code[1:], is_open[-1]
            if not tag:
                self.kids[top].append(~len(self.blank))
                if not secret[top]:
                    self.shown.append(len(self.blank))
                    self.end[top] = len(self.shown)
                self.blank.append(kind == "_")
            elif kind == "-":
                for depth in range(len(is_open) - 1, 0, -1):
                    if self.tags[is_open[depth]] == tag:
                        del is_open[depth:]
                        break
            else:
                if tag not in INLINE and self.tags[top] == "P":
                    is_open.pop()
                shut = CLOSES.get(tag, ())
                while self.tags[is_open[-1]] in shut:
                    is_open.pop()
                top, number = is_open[-1], len(self.tags)
                self.kids[top].append(number)
                self.parent.append(top)
                self.tags.append(tag)
                self.kids.append([])
                self.first.append(len(self.shown))
                self.end.append(len(self.shown))
                secret.append(secret[top] or tag in ("SCRIPT", "STYLE"))
                if tag not in VOID and kind == "+":
                    is_open.append(number)
        for i in range(len(self.tags) - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])
        self.static: dict[str, pa.Array] = {}

    def near(self, *tags: str) -> list[int]:
        """For each node itself or the nearest above it of these tags, 0 if none is."""
        out = [0]
        for i in range(1, len(self.tags)):
            out.append(i if self.tags[i] in tags else out[self.parent[i]])
        return out

    @cached_property
    def paths(self) -> list[list[int]]:
        out: list[list[int]] = [[]]
        for i in range(1, len(self.tags)):
            out.append([*out[self.parent[i]], i])
        return out

    @cached_property
    def block_of(self) -> list[int]:
        out = [0]
        for i in range(1, len(self.tags)):
            out.append(out[self.parent[i]] if self.tags[i] in INLINE else i)
        return out

    @cached_property
    def places(self) -> tuple[list[int], list[int], list[int]]:
        """Place among the siblings, place among those of the same tag, and how many these are."""
        nth, of_tag, count = [0] * len(self.tags), [0] * len(self.tags), [0] * len(self.tags)
        for kids in self.kids:
            nodes = [c for c in kids if c > 0]
            seen: Counter = Counter()
            for k, c in enumerate(nodes):
                seen[self.tags[c]] += 1
                nth[c], of_tag[c] = k + 1, seen[self.tags[c]]
            for c in nodes:
                count[c] = seen[self.tags[c]]
        return nth, of_tag, count

    @cached_property
    def listed(self) -> list[int]:
        """Nodes that are elements of the page: not in its head or scripts."""
        out = [False]
        for i in range(1, len(self.tags)):
            out.append(self.tags[i] in ("HEAD", "SCRIPT", "STYLE") or out[self.parent[i]])
        return [i for i in range(1, len(out)) if not out[i]]

    @cached_property
    def headings(self) -> list[int]:
        """For each listed node the heading that it is or stands below, 0 if none is."""
        out, heading = [], 0
        for i in self.listed:
            heading = i if self.tags[i] in ("H1", "H2", "H3", "H4") else heading
            out.append(heading)
        return out

    @cached_property
    def blocks(self) -> list[tuple[int, list[tuple[int, int, bool]]]]:
        """(container, [(node, text, on a new line)]) of each block container that has text, in document order."""
        found: dict[int, list] = {}
        broken: set[int] = set()
        todo = [(0, iter(self.kids[0]))]
        while todo:
            i, rest = todo[-1]
            block = self.block_of[i]
            for c in rest:
                if c < 0:
                    if not self.blank[~c]:
                        found.setdefault(block, []).append((i, ~c, block in broken))
                        broken.discard(block)
                elif self.tags[c] == "BR":
                    broken.add(block)
                elif self.tags[c] not in SKIP:
                    todo.append((c, iter(self.kids[c])))
                    break
            else:
                todo.pop()
                if todo and self.tags[i] not in INLINE:
                    broken.add(self.block_of[self.parent[i]])
        return list(found.items())

    @cached_property
    def fields(self) -> list[int]:
        return [i for i, tag in enumerate(self.tags) if tag in ("INPUT", "TEXTAREA")]

    @cached_property
    def beside(self) -> list[tuple[list[int], int, int, int, int, int]]:
        """Of each node what may name it: heads of its row, head of its column, label around it, sibling before it,
        term before it, and the sibling before its parent if that has few kids; 0 for none."""
        td, cell, table, label = self.near("TD"), self.near("TD", "TABLE"), self.near("TABLE"), self.near("LABEL")
        nth = self.places[0]
        nodes = [[c for c in kids if c > 0] for kids in self.kids]
        before, term = [0] * len(self.tags), [0] * len(self.tags)
        for kids in nodes:
            last = dt = 0
            for c in kids:
                before[c], term[c] = last, dt
                last, dt = c, c if self.tags[c] == "DT" else dt
        heads: dict[int, list[int]] = {}
        for i, tag in enumerate(self.tags):
            if tag == "TR" and table[i]:
                heads.setdefault(table[i], nodes[i])
        in_row: dict[int, list[int]] = {}
        out: list[tuple[list[int], int, int, int, int, int]] = [([], 0, 0, 0, 0, 0)]
        for i in range(1, len(self.tags)):
            up, row_heads, column = self.parent[i], [], 0
            row = self.parent[td[i]] if td[i] else 0
            if row > 0 and self.tags[cell[i]] == "TD":
                if row not in in_row:
                    in_row[row] = [c for c in nodes[row] if self.tags[c] == "TH"]
                row_heads, head = in_row[row], heads.get(table[row], [])
                if nth[td[i]] <= len(head) and self.tags[head[nth[td[i]] - 1]] == "TH":
                    column = head[nth[td[i]] - 1]
            outer = before[up] if up > 0 and len(nodes[up]) <= 2 else 0
            out.append((row_heads, column, label[up], before[i], term[i] if self.tags[i] == "DD" else 0, outer))
        return out

    @cached_property
    def grid(self) -> list[tuple[int | None, int | None, int]]:
        """(row, column, head of the column) of each listed node that is a cell: rows of one parent count, and its first has the heads."""
        nth, of_tag, _ = self.places
        tops: dict[tuple[int, int], int] = {}
        for i in self.listed:
            row = self.parent[i]
            if self.tags[i] == "TH" and self.tags[row] == "TR" and of_tag[row] == 1:
                tops[self.parent[row], nth[i]] = i
        is_cell = lambda i: self.tags[i] in ("TD", "TH") and self.tags[self.parent[i]] == "TR"
        grid = lambda i: self.parent[self.parent[i]]
        return [(of_tag[self.parent[i]], nth[i], tops.get((grid(i), nth[i]), 0) if grid(i) > 0 else 0) if is_cell(i) else (None, None, 0) for i in self.listed]

    @cached_property
    def alike(self) -> list[int]:
        """For each listed node how many have the same tag and place in each of the last CSS_STEPS steps; a tag that stands alone has no place."""
        _, of_tag, count = self.places
        step = [(t, k if n > 1 else 0) for t, k, n in zip(self.tags, of_tag, count, strict=True)]
        ends = [tuple(step[p] for p in self.paths[i][-CSS_STEPS:]) for i in self.listed]
        seen = Counter(ends)
        return [seen[e] for e in ends]

    @cached_property
    def steps_at(self) -> np.ndarray:
        """The paths of the listed nodes, end to end."""
        return np.array([p for i in self.listed for p in self.paths[i]], np.int32)

    def column(self, name: str) -> pa.Array:
        """A column of the listed nodes that is the same for all pages of this shape."""
        if name not in self.static:
            self.static[name] = self._column(name)
        return self.static[name]

    def _column(self, name: str) -> pa.Array:
        of = lambda values, kind: pa.array([values[i] for i in self.listed], kind)
        nth, of_tag, count = self.places
        offsets = np.cumsum([0, *(len(self.paths[i]) for i in self.listed)], dtype=np.int32)
        if name == "node_id":
            return pa.array(self.listed, pa.int32())
        if name == "path":
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.steps_at))
        if name == "steps":
            at = self.steps_at
            parts = [pa.array(self.tags).take(pa.array(at)), pa.array(np.array(of_tag, np.int32)[at]), pa.array(np.array(count, np.int32)[at])]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["tag", "nth_of_type", "of_type"]))
        if name == "is_inline":
            return pa.array([self.tags[i] in INLINE for i in self.listed])
        if name in ("row_index", "col_index"):
            return pa.array([g[name == "col_index"] for g in self.grid], pa.int32())
        if name == "alike":
            return pa.array(self.alike, pa.int32())
        if name == "tag":
            return of(self.tags, pa.string())
        return of({"parent_id": self.parent, "nth": nth, "nth_of_type": of_tag, "of_type": count, "block_node_id": self.block_of}[name], pa.int32())


_SHAPES: dict[tuple[str, ...], Shape] = {}
_REMEMBERED = [0]


def _shape(codes: tuple[str, ...]) -> Shape:
    found = _SHAPES.get(codes)
    if found is None:
        found = Shape(codes)
        if len(codes) < EVENTS_MOST // 20:
            if _REMEMBERED[0] + len(codes) > EVENTS_MOST:
                _SHAPES.clear()
                _REMEMBERED[0] = 0
            _SHAPES[codes] = found
            _REMEMBERED[0] += len(codes)
    return found


class Page:
    """A page's shape with its attributes (of each node) and texts."""

    __slots__ = ("shape", "attrs", "texts", "shown", "by_id", "label_for", "_said")

    def __init__(self, markup: str):
        events = _plain_events(markup)
        if events is None:
            read = Events(markup)
            events = read.codes, read.attrs, read.texts
        codes, attrs, self.texts = events
        self.shape = _shape(tuple(codes))
        self.attrs = [{}, *attrs]
        hidden = len(self.shape.shown) < len(self.texts)
        self.shown = [self.texts[k] for k in self.shape.shown] if hidden else self.texts
        self._said: dict[int, str] = {}
        self.by_id: dict[str, int] = {}
        self.label_for: dict[str, int] = {}
        for i, a in enumerate(self.attrs):
            if a:
                if a.get("id"):
                    self.by_id[a["id"]] = i
                if self.shape.tags[i] == "LABEL" and a.get("for"):
                    self.label_for[a["for"]] = i

    def text(self, i: int) -> str:
        a, b = self.shape.first[i], self.shape.end[i]
        return self.shown[a] if b - a == 1 else "".join(self.shown[a:b])

    def said(self, i: int) -> str:
        """A node's text with single spaces."""
        if i not in self._said:
            self._said[i] = " ".join(self.text(i).split())
        return self._said[i]

    def href(self, i: int) -> str | None:
        """Where the nearest link around a node leads."""
        while i > 0:
            if self.shape.tags[i] == "A" and "href" in self.attrs[i]:
                return self.attrs[i]["href"]
            i = self.shape.parent[i]
        return None

    def blocks(self) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
        """(container, text, [(node, start, end)]) of each block container that has text, in document order."""
        for block, pieces in self.shape.blocks:
            out, segs, size, tail, last = [], [], 0, "", None
            for node, k, cut in pieces:
                piece = self.texts[k]
                if size and cut:
                    out.append("\n")
                    size += 1
                elif size and node != last:
                    a, b = tail[-1], piece[0]
                    if a.isalnum() and b.isalnum() and not (a.isdigit() and b.isdigit()):
                        out.append(" ")
                        size += 1
                segs.append((node, size, size + len(piece)))
                out.append(piece)
                size += len(piece)
                tail, last = piece, node
            yield block, "".join(out), segs

    def label(self, i: int) -> tuple[str | None, str | None]:
        """What names an element, and where that stands: the first of the cascade."""
        shape, said = self.shape, self.said
        row_heads, column, around, before, term, outer = shape.beside[i]
        for c in row_heads:
            if said(c):
                return said(c), "row"
        if column and said(column):
            return said(column), "column"
        attrs = self.attrs[i]
        if attrs:
            if attrs.get("id") in self.label_for:
                return said(self.label_for[attrs["id"]]), "label"
            named = [said(self.by_id[x]) for x in attrs.get("aria-labelledby", "").split() if x in self.by_id]
            if any(named):
                return " ".join(named), "aria"
            if attrs.get("aria-label"):
                return attrs["aria-label"], "aria"
        if around:
            return said(around), "label"
        if term:
            return said(term), "term"
        if before:
            near = said(before)
            if near and (near.endswith(":") or len(near) <= 30) and shape.tags[before] not in SKIP:
                return near, "sibling"
        if i > 0:
            # the last 60 characters that its parent has before it
            k = end = shape.first[i]
            size, least = 0, shape.first[shape.parent[i]]
            while k > least and size < 60:
                k -= 1
                size += len(self.shown[k])
            if size and (m := _LEAD("".join(self.shown[k:end])[-60:])) and m[1].strip():
                return m[1].strip(), "text"
        if outer and 0 < len(said(outer)) <= LABEL_MOST:
            return said(outer), "outer"
        return None, None


def _names(ddl: str) -> list[str]:
    """The names of columns that are set apart by commas outside brackets."""
    return [c.split()[0] for c in re.split(r",\s+(?=\w+ [a-z])", ddl)]


def _maps(rows: list[dict]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(a) for a in rows], out=offsets[1:])
    filled = [a for a in rows if a]
    keys, items = [k for a in filled for k in a], [v for a in filled for v in a.values()]
    return pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.string()), pa.array(items, pa.string()))


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
    for page, markup in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
        yield page, Page(markup)


_DYNAMIC = {
    "text_content": lambda p: [p.text(i) for i in p.shape.listed],
    "heading": lambda p: [p.said(h) if h else None for h in p.shape.headings],
    "column_label": lambda p: [p.text(head).strip(" ") if head else None for _, _, head in p.shape.grid],
}


def _elements(columns: list[str]):
    def table(ids: list[int], pages: list[Page]) -> pa.RecordBatch:
        sizes = [len(p.shape.listed) for p in pages]
        labels = [p.label(i) for p in pages for i in p.shape.listed] if {"label", "label_source"} & set(columns) else []
        if {"attrs", "above"} & set(columns):
            attrs = _maps([a for p in pages for a in p.attrs])
            starts = np.cumsum([0, *(len(p.attrs) for p in pages)])[:-1].tolist()

        def column(name: str) -> pa.Array:
            if name == "page_id":
                return pa.array(np.repeat(np.array(ids, np.int64), sizes))
            if name == "attrs":
                return attrs.take(pa.array(np.concatenate([np.array(p.shape.listed) + s for p, s in zip(pages, starts, strict=True)])))
            if name == "above":
                at = attrs.take(pa.array(np.concatenate([p.shape.steps_at + s for p, s in zip(pages, starts, strict=True)])))
                return _lists([len(p.shape.paths[i]) for p in pages for i in p.shape.listed], at)
            if name in ("label", "label_source"):
                return pa.array([x[name == "label_source"] for x in labels], pa.string())
            if name in _DYNAMIC:
                return pa.array([x for p in pages for x in _DYNAMIC[name](p)], pa.string())
            return pa.concat_arrays([p.shape.column(name) for p in pages])

        return pa.RecordBatch.from_arrays([column(c) for c in columns], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pages, size = [], [], 0
            for number, page in _pages(batch):
                if page.shape.listed:
                    ids.append(number)
                    pages.append(page)
                    size += len(page.shape.listed)
                if size > 4096:
                    yield table(ids, pages)
                    ids, pages, size = [], [], 0
            if pages:
                yield table(ids, pages)

    return run


class _Segs:
    """Lists of text nodes (node, start, end, path), gathered as flat columns."""

    def __init__(self):
        self.sizes, self.node, self.start, self.end, self.depth, self.path = [], [], [], [], [], []

    def add(self, page: Page, segs: list[tuple[int, int, int]]) -> None:
        self.sizes.append(len(segs))
        for node, start, end in segs:
            self.node.append(node)
            self.start.append(start)
            self.end.append(end)
            path = page.shape.paths[node]
            self.depth.append(len(path))
            self.path += path

    def array(self) -> pa.Array:
        flat = [pa.array(x, pa.int32()) for x in (self.node, self.start, self.end)]
        paths = _lists(self.depth, pa.array(self.path, pa.int32()))
        return _lists(self.sizes, pa.StructArray.from_arrays([*flat, paths], ["node_id", "start", "end", "path"]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple], segs: _Segs) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        flat = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*flat, segs.array()], _names(BLOCKS))

    for batch in batches:
        rows, segs = [], _Segs()
        for number, page in _pages(batch):
            for k, (block, text, listed) in enumerate(page.blocks()):
                rows.append((number, k, block, text))
                segs.add(page, listed)
            if len(rows) > 4096:
                yield table(rows, segs)
                rows, segs = [], _Segs()
        if rows:
            yield table(rows, segs)


def _scanned(digits: bool, blocks: bool = True, fields: bool = True):
    """Blocks and form fields of each page; digits: only those with four digits, which the built-in detectors need."""
    enough = re.compile("(?:[0-9][^0-9]*){4}").search

    def table(rows: list[tuple], segs: _Segs, sizes: list[int], near: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        flat = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        node, attrs, label, content, href = zip(*near, strict=True)
        told = [pa.array(node, pa.int32()), _maps(list(attrs)), *(pa.array(x, pa.string()) for x in (label, content, href))]
        listed = _lists(sizes, pa.StructArray.from_arrays(told, ["node_id", "attrs", "label", "content", "href"]))
        return pa.RecordBatch.from_arrays([*flat, segs.array(), listed], ["page_id", "block_id", "node_id", "is_input", "text", "segs", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, segs, sizes, near = [], _Segs(), [], []
            for number, page in _pages(batch):
                said = lambda i, content, p=page: (i, p.attrs[i], p.label(i)[0], content, p.href(i))
                for k, (block, text, listed) in enumerate(page.blocks() if blocks else ()):
                    if digits and not enough(text):
                        continue
                    inner = sorted({n for node, _, _ in listed for n in page.shape.paths[node] if n > block})
                    rows.append((number, k, block, False, text))
                    segs.add(page, listed)
                    sizes.append(1 + len(inner))
                    near += [said(block, None), *(said(n, page.text(n)) for n in inner)]
                for i in page.shape.fields if fields else ():
                    attrs, typed = page.attrs[i], page.shape.tags[i] == "TEXTAREA"
                    if typed or attrs.get("type", "text").lower() not in FIELD_TYPES_OUT:
                        value = page.text(i) if typed else attrs.get("value", "")
                        if enough(value):
                            rows.append((number, -1, i, True, value))
                            segs.add(page, [])
                            sizes.append(1)
                            near.append(said(i, None))
                if len(rows) > 4096:
                    yield table(rows, segs, sizes, near)
                    rows, segs, sizes, near = [], _Segs(), [], []
            if rows:
                yield table(rows, segs, sizes, near)

    return run


def _given(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))


def scanned(pages: DataFrame, digits: bool = True, blocks: bool = True, fields: bool = True) -> DataFrame:
    """pages (page_id, html) to SCANNED, by one parse: blocks, form fields or both."""
    given = _given(pages)
    # the blocks of few pages are dealt out again, so that one large page does not keep a single core busy
    dealt = spread(given)
    rows = dealt.mapInArrow(_scanned(digits, blocks, fields), SCANNED)
    return rows if dealt is given else rows.repartition(given.sparkSession.sparkContext.defaultParallelism)


def html_elements(pages: DataFrame, *columns: str) -> DataFrame:
    """pages (page_id, html) to ELEMENTS, in document order; columns: only these of them are made."""
    kinds = dict(zip(_names(ELEMENTS), re.split(r",\s+(?=\w+ [a-z])", ELEMENTS), strict=True))
    wanted = list(columns or kinds)
    return _given(pages).mapInArrow(_elements(wanted), ", ".join(kinds[c] for c in wanted))


def block_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) to BLOCKS: the text of each block container, with the text nodes it is made of."""
    return _given(pages).mapInArrow(_blocks, BLOCKS)
