"""Pages as rows of their element trees.

``element_rows`` reads each page once, tag by tag, with a stack of what is open, and gives a row for every start, end and piece of text: nested sets,
in which an element reaches from its own row (``pos``) to its end (``last``), so that to lie inside of it is to have a ``pos`` between the two.
Everything else about the tree is windows and aggregates over these rows, such as ``covered``.

The rules of the tree are those of the HTML standard, as far as they decide what encloses what:

* void elements hold nothing; script and style hold characters up to their own end tag, or the page's end;
* an end tag ends the nearest open element of its name, and all that is open inside; one without such an element, or across a table cell, is ignored;
* li, dt, dd, options, cells, rows and groups of rows end those before them, blocks end an open paragraph, links an open link;
* what is open at the end of the page ends there; ``closed`` tells elements with an end tag of their own;
* elements more than ``DEEPEST`` deep hold nothing (browsers have the same bound).

Each step takes a bounded number of look-ups, so time is linear in the page, whatever is left open in it.
"""

from __future__ import annotations

import gc
import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from operator import sub

import pyarrow as pa
from pyspark.sql import DataFrame

DEEPEST = 512
#: Rows that are sent back together.
BATCH_ROWS = 20_000

ROW_SCHEMA = "pos int, kind string, name string, raw string, text string, attrs map<string,string>, node int, parent int, grand int, last int, closed boolean, boxes array<struct<node:int,mark:string>>, in_main boolean, in_link boolean, in_heading boolean"
#: What is counted inside of each element: characters (spaces collapsed, those in links, commas among them), pieces of text with more than permalink signs or with
#: back-ticks, links, main parts, navigation, headings, images, blocks, and characters of markup.
COUNTS = ("chars", "link_chars", "commas", "solid", "ticks", "links", "mains", "navs", "titles", "images", "parts", "size")
ROW_SCHEMA += "".join(f", {c} int" for c in COUNTS)

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHARACTERS = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOUNDS = frozenset("table td th caption button object template".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption".split())
BOUNDS_OF_TEXT = BOUNDS - TABLE_PARTS
PARTS = BLOCKS | {"li", "dt", "dd"}
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "a": ({"a"}, set()),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "body": ({"head"}, set()),
    **{n: ({"tbody", "thead", "tfoot", "caption"}, {"table"}) for n in ("tbody", "thead", "tfoot")},
}
#: The same with all bounds, by whether there is a table: of parts of tables only their own.
ENDS_WITHIN = {inside: {n: (names, stops if n in TABLE_PARTS else stops | (BOUNDS if inside else BOUNDS_OF_TEXT)) for n, (names, stops) in ENDS.items()} for inside in (True, False)}
OWN_BOUNDS = {inside: {n: (BOUNDS if inside else BOUNDS_OF_TEXT) - {n} for n in BOUNDS} for inside in (True, False)}

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I | re.A) for name in CHARACTERS}
_ATTRIBUTE = re.compile(r"([^\s=/>\"'<]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
# Commas of several scripts, and what is more than a permalink's sign.
COMMAS = ",，、؛"
SOLID = re.compile("[^\\s#¶§¤🔗\u200b]")
SIZE = COUNTS.index("size")
# Words of classes that make a box of a note.
NOTE_CLASS = re.compile(r"(?i)(?:^|\s)(?:alert|markdown-alert|admonition\S*|\S*callout\S*|custom-block)(?:\s|$)")


_WHOLE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[a-zA-Z][a-zA-Z0-9]*);")


def whole_references(text: str) -> str:
    """Character references with their semicolon decoded; what lacks it, as in ``&amp`` or ``?a=1&copy=2``, stays as it stands."""
    return _WHOLE.sub(lambda m: references.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in references.entities.html5 else m[0], text)


_OPEN = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[a-zA-Z][a-zA-Z0-9]*);?")


def _whole_or_ampersand(m: re.Match) -> str:
    found = m[0]
    if found[-1] == ";":
        if found[1] == "#":
            return references.unescape(found)
        if (named := references.entities.html5.get(found[1:])) is not None:
            return named
    return "&" + found[4:] if found.startswith("&amp") else found


def whole_references_and_ampersands(text: str) -> str:
    """The same with ``&amp`` decoded without its semicolon too, whatever follows; so the SQL of the tree queries reads texts that were cut inside of a reference."""
    return _OPEN.sub(_whole_or_ampersand, text)


def attributes(text: str, decode=references.unescape) -> list[tuple[str, str]]:
    """The attributes of a start tag, names in lower case, values decoded; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        value = double or single or bare
        found.setdefault(name.lower(), decode(value) if "&" in value else value)
    return list(found.items())


class Tree:
    """One page's rows, as a list for each column."""

    def __init__(self, decode=references.unescape):
        self.decode = decode
        self.rows: list[list] = []
        self.open: list[tuple[str, int]] = []  # name and pos
        self.at: dict[str, list[int]] = defaultdict(list)  # depths at which a name is open
        self.ignored: dict[str, int] = defaultdict(int)
        self.boxes: list[tuple[int, str]] = []
        self.shared: tuple = ()
        self.items: list[int] = []  # next number of each open list; None for lists without numbers
        self.count = [0] * len(COUNTS)
        self.begun: list[tuple] = []  # the counts when each open element began
        self.ended: set[str] = set()  # page and body, whose end tags end nothing yet
        self.mains = self.links = self.titles = 0  # open main parts, links, headings

    def add(self, kind, name, raw, text, attrs, node=None, closed=None) -> int:
        pos = len(self.rows)
        parent = self.open[-1][1] if self.open else -1
        grand = self.open[-2][1] if len(self.open) > 1 else -1
        boxes = self.shared if kind in ("text", "void") else ()
        self.rows.append([pos, kind, name, raw, text, attrs, pos if node is None else node, parent, grand, pos, closed, boxes, self.mains > 0, self.links > 0, self.titles > 0, None])
        if raw and (kind != "end" or closed):
            self.count[SIZE] += len(raw)
        return pos

    def counted(self, name: str, known: dict) -> None:
        """Count a start tag for all elements around it."""
        count = self.count
        if name in PARTS:
            count[10] += 1
        if name == "a" and "href" in known:
            count[5] += 1
        elif name in ("article", "main", "section") or known.get("role") == "main":
            count[6] += 1
        elif name == "nav":
            count[7] += 1
        elif name in HEADINGS:
            count[8] += 1
        elif name == "img":
            count[9] += 1

    def depth_of(self, names) -> int:
        depth, at = -1, self.at
        for n in names:
            depths = at.get(n)
            if depths and depths[-1] > depth:
                depth = depths[-1]
        return depth

    def bounds(self) -> frozenset[str]:
        """What an end tag doesn't reach across; cells only where there is a table."""
        return BOUNDS if self.at.get("table") else BOUNDS_OF_TEXT

    def end_down_to(self, depth: int, own: bool) -> None:
        """End all elements open at ``depth`` or deeper; the outermost with its own tag if ``own``."""
        while len(self.open) > depth:
            name, start = self.open.pop()
            self.at[name].pop()
            closed = own and len(self.open) == depth or name in self.ended
            first, begun = self.rows[start], self.begun.pop()
            self.mains -= begun[-1]
            self.links -= name == "a"
            self.titles -= name in HEADINGS
            sums = list(map(sub, self.count, begun))
            first[10], first[15] = closed, sums
            first[9] = self.add("end", name, f"</{name}>", None, first[5], start, closed)
            self.rows[-1][15] = sums
            if name in ("ul", "ol"):
                self.items.pop()
            if self.boxes and self.boxes[-1][0] == start:
                self.boxes.pop()
                self.shared = tuple(self.boxes)

    def end_nearest(self, names, stops) -> None:
        depth = self.depth_of(names)
        if depth >= 0 and depth > self.depth_of(stops):
            self.end_down_to(depth, False)

    def start(self, name: str, raw: str, rest: str) -> None:
        attrs = attributes(rest, self.decode) if rest else []
        if name in ("html", "body") and self.at.get(name):
            return
        if self.open and self.open[-1][0] == "head" and name not in HEAD_TAGS:
            self.end_down_to(len(self.open) - 1, False)
        if name in ENDS:
            self.end_nearest(*ENDS_WITHIN[bool(self.at.get("table"))][name])
        if name in PARTS and self.at.get("p"):
            self.end_nearest(("p",), self.bounds())
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.end_down_to(len(self.open) - 1, False)
        known = dict(attrs)
        self.counted(name, known)
        if name in VOID:
            self.add("void", name, raw, None, attrs)
            return
        pos = self.add("start", name, raw, None, attrs, closed=False)
        if len(self.open) >= DEEPEST:
            self.ignored[name] += 1
            self.rows[pos][9] = self.add("end", name, f"</{name}>", None, attrs, pos, False)
            return
        main = name in ("article", "main") or known.get("role") == "main"
        self.mains += main
        self.links += name == "a"
        self.titles += name in HEADINGS
        self.begun.append((*self.count, main))
        self.at[name].append(len(self.open))
        self.open.append((name, pos))
        # an element lies in itself
        row = self.rows[pos]
        row[12], row[13], row[14] = self.mains > 0, self.links > 0, self.titles > 0
        if name in ("ul", "ol"):
            given = known.get("start", "1").strip()
            self.items.append((int(given) if re.fullmatch(r"-?\d{1,9}", given) else 1) if name == "ol" else None)
        mark = None
        if name == "li":
            mark = "- "
            if self.items and self.items[-1] is not None:
                given = known.get("value", "").strip()
                number = int(given) if re.fullmatch(r"-?\d{1,9}", given) else self.items[-1]
                self.items[-1] = number + 1
                mark = f"{number}. "
        elif name == "blockquote" or (name in ("div", "aside", "section") and (known.get("role") == "alert" or NOTE_CLASS.search(known.get("class", "")))):
            mark = "> "
        if mark:
            self.boxes.append((pos, mark))
            self.shared = tuple(self.boxes)
        self.rows[pos][11] = self.shared

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            self.ended.add(name)
            return
        if self.ignored[name]:
            self.ignored[name] -= 1
            return
        depths = self.at.get(name)
        if not depths:
            return
        inside = bool(self.at.get("table"))
        if name in TABLE_PARTS:
            stops = () if name == "table" else ("table",)
        elif name == "li":
            stops = ENDS_WITHIN[inside]["li"][1]
        else:
            stops = OWN_BOUNDS[inside].get(name) or self.bounds()
        if depths[-1] > self.depth_of(stops):
            self.end_down_to(depths[-1], True)

    def characters(self, raw: str, kind: str = "text") -> None:
        if raw:
            if self.open and self.open[-1][0] == "head" and not raw.isspace():
                self.end_down_to(len(self.open) - 1, False)
            text = self.decode(raw) if kind == "text" and "&" in raw else raw
            self.add(kind, None, raw, text, None)
            if kind == "text":
                n = len(" ".join(text.split()))
                in_links, commas = n if self.links else 0, text.count(",") if text.isascii() else sum(map(text.count, COMMAS))
                solid, ticks, count = int(SOLID.search(text) is not None), int("`" in text), self.count
                count[0] += n
                count[1] += in_links
                count[2] += commas
                count[3] += solid
                count[4] += ticks
                self.rows[-1][15] = [n, in_links, commas, solid, ticks, 0, 0, 0, 0, 0, 0, len(raw)]


def parsed(html: str, decode=references.unescape) -> list[list]:
    """The rows of one page."""
    tree, at, size = Tree(decode), 0, len(html)
    pending = 0  # start of text that isn't a row yet
    while True:
        begin = html.find("<", at)
        if begin < 0:
            break
        if html.startswith(("<!", "<?"), begin):
            close = "-->" if html.startswith("<!--", begin) else ">"
            end = html.find(close, begin + (4 if close == "-->" else 2))
            end = size if end < 0 else end + len(close)
            tree.characters(html[pending:begin])
            at = pending = end
            continue
        tag = _TAG.match(html, begin)
        if not tag:
            at = begin + 1
            continue
        tree.characters(html[pending:begin])
        at = pending = tag.end()
        slash, name, rest = tag.group(1), tag.group(2).lower(), tag.group(3)
        if slash:
            tree.end(name)
            continue
        tree.start(name, tag.group(0), rest)
        if name in CHARACTERS and tree.open and tree.open[-1][0] == name:
            own = _END_OF[name].search(html, at)
            stop = own.start() if own else size
            tree.characters(html[at:stop], "text" if name in ("title", "textarea") else "data")
            tree.end_down_to(len(tree.open) - 1, own is not None)
            at = pending = own.end() if own else size
    tree.characters(html[pending:])
    tree.end_down_to(0, False)
    return tree.rows


_TYPES = (
    pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(),
    pa.list_(pa.struct([("node", pa.int32()), ("mark", pa.string())])), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int32()] * len(COUNTS),
)
_NAMES = [x.split()[0] for x in ROW_SCHEMA.split(", ")]


def _columns(rows: list[list]) -> list[pa.Array]:
    columns = [list(c) for c in zip(*rows)]
    none = [None] * len(COUNTS)
    columns[15:] = zip(*[c if c else none for c in columns[15]])
    offsets, flat = [0], []
    for b in columns[11]:
        flat.extend(b)
        offsets.append(len(flat))
    struct = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string())], ["node", "mark"])
    columns[11] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
    return [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES)]


def _rows_of(key: str, html: str, payload: list[str], decode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows hold no cycles: looking for some takes a fifth of the time
        on = gc.isenabled()
        gc.disable()
        try:
            yield from sent_batches(batches)
        finally:
            if on:
                gc.enable()

    def sent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, keys = batch.column(names.index(html)), batch.column(names.index(key))
            rows, source = [], []

            def sent():
                index = pa.array(source, pa.int64())
                first = pa.array([i if r[1] == "page" else None for i, r in zip(source, rows)], pa.int64())
                arrays = [keys.take(index)] + [batch.column(names.index(c)).take(first) for c in payload] + _columns(rows)
                return pa.RecordBatch.from_arrays(arrays, [key, *payload, *_NAMES])

            for i in range(batch.num_rows):
                found = [[-1, "page", None, None, None, None, -1, None, None, None, None, (), None, None, None, None]] + parsed(texts[i].as_py() or "", decode)
                for cut in range(0, len(found), BATCH_ROWS):
                    part = found[cut : cut + BATCH_ROWS]
                    rows += part
                    source += [i] * len(part)
                    if len(rows) >= BATCH_ROWS:
                        yield sent()
                        rows, source = [], []
            if rows:
                yield sent()

    return run


def element_rows(pages: DataFrame, key: str = "page_id", html: str = "html", payload: tuple[str, ...] = (), decode=references.unescape) -> DataFrame:
    """(key, payload, pos, kind, name, raw, text, attrs, node, parent, grand, last, closed, boxes): each page's tree, in order.

    ``kind`` is start, end, void, text or data (of scripts), and page for one more row before the others (pos -1), which alone holds the columns of
    ``payload``. ``node`` is the row of the element that an end row ends; ``parent`` and ``grand`` are -1 above the page. ``text`` has its
    character references decoded, once (by ``decode``: those without a semicolon too, as browsers do, or ``whole_references``, with or without ampersands); ``raw`` is as in the page. ``boxes`` are the quotes and list items around a text or element (itself included), outermost
    first, with their Markdown marks. ``in_main``, ``in_link`` and ``in_heading`` tell where a row lies; elements have ``COUNTS`` of what they hold, texts of
    themselves. A null page has no rows but its first. Nothing is shuffled.
    """
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in (key, *payload)) + ", " + ROW_SCHEMA
    return pages.select(*dict.fromkeys((key, html, *payload))).mapInArrow(_rows_of(key, html, list(payload), decode), schema)


def so_far(key: str) -> str:
    """SQL window: a page's rows up to each one."""
    return f"(PARTITION BY `{key}` ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def covered(key: str, flag: str) -> str:
    """SQL condition: whether a row is, or lies inside, an element whose start row has ``flag``."""
    return f"coalesce(max(CASE WHEN {flag} THEN last END) OVER {so_far(key)} >= pos, false)"
