"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts. Repaired, so that every tag is closed, it is an expression: an element holds a
sequence of texts and elements. Expressions of one host are aligned in turn. Where two sequences agree, they are
merged element by element; texts that differ become a text slot; what follows itself becomes a repeated group,
``( ... )+``; what only one of the two has becomes optional, ``( ... )?``. There is no alternative, so a wrapper stays
about as short as a page of the host. Every page it was made of matches it (tests hold it to that).

A slot of the wrapper knows how much text it holds over all pages, how much of that is in links, and whether the text
ever differs. Slots are left out that lie in elements named as something else than text (by tag, role, id or class), that
hold mostly links, or whose text is the same on different pages: that is the host's template. If a page has an
``article`` or ``main`` element with text, its main text is what is left of that, else what is left of the page.
A page is matched against its host's wrapper to tell which slots its texts are in.

Scale: pages are folded into one wrapper per host and task, where they are read, so a host with a third of all pages
leaves one row per task. These rows are merged sixteen at a time until each host has one; no task ever holds more
than sixteen of a host. Wrappers are broadcast while all of them together are below ``BROADCAST_BYTES``, which is
checked; beyond that pages and wrappers are joined by host, and Spark splits a host that is too large for one task.

Null and empty pages give an empty text. Pages without a host in their url (null urls too) share a wrapper. Repeated rows,
null and repeated ids each keep their row; exact copies don't make a template of their text. Broken markup never fails: stray end
tags are ignored, missing ones supplied, unfinished scripts and comments run to the end of the page. Elements nested
deeper than ``DEPTH`` are read as part of the element above. Pages are taken whole, in memory in
proportion to their length. An empty table gives an empty one. Other columns are left out, whatever their names.
Which pages share a task depends on the file splits, and with it the order of the alignments: reruns over the same files agree.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.llm.common import shipped
from plumbline.session import stage

#: Wrappers of a host that are merged at once.
FAN = 16
#: Widest sequence that is recognised as a repeated group; wider ones are written out.
GROUP_WIDTH = 8
#: Nesting that is followed.
DEPTH = 100
#: Occurrences from which on a text that never differs is the template's.
TEMPLATE_PAGES = 4
#: Share of a slot's characters in links from which on it is a menu.
LINK_SHARE = 0.5
BROADCAST_BYTES = 8 << 20

# Elements that stand for themselves on a page, as HTML has them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table"
    " tbody td template textarea tfoot th thead title tr ul video audio canvas object".split()
)
#: Elements whose start ends an open element of the same kind, and where the search for that stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
RAW = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("title meta link base noscript template script style".split())
# Elements, roles and words of ids and classes that name something else than text.
OTHER_TAGS = frozenset(
    "aside button canvas dialog fieldset footer form head iframe label legend menu nav noscript object optgroup option search select svg template textarea title video audio".split()
)
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars aside footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing"
    " social related recommended recommendations comment comments reply replies respond disqus widget widgets pagination pager toolbar form".split()
)
#: These name a page's head unless they stand inside the article.
HEADERS = frozenset(("header", "masthead", "topbar"))
#: Class names that begin like this describe a page, not a part of it.
DESCRIBING = frozenset("has with without no is not".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+|[^>]*)>",
    re.S,
)
NAMING = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

shipped(__name__)


def label_of(name: str, rest: str) -> str:
    """The name of an element with its class and id names, digits left out; ends in ``!`` or ``^`` if it names no text, or a head."""
    other, head, names = name in OTHER_TAGS, name in HEADERS, []
    if rest and not rest.isspace():
        for attribute, *values in NAMING.findall(rest):
            attribute, value = attribute.lower(), "".join(values)
            if attribute in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in WORD.findall(token)]
                    names.append("-".join(words))
                    if words and words[0] not in DESCRIBING:
                        other = other or not OTHER_WORDS.isdisjoint((words[0], words[-1]))
                        head = head or not HEADERS.isdisjoint((words[0], words[-1]))
            elif attribute == "role":
                names.append("role-" + value.lower())
                other = other or value.lower() in OTHER_ROLES
            elif attribute == "style":
                other = other or bool(HIDDEN.search(value))
            else:
                other = other or value.lower() not in ("false", "until-found")
    if name in ("html", "body", "article", "main"):
        other = head = False
    return ".".join([name, *sorted(names)]) + ("!" if other else "^" if head else "")


class Page:
    """A page as nested ``[label, children]``; a child is such a pair or a text ``("#", text, characters in links)``."""

    def __init__(self, markup: str):
        self.stack: list[tuple[str, list]] = [("", [])]
        self.pieces: list[str] = []
        self.in_links = self.link = self.deep = 0
        at, end = 0, len(markup)
        while at < end:
            token = TOKEN.search(markup, at)
            if token is None:
                break
            self.text(markup[at : token.start()])
            at = token.end()
            name = (token["name"] or "").lower()
            if token["end"]:
                self.close(name)
            elif name:
                self.open(name, token["rest"])
                if name in RAW:
                    closing = re.compile(rf"</{name}[^>]*>", re.I).search(markup, at)
                    at = closing.end() if closing else end
        self.text(markup[at:])
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self.children = self.stack[0][1]

    def text(self, raw: str) -> None:
        if raw:
            if self.stack[-1][0] == "head" and not raw.isspace():
                self.pop()
            self.pieces.append(references.unescape(raw) if "&" in raw else raw)
            self.in_links += len(raw.strip()) * bool(self.link)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.stack[-1][1].append(("#", text, min(self.in_links, len(text))))
            self.pieces = []
        self.in_links = 0

    def pop(self) -> None:
        self.flush()
        self.stack.pop()
        self.link = 0

    def push(self, name: str, label: str) -> None:
        self.flush()
        made: list = []
        self.stack[-1][1].append((label, made))
        self.stack.append((name, made))

    def open(self, name: str, rest: str) -> None:
        if name == "a":
            self.link += 1
        elif name == "br":
            self.pieces.append(" ")
        label = label_of(name, rest) if name in BLOCKS or rest else name
        if name not in BLOCKS:
            # an inline element that names something else is set apart, the paragraph goes on behind it
            apart = label.endswith("!") or any(name == opened for opened, _ in self.stack)
            if apart and name not in VOID and name not in RAW and len(self.stack) <= DEPTH:
                self.push(name, label)
            elif name == "hr":
                self.flush()
            return
        if self.stack[-1][0] == "head" and name not in IN_HEAD:
            self.pop()
        if self.stack[-1][0] == "p":
            self.pop()
        ended, border = ENDS.get(name, ((), ()))
        for k in range(len(self.stack) - 1, 0, -1) if ended else ():
            if self.stack[k][0] in border:
                break
            if self.stack[k][0] in ended:
                while len(self.stack) > k:
                    self.pop()
                break
        if len(self.stack) > DEPTH:
            self.deep += 1
            self.flush()
        else:
            self.push(name, label)

    def close(self, name: str) -> None:
        if name == "a":
            self.link = max(0, self.link - 1)
        if self.deep and name in BLOCKS:
            self.deep -= 1
            self.flush()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                while len(self.stack) > k:
                    self.pop()
                return


# An item of an expression: [sign, optional, repeated, body]. The sign is "#" for a text slot (body: occurrences, characters,
# of them in links, digest of the text or None, digest of the page or None), "(...)" for a group, else the label of an element
# (body: its items). None stands for two that differ.


def signs(items: list) -> list[str]:
    return [item[0] for item in items]


def merged(a: list, b: list) -> list:
    """Two items with the same sign as one."""
    if a[0] == "#":
        (n, chars, links, text, page), (m, *more) = a[3], b[3]
        body = [n + m, chars + more[0], links + more[1], text if text == more[2] else None, page if page == more[3] else None]
    elif a[0][0] == "(":
        body = [merged(x, y) for x, y in zip(a[3], b[3])]
    else:
        body = aligned(a[3], b[3])
    return [a[0], a[1] | b[1], a[2] | b[2], body]


def grouped(items: list) -> list:
    """The items with what follows itself as repeated groups, narrow ones first."""
    for width in range(1, GROUP_WIDTH + 1):
        if 2 * width > len(items):
            break
        made: list = []
        for item in items:
            made.append(item)
            last, before = made[-width:], made[-2 * width : -width]
            if len(made) <= width:
                continue
            if width == 1:
                if before[0][0] == item[0]:
                    made[-2:] = [_again(before[0], item)]
                continue
            sign = f"({','.join(signs(last))})"
            if made[-width - 1][0] == sign:
                made[-width - 1 :] = [_again(made[-width - 1], [sign, 0, 0, last])]
            elif len(before) == width and signs(before) == signs(last):
                made[-2 * width :] = [_again([sign, 0, 0, before], [sign, 0, 0, last])]
        items = made
    return items


def _again(a: list, b: list) -> list:
    """Two neighbours with the same sign as a repetition."""
    both = merged(a, b)
    both[2] = 1
    # both may be missing only if each may be
    both[1] = a[1] & b[1]
    return both


def folded(items: list, like: list) -> list:
    """The items, with those in a row that a group of ``like`` holds taken as that group."""
    for sign, _, _, body in like:
        if sign[0] != "(":
            continue
        inner, made, k = signs(body), [], 0
        while k < len(items):
            if signs(items[k : k + len(inner)]) == inner:
                made.append([sign, 0, 0, items[k : k + len(inner)]])
                k += len(inner)
            else:
                made.append(items[k])
                k += 1
        items = grouped(made) if len(made) < len(items) else items
    return items


def aligned(a: list, b: list) -> list:
    """One sequence for two: agreeing items merged, the others optional."""
    a, b = folded(a, b), folded(b, a)
    x, y = signs(a), signs(b)
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x) - head - tail, len(y) - head - tail
    # longest common subsequence of what lies between
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if x[head + i] == y[head + j] else max(common[i + 1][j], common[i][j + 1])
    made = [merged(p, q) for p, q in zip(a[:head], b[:head])]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[head + i] == y[head + j]:
            made.append(merged(a[head + i], b[head + j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and common[i + 1][j] >= common[i][j + 1]):
            made.append([x[head + i], 1, *a[head + i][2:]])
            i += 1
        else:
            made.append([y[head + j], 1, *b[head + j][2:]])
            j += 1
    made += [merged(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]
    return grouped(made)


def expression(children: list, page: int) -> list:
    """The items of a page's elements, repetitions grouped."""
    return grouped(
        [
            ["#", 0, 0, [1, len(child[1]), child[2], xxhash.xxh64_intdigest(child[1]), page]] if child[0] == "#" else [child[0], 0, 0, expression(child[1], page)]
            for child in children
        ]
    )


def wrapper_of(markup: str) -> list:
    """The expression of one page."""
    return expression(Page(markup).children, xxhash.xxh64_intdigest(markup))


class Sequence:
    """What to do with each child of an element: the automaton of its items, with a level or a sequence for each place.

    Level 2 is text inside an article, 1 text outside, 0 none.
    """

    def __init__(self, items: list, inside: bool = False):
        self.signs: list[str] = []
        self.does: list = []
        self.follow: list[set[int]] = []
        self.empty, self.first, self.last = self._walk(items, inside)
        self.of: dict[str, list[int]] = {}
        for place, sign in enumerate(self.signs):
            self.of.setdefault(sign, []).append(place)

    def _place(self, item: list, inside: bool) -> int:
        sign, body = item[0], item[3]
        if sign == "#":
            occurrences, chars, links, text, page = body
            fixed = text is not None and page is None and occurrences >= TEMPLATE_PAGES
            level = 2 if inside else 0 if fixed or links > LINK_SHARE * chars else 1
        elif sign[-1] == "!" or (sign[-1] == "^" and not inside):
            level = None
        else:
            level = Sequence(body, inside or sign.split(".")[0] in ("article", "main") or "role-main" in sign.split("."))
        self.signs.append(sign)
        self.does.append(level)
        self.follow.append(set())
        return len(self.signs) - 1

    def _walk(self, items: list, inside: bool) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for item in items:
            if item[0][0] == "(":
                none, starts, ends = self._walk(item[3], inside)
            else:
                place = self._place(item, inside)
                none, starts, ends = False, {place}, {place}
            if item[2]:
                for p in ends:
                    self.follow[p] |= starts
            for p in last:
                self.follow[p] |= starts
            none = none or bool(item[1])
            first = first | starts if empty else first
            last = last | ends if none else ends
            empty = empty and none
        return empty, first, last

    def _ways(self, children: list) -> list[set[int]]:
        """The places that each child can have, given those before it and what it holds."""
        reached, allowed = [], self.first
        for child in children:
            here = {p for p in self.of.get(child[0], ()) if p in allowed and self._fits(p, child)}
            allowed = set().union(*(self.follow[p] for p in here))
            reached.append(here)
        return reached

    def _fits(self, place: int, child: tuple) -> bool:
        inner = self.does[place]
        return not isinstance(inner, Sequence) or inner.accepts(child[1])

    def accepts(self, children: list) -> bool:
        """Whether the children, and theirs, match the expression (elements that are left out are not looked into)."""
        return bool(self._ways(children)[-1] & self.last) if children else self.empty

    def places(self, children: list) -> list[int | None]:
        """The place of each child: a way through the automaton, earlier places first; None for what is in no page the wrapper knows."""
        if all(len(self.of.get(c[0], ())) == 1 for c in children):
            return [self.of[c[0]][0] for c in children]
        reached = self._ways(children)
        if not reached[-1] & self.last:
            return [self.of.get(c[0], [None])[0] for c in children]
        found, wanted = [], self.last
        for here in reversed(reached):
            found.append(min(here & wanted))
            wanted = {p for p, after in enumerate(self.follow) if found[-1] in after}
        return found[::-1]

    def texts(self, children: list, found: dict[int, list[str]]) -> None:
        for child, place in zip(children, self.places(children)):
            does = 1 if place is None and child[0] == "#" else None if place is None else self.does[place]
            if isinstance(does, Sequence):
                does.texts(child[1], found)
            elif does:
                found[does].append(child[1])


def main_text(markup: str, wrapper: Sequence) -> str:
    """The main text of a page, blocks two line ends apart."""
    found: dict[int, list[str]] = {1: [], 2: []}
    wrapper.texts(Page(markup).children, found)
    return "\n\n".join(found[2] or found[1])


def host_of(url: Column) -> Column:
    """The host of a url in lower case; empty for null urls and those without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _folded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper per host of the pages of a task."""
    wrappers: dict[str, list] = {}
    part = 0
    for batch in batches:
        hosts, part, pages = batch.column("host").to_pylist(), batch.column("part")[0].as_py() if len(batch) else part, batch.column("html").to_pylist()
        for host, page in zip(hosts, pages):
            if page:
                made = wrapper_of(page)
                wrappers[host] = aligned(wrappers[host], made) if host in wrappers else made
    yield _rows(wrappers, part)


def _rows(wrappers: dict[str, list], part: int) -> pa.RecordBatch:
    written = [json.dumps(w, separators=(",", ":")) for w in wrappers.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([part] * len(written), pa.int32()), pa.array(written, pa.string())], ["host", "part", "wrapper"])


def _merged_rows(rows: pa.Table) -> pa.Table:
    """The wrappers of one host, few, as one."""
    ordered = rows.sort_by("part")
    made: list | None = None
    for written in ordered.column("wrapper").to_pylist():
        made = json.loads(written) if made is None else aligned(made, json.loads(written))
    return pa.Table.from_batches([_rows({ordered.column("host")[0].as_py(): made or []}, ordered.column("part")[0].as_py() // FAN)])


def infer(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host, wrapper``: the wrapper of every host, as JSON, staged."""
    read = pages.select(host_of(pages[url]).alias("host"), F.spark_partition_id().alias("part"), pages[html].alias("html"))
    kind = "host string, part int, wrapper string"
    wrappers = stage(read.mapInArrow(_folded_batches, kind), "wrappers")
    parts = (wrappers.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        merged_ = wrappers.groupBy("host", F.floor(F.col("part") / FAN)).applyInArrow(_merged_rows, kind)
        wrappers, parts = stage(merged_, "wrappers"), -(-parts // FAN)
    return wrappers.select("host", "wrapper")


@F.arrow_udf(StringType())
def _extracted(html: pa.Array, wrapper: pa.Array) -> pa.Array:
    # as many at most as the batch has rows
    known: dict[str | None, Sequence] = {}
    texts = []
    for page, written in zip(html.to_pylist(), wrapper.to_pylist()):
        if written not in known:
            if len(known) >= 64:
                known.clear()
            items = json.loads(written) if written else []
            known[written] = Sequence(items)
        texts.append(main_text(page or "", known[written]))
    return pa.array(texts, pa.string())


def extract(pages: DataFrame, id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``id, url, text``: the main text of every page."""
    wrappers = infer(pages, html, url)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    wrappers = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    read = pages.select(pages[id].alias("id"), pages[url].alias("url"), pages[html].alias("html"), host_of(pages[url]).alias("host"))
    return read.join(wrappers, "host", "left").select("id", "url", _extracted("html", "wrapper").alias("text"))
