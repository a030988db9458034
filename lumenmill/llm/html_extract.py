"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's token streams: tags that match, groups
that are optional ``?`` or repeated ``+``/``*``, and text slots. As tags nest, it is kept as a
tree whose nodes carry a quantifier.

1. Each page becomes a tree of block elements (labelled by tag, class and id words) with inline
   content folded into text leaves. Repeats inside the page fold into repeated groups.
2. Map tasks fold pages of the same host and shape into one row: text that differs becomes a
   slot, text that never does stays a constant.
3. Rows of a host are aligned one after another: children are matched by longest common
   subsequence; what only one side has becomes optional, adjacent equals become repeats. A host's
   rows are first merged in salted buckets, so that a host with a third of all pages is shared
   out; rows stream through in sorted order and only the wrapper is held.
4. Roles, page by page: menus, headers, footers, asides, notices, adverts, forms, scripts,
   comments go by tag or by whole class and id names (``share-box``, but not ``no-sidebar``);
   never html, body, main or article by name, nor a node that holds the page's only article or
   main, nor, by name or as a form, one with most of the varying text. If the page has article (else main) elements with
   at least half of its varying text, they are its content, less the host's template: text that
   half of its pages have in the same place. On any other page content is what varies: slots,
   optional and repeated groups that are not mostly links and not template.
5. Each page is aligned with its host's wrapper, and the text of content nodes is written out.

Wrappers go to the pages by a broadcast join while their measured size is below BROADCAST_BYTES,
else by a shuffled join.

Defined results: null html gives an empty text; elements nested more than 200 deep count as inside
the 200th; a tag whose quotes are not closed ends at the next >, one that never ends is text; a null or odd url is a host of its own; unclosed
elements, comments and scripts end where HTML lets them; a page without any content node gives an
empty text. Block elements (cells and list items too) make lines; ``<br>`` is white space.
"""

from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import html as htmllib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import parts, prepare, stage, table

BROADCAST_BYTES = 32 << 20
_HELD = 16 << 20  # characters of shapes in a task; their trees take some ten times that
SALTS = 16

# Names of HTML elements and words of class and id attributes.
BLOCK = frozenset("html body head title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_TAGS = frozenset("head title nav header footer aside form menu select dialog button noscript iframe object svg template canvas audio video textarea datalist map search".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent notice alert popup modal overlay comment comments respond disqus share sharing social related recommended recommendations subscribe newsletter signup login search pagination pager widget copyright skip".split())
# Words that may stand beside those in a name: share-box, top-menu, ad-slot-left.
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons container content group icon icons inner item items left links list main outer panel primary right secondary section site slot small top unit wrap wrapper zone".split())
NEVER = frozenset("html body main article".split())
RAW = "script|style|noscript|template|iframe|svg|canvas|object|textarea|select|video|audio|math"
CLOSES = {  # a start tag of the key ends an open element of the value
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th", "body": "head title",
}
SCOPES = frozenset("ul ol dl table article section div td th body html main aside nav header footer form blockquote".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?/]")
_STOP = re.compile("[>\"']")
_RAW_TAG = re.compile(rf"(?:{RAW})\Z", re.I)
_DEPTH = 200  # elements nested deeper are read as if they were inside the last one of these
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 14)
def _name(name: str) -> str:
    """A class, id or role name without what is no letter: post-123 is post."""
    return "-".join(_WORDS.findall(name.lower()))


@functools.lru_cache(1 << 14)
def _says_drop(name: str) -> bool:
    """Whether a whole name is one of DROP_WORDS, be it with plain words beside it."""
    words = set(name.split("-"))
    return not words.isdisjoint(DROP_WORDS) and words <= DROP_WORDS | PLAIN_WORDS


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Where the > of a tag is that begins before `at`: not inside quotes that are closed; -1 if there
    is none. quotes: from where on a quote is known not to be found, so that a page is read once."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if quotes.get(m[0], len(page)) <= at:
            return page.find(">", at)
        close = page.find(m[0], at)
        if close < 0:
            quotes[m[0]] = at
            return page.find(">", at)
        at = close + 1
    return -1


def tokens(page: str):
    """(text, closing, name, attributes) of the page: text alone, or a tag. Comments, declarations and
    raw elements with their content are passed over; what is not closed runs to the end, a tag that
    never ends is text."""
    at, n, quotes, gone, ended = 0, len(page), {}, {}, False
    lower = None
    while at < n:
        begin = page.find("<", at)
        if begin != at:
            yield page[at : begin if begin >= 0 else n], None, None, None
            if begin < 0:
                return
            at = begin
        m = _OPEN.match(page, at)
        if m is None:
            yield "<", None, None, None
            at += 1
        elif m[2] is None:
            close = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = n if close < 0 else close + (3 if m[0] == "<!--" else 1)
        else:
            close = -1 if ended else _tag_end(page, m.end(), quotes)
            if close < 0:
                ended = ended or page.find(">", at) < 0
                yield "<", None, None, None
                at += 1
                continue
            attributes = page[m.end() : close]
            at = close + 1
            if not m[1] and _RAW_TAG.match(m[2]):
                if attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\r\n\f\"'" or attributes[-2].isalnum()):
                    continue
                name = m[2].lower()
                if name not in gone:
                    lower = page.lower() if lower is None else lower
                    end = lower.find("</" + name, at) if len(lower) == n else -1
                    if len(lower) != n:
                        found = re.compile("</" + name, re.I).search(page, at)
                        end = found.start() if found else -1
                    while end >= 0 and page[end + 2 + len(name) : end + 3 + len(name)] not in ("", ">", " ", "\t", "\n", "\r", "\f", "/"):
                        end = (lower.find("</" + name, end + 1)) if len(lower) == n else -1
                    if end >= 0:
                        close = page.find(">", end)
                        at = n if close < 0 else close + 1
                        continue
                    gone[name] = True
                return
            yield None, m[1], m[2], attributes


def parse(page: str) -> list:
    """The page's tree: nodes are [label, children], leaves are [None, text, link characters]."""
    root = ["", []]
    stack, names, inline, linked, in_link = [root], [""], [], 0, 0
    hidden = 0  # open inline elements whose words say they are no content
    hides: list[str] = []

    def flush() -> None:
        nonlocal linked
        if inline:
            text = "".join(inline)
            if text.strip():
                stack[-1][1].append([None, text, linked])
            inline.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal in_link, hidden
        flush()
        del stack[i:], names[i:]
        in_link = hidden = 0
        hides.clear()

    for text, closing, name, attributes in tokens(page):
        if text is not None:
            if not hidden:
                inline.append(text)
                if in_link:
                    linked += len(text)
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                for i in range(len(names) - 1, 0, -1):
                    if names[i] == name:
                        close(i)
                        break
                else:
                    flush()
            elif name == "a":
                in_link = 0
            if hides and name == hides[-1]:
                hides.pop()
                hidden = len(hides)
            continue
        words = ""
        if "=" in attributes and _NAMES.search(attributes):
            words = ".".join(sorted({w for a in _NAMES.findall(attributes) for w in map(_name, a.strip("\"'").split()) if w}))
        if name in BLOCK:
            flush()
            if ends := CLOSES.get(name):
                ends = ends.split()
                for i in range(len(names) - 1, 0, -1):
                    if names[i] in ends:
                        close(i)
                        if name not in ("tr", "tbody", "tfoot", "body"):
                            break
                    elif names[i] in SCOPES:
                        break
            else:
                for i in range(len(names) - 1, 0, -1):
                    if names[i] == "p":
                        close(i)
                        break
                    elif names[i] in SCOPES:
                        break
            node = [f"{name}.{words}" if words else name, []]
            stack[-1][1].append(node)
            if name != "hr" and len(stack) < _DEPTH:
                stack.append(node)
                names.append(name)
            elif name != "hr":
                stack.append(stack[-1])
                names.append(name)
                stack[-2][1].pop()
        elif name in VOID:
            if name in ("br", "wbr", "img"):
                inline.append(" " if name == "br" else "")
        elif name == "a":
            in_link = 1
        elif any(map(_says_drop, words.split("."))) or name in DROP_TAGS:
            if not attributes.rstrip().endswith("/"):
                hides.append(name)
                hidden = len(hides)
    flush()
    return root


# Wrapper nodes: [label, quantifier, children]; text leaves: ["#", quantifier, constant or None, characters, link characters, times seen]


def _either(p: str, q: str) -> str:
    """The quantifier that allows for what both allow."""
    many, none = p in "+*" or q in "+*", p in "?*" or q in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def _merge(a: list, b: list, times=int.__add__) -> list:
    """One node for both. times: how often its texts are seen; repeats on one page are seen once."""
    q = _either(a[1], b[1])
    if a[0] == "#":
        return ["#", q, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], times(a[5], b[5])]
    return [a[0], q, align(a[2], b[2], times)]


def _optional(node: list) -> list:
    return [node[0], "*" if node[1] in "+*" else "?", *node[2:]]


def align(a: list, b: list, times=int.__add__) -> list:
    """Two lists of wrapper nodes to one that covers both."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merge(x, y, times) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    if n * m > _CELLS:
        return _fold(_long(a, b, times))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j], times))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _fold(out)


_CELLS = 250_000


def _long(a: list, b: list, times) -> list:
    """Long lists: equal ends are matched first; what is between by labels found once in both, in the
    order of both, and the stretches between those alike."""
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    out = [_merge(x, y, times) for x, y in zip(a[:head], b[:head], strict=True)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y or len(x) * len(y) <= _CELLS:
        out += align(x, y, times) if x and y else [_optional(z) for z in x + y]
    else:
        once = [{k: i for i, k in enumerate(z) if counted[k] == 1} for z in ([v[0] for v in x], [v[0] for v in y]) for counted in [collections.Counter(z)]]
        pairs = sorted((i, once[1][k]) for k, i in once[0].items() if k in once[1])
        chain = _rising(pairs)
        if not chain:  # nothing to hold on to: halves against halves
            chain, cut = [], [(len(x) // 2, len(y) // 2), (len(x), len(y))]
        else:
            cut = [*chain, (len(x), len(y))]
        i = j = 0
        for p, q in cut:
            out += align(x[i:p], y[j:q], times) if x[i:p] and y[j:q] else [_optional(z) for z in x[i:p] + y[j:q]]
            if (p, q) in chain:
                out.append(_merge(x[p], y[q], times))
                p, q = p + 1, q + 1
            i, j = p, q
    return out + [_merge(x, y, times) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that rise in both places; pairs are sorted."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _fold(nodes: list) -> list:
    """Adjacent equals and adjacent equal groups of two or three become repeats."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0] and node[0] != "#":
            out[-1] = _merge(out[-1], node, max)
            out[-1][1] = "*" if out[-1][1] in "?*" and node[1] in "?*" else "+"
        else:
            out.append(node)
        for k in (2, 3):
            if len(out) >= 2 * k and [x[0] for x in out[-k:]] == [x[0] for x in out[-2 * k : -k]]:
                both = [_merge(x, y, max) for x, y in zip(out[-2 * k : -k], out[-k:], strict=True)]
                out[-2 * k :] = [[x[0], _either(x[1], "+"), *x[2:]] for x in both]
                break
    return out


def _exact(text: str) -> str:
    """A leaf's constant: its text, white space aside; of a long one the length and a hash of all of it."""
    text = " ".join(text.split())
    return text if len(text) <= 64 else f"{len(text)} {hashlib.blake2b(text.encode(errors='replace'), digest_size=16).hexdigest()}"


def wrap(node: list) -> list:
    """A page's tree as a wrapper node of its own."""
    kids = [["#", "1", _exact(k[1]), len(k[1]), k[2], 1] if k[0] is None else wrap(k) for k in node[1]]
    return [node[0], "1", _fold(kids)]


def shape(node: list) -> str:
    """The wrapper without its texts, quantifiers of repeats included."""
    return "#" if node[0] == "#" else f"{node[0]}{node[1]}({' '.join(map(shape, node[2]))})"


@functools.lru_cache(1 << 14)
def _is_dropped(label: str) -> bool:
    tag, _, names = label.partition(".")
    return tag in DROP_TAGS or (tag not in NEVER and any(map(_says_drop, names.split("."))))


@functools.lru_cache(1 << 14)
def _may_hold(label: str) -> bool:
    """Whether a dropped node can be opened for most of the text: not by its tag, unless a form."""
    tag = label.partition(".")[0]
    return tag not in DROP_TAGS or tag == "form"


def _has(node: list, tag: str, dropped: bool = False) -> bool:
    """Whether a page's node has such an element below it: outside of dropped ones, or anywhere if
    its own names don't speak against it."""
    for k in node[1]:
        if k[0] is None or not (dropped or not _is_dropped(k[0])):
            continue
        name, _, names = k[0].partition(".")
        if (name == tag and not (dropped and any(map(_says_drop, names.split("."))))) or _has(k, tag, dropped):
            return True
    return False


def _aligned(node: list, wrapper: list | None):
    """A page node's children, each with its node in the wrapper or None."""
    slots = wrapper[2] if wrapper else []
    at = 0
    for kid in node[1]:
        label = "#" if kid[0] is None else kid[0]
        found = next((k for k in range(at, len(slots)) if slots[k][0] == label), None)
        if found is None:
            found = next((k for k in range(at) if slots[k][0] == label), None)
        at = found if found is not None and found > at else at
        yield kid, slots[found] if found is not None else None


class Roles:
    """What a host's wrapper says of its pages."""

    def __init__(self, wrapper: list, pages: int):
        self.top, self.pages = wrapper, pages
        self.judge = pages > 2 and self._varies(wrapper[2])

    def _varies(self, nodes: list) -> bool:
        return any(x[2] is None if x[0] == "#" else not _is_dropped(x[0]) and self._varies(x[2]) for x in nodes)

    def text(self, page: list) -> str:
        out: list[str] = []
        root = next((t for t in ("article", "main") if _has(page, t)), None)
        # an article inside a dropped node counts if there is none outside
        hidden = None if root else next((t for t in ("article", "main") if _has(page, t, True)), None)
        if root and self.judge:
            inside, outside = self._sizes(page, self.top, root, False)
            if inside < outside:
                root = None
        self._walk(page, self.top, root, hidden, self._all(page, root), root is None, False, out)
        return "\n".join(out)

    def _all(self, page: list, root: str | None):
        """Characters of varying text in scope, counted when first asked for."""
        return functools.cache(lambda: sum(self._sizes(page, self.top, root, root is None, True)[:1]))

    def _sizes(self, node: list, wrapper: list | None, root: str | None, inner: bool, dropped: bool = False) -> tuple[int, int]:
        """Characters of text, in no link and no constant, inside and outside of root elements."""
        inside = outside = 0
        for kid, slot in _aligned(node, wrapper):
            if kid[0] is None:
                if not (slot and self.judge and self._constant(slot)):
                    n = len(kid[1].strip()) - kid[2]
                    inside, outside = (inside + n, outside) if inner else (inside, outside + n)
            elif not _is_dropped(kid[0]) or (dropped and _may_hold(kid[0])):
                a, b = self._sizes(kid, slot, root, inner or kid[0].partition(".")[0] == root, dropped)
                inside, outside = inside + a, outside + b
        return inside, outside

    def _walk(self, node: list, wrapper: list | None, root: str | None, hidden: str | None, most, content: bool, inner: bool, out: list[str]) -> None:
        for kid, slot in _aligned(node, wrapper):
            if kid[0] is None:
                if content and not (self.judge and slot and self._template(slot, inner)):
                    line = " ".join(htmllib.unescape(kid[1]).split())
                    if line:
                        out.append(line)
                continue
            label = kid[0]
            tag = label.partition(".")[0]
            if _is_dropped(label) and not (inner and label == "header"):
                if hidden and tag not in ("head", "template") and _has(kid, hidden, True):
                    self._walk(kid, slot, hidden, hidden, most, False, False, out)
                    continue
                if not (content and _may_hold(label) and 2 * self._sizes(kid, slot, None, True, True)[0] > most()):
                    continue
            here = tag == root
            self._walk(kid, slot, root, hidden, most, content or here, inner or here or tag in ("article", "main"), out)

    def _constant(self, slot: list) -> bool:
        """The same text on at least half of the pages (three at least)."""
        return slot[2] is not None and slot[5] >= max(3, self.pages / 2)

    def _template(self, slot: list, inner: bool) -> bool:
        """A constant, or mostly links where no article or main says that it is content."""
        return self._constant(slot) or (not inner and slot[4] * 2 > slot[3])


def _shapes(batches):
    """Pages of a task, folded by host and shape."""
    seen: dict[tuple[str, str], list] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            node = wrap(parse(page or ""))
            key = (host, shape(node))
            old = seen.get(key)
            seen[key] = [node, 1] if old is None else [_merge(old[0], node), old[1] + 1]
            held += len(key[1]) if old is None else 0
            if held > _HELD:
                yield _rows(seen)
                seen, held = {}, 0
    if seen:
        yield _rows(seen)


def _rows(seen: dict) -> pa.RecordBatch:
    hosts, shapes = [k[0] for k in seen], [k[1] for k in seen]
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array([json.dumps(v[0]) for v in seen.values()], pa.string()), pa.array([v[1] for v in seen.values()], pa.int64())], ["host", "shape", "wrapper", "pages"])


def _merge_sorted(batches):
    """Rows sorted by host (and salt): one wrapper for each run of equal keys."""
    key, now, pages = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([json.dumps(now)], pa.string()), pa.array([pages], pa.int64())], ["host", "salt", "wrapper", "pages"])

    for batch in batches:
        for host, salt, wrapper, n in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper", "pages")), strict=True):
            node = json.loads(wrapper)
            if (host, salt) != key:
                if key is not None:
                    yield row()
                key, now, pages = (host, salt), node, n
            else:
                now, pages = _merge(now, node), pages + n
    if key is not None:
        yield row()


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON), pages. pages: host, html."""
    schema, n = "host string, salt int, wrapper string, pages long", parts(pages.sparkSession)
    rows = pages.mapInArrow(_shapes, "host string, shape string, wrapper string, pages long")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int"))
    some = salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", F.desc(F.length("shape")), "shape", "wrapper").select("host", "salt", "wrapper", "pages").mapInArrow(_merge_sorted, schema)
    one = some.repartition(n, "host").sortWithinPartitions("host", "salt").select("host", F.lit(0).alias("salt"), "wrapper", "pages").mapInArrow(_merge_sorted, schema)
    return one.select("host", "wrapper", "pages")


def _extract(batches):
    known: dict[str, Roles] = {}
    for whole in batches:
        for batch in textkit.blocks(whole, "html"):
            texts = []
            for page, wrapper, n in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True):
                roles = known.get(wrapper)
                if roles is None:
                    if len(known) >= 64:
                        known.clear()
                    roles = known[wrapper] = Roles(json.loads(wrapper), n)
                texts.append(roles.text(parse(page or "")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.large_string()).cast(pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: the id, the url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    found = stage(wrappers(source.select("host", "html")), "html-wrappers")
    size = found.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    joined = source.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host").select("id", "url", "html", "wrapper", "pages")
    out = joined.mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
