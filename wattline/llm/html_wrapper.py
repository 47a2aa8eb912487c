"""Main text of web pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over HTML tokens: elements, text slots, optional and
repeated groups, e.g. ``<ul>(<li><a>#text</a></li>)+</ul>``. It is found by aligning the token
streams of a host's pages one after the other: adjacent repeats fold into repeated groups,
elements that only some pages have become optional, texts that differ become slots. The alignment
of two wrappers is a wrapper, so tasks infer from their own pages and partial wrappers are merged,
first within salted parts of a host, then per host; every page takes part.

What the slots of a wrapper hold is kept by their place, the path of elements from the root: the lines that *all* pages with
this place have there (an intersection, so neither the order of pages nor that of siblings matters), and for elements
whose names only hint at something beside the article, how much of their text is in links and whether it is the same on all pages.
Reading a page walks it along these places. The article is what is in an article or main region; on
pages without one, the lines that their places do not have in common with other pages of the host. In neither case is it what is
navigation, header, footer, sidebar, notice, advert, form, script, style or reader comment.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import slices, stored

TEXT = "#text"
GROUP = "()"
#: Longest sequence of siblings whose repetition is written as a group, and siblings beyond which an expression gives up
#: their order. Both are about the form of an expression only; what its places hold does not depend on them.
LONGEST_PERIOD = 4
LONGEST_SEQUENCE = 24
#: Characters of an element's key beyond which a digest stands for it.
LONGEST_KEY = 120
#: Hosts whose partial wrappers a task keeps before it passes them on.
HELD_HOSTS = 2000
SALTS = 64
#: What hosts have in common is broadcast up to this size, by its real lengths.
BROADCAST_BYTES = 16 << 20

# HTML element categories.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot"}
# An opening tag ends an open element of these kinds, unless one of the stoppers is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements and words of class, id and role names that hold no article text.
ASIDE_TAGS = frozenset(
    "nav footer aside form head script style noscript template button select textarea iframe svg canvas object dialog menu title".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment "
    "comments reply replies disqus respond related recommended share sharing social newsletter subscribe subscription signup login "
    "widget toolbar pagination pager skip copyright complementary contentinfo search aside".split()
)
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements that may stand around a whole page, article included.
AROUND_TAGS = frozenset(("form", "dialog", "object", "header"))
# Words that say where or how something is, not what: beside aside words they leave a name as it is.
NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right inner outer upper lower list item items box bar block blocks container wrapper "
    "wrap area section sections group row col column link links button buttons icon icons text title heading posts form "
    "slot unit message messages inline the my".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, data): ``open`` with the attributes, ``close``, ``text`` with references decoded.

    Comments, declarations and the contents of scripts and the like are left out; an unfinished tag
    or comment at the end of a page is dropped, as browsers do.
    """
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", html.unescape(page[at:])
            return
        if lt > at:
            yield "text", "", html.unescape(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
        elif nxt in ("!", "?") or (nxt == "/" and not page[lt + 2 : lt + 3].isalpha()):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
        elif nxt == "/" or (nxt.isascii() and nxt.isalpha()):
            match = _TAG.match(page, lt)
            if match is None:  # a quote that never ends: the next bracket ends the tag
                close = page.find(">", lt)
                if close < 0:
                    return
                parts = page[lt + 1 : close].lstrip("/").split(None, 1)
                name, data, at = parts[0].lower(), parts[1] if len(parts) > 1 else "", close + 1
            else:
                name, data, at = match[2].lower(), match[3], match.end()
            if nxt == "/":
                yield "close", name, ""
                continue
            yield "open", name, data
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
                at = close.start() if close else end
        else:
            yield "text", "", "<"
            at = lt + 1


def key_of(name: str, data: str) -> str:
    """An element's name with its classes, id and role: what tells it from others in a wrapper."""
    if "=" not in data:
        return name
    names = [f"{kind.lower()}={value.strip('\"').strip(chr(39))}" for kind, value in _NAMES.findall(data)]
    # Numbers in names count items; they do not make another kind of element.
    key = re.sub(r"\d+", "0", " ".join([name, *sorted(names)])) if names else name
    return key if len(key) <= LONGEST_KEY else _short(key)


def _short(key: str) -> str:
    """A key by its digest, in digits, with what tells whether the element is aside or a main region."""
    digest = int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "big")
    hint = {ASIDE: "aside-0", SUSPECT: "aside-of-0"}.get(hint_of(key))
    marks = [*([f"class={hint}"] if hint else []), *(["role=main"] if is_main(key) else [])]
    return " ".join([key.partition(" ")[0], f"#{digest}", *marks])


@dataclass
class Element:
    """One place of a wrapper: an element, a text slot (key TEXT) or a group of siblings (key GROUP).

    Trees are as deep as pages are nested, so nothing here recurses.
    """

    key: str
    children: list[Element] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    constant: str | None = None  # of a text slot: digest of the text that all pages have
    pending: list[list[Element]] | None = None  # sequences of children that are still to be aligned

    def copy(self) -> Element:
        """Another element with the same children."""
        return Element(self.key, self.children, self.optional, self.repeated, self.constant, self.pending)

    def _mark(self) -> str:
        return "+" if self.repeated and not self.optional else "*" if self.repeated else "?" if self.optional else ""

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            mark = node._mark()
            if node.key == TEXT:
                begin, end = TEXT if node.constant is None else "#same", ""
            elif node.key == GROUP:
                begin, end = "(", ")" + mark
            else:
                begin, end = f"<{node.key}>", f"</{node.key.split()[0]}>"
            if mark and node.key != GROUP:
                begin, end = "(" + begin, end + ")" + mark
            out.append(begin)
            todo += [end, *reversed(node.children)]
        return "".join(out)

    def pack(self) -> list:
        """All places in the order of the page: depth, key, marks and constant of each."""
        flat, todo = [], [(0, self)]
        while todo:
            depth, node = todo.pop()
            flat.append([depth, node.key, int(node.optional) + 2 * int(node.repeated), node.constant])
            todo += [(depth + 1, child) for child in reversed(node.children)]
        return flat

    @staticmethod
    def unpack(flat: list) -> Element:
        above: list[Element] = []
        for depth, key, marks, constant in flat:
            node = Element(key, [], bool(marks & 1), bool(marks & 2), constant)
            del above[depth:]
            if above:
                above[-1].children.append(node)
            above.append(node)
        return above[0]


def walk(page: str):
    """Open and close events of a page as a tree: ('open', key, name), ('close',), ('text', value), ('void', name)."""
    stack: list[str] = []
    is_open: Counter[str] = Counter()
    for kind, name, data in tokens(page):
        if kind == "text":
            yield ("text", data)
        elif kind == "open":
            if name in VOID:
                yield ("void", name)
                continue
            ended: int | None = None
            if name in CLOSES_P and is_open["p"]:
                ended = len(stack) - 1 - stack[::-1].index("p")
                if not {"table", "button", "object"}.isdisjoint(stack[ended:]):
                    ended = None
            elif name in ENDS:
                ending, stops = ENDS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in stops:
                        break
                    if stack[i] in ending:
                        ended = i
                        break
            if ended is not None:
                while len(stack) > ended:
                    is_open[stack.pop()] -= 1
                    yield ("close",)
            stack.append(name)
            is_open[name] += 1
            yield ("open", key_of(name, data), name)
        elif is_open[name]:
            ended_name = None
            while ended_name != name:
                ended_name = stack.pop()
                is_open[ended_name] -= 1
                yield ("close",)
        elif name == "p":
            yield ("void", "br")
    for _ in stack:
        yield ("close",)


def _digest(text: str) -> str:
    return blake2b(text.encode(), digest_size=6).hexdigest()


def page_wrapper(page: str | list) -> Element:
    """The wrapper of a single page (or of its events): its tree with repeated siblings folded."""
    root = Element("")
    stack = [root]
    for event in walk(page) if isinstance(page, str) else page:
        if event[0] == "open":
            child = Element(event[1])
            stack[-1].children.append(child)
            stack.append(child)
        elif event[0] == "close":
            done = stack.pop()
            done.children = fold(done.children)
        elif event[0] == "text" and (text := _SPACE.sub(" ", event[1]).strip()):
            siblings = stack[-1].children
            if siblings and siblings[-1].key == TEXT:
                siblings[-1].constant = None
            else:
                siblings.append(Element(TEXT, constant=_digest(text)))
    root.children = fold(root.children)
    return root


def fold(children: list[Element]) -> list[Element]:
    """Replace adjacent repetitions of up to LONGEST_PERIOD siblings by one repeated group."""
    for period in range(1, LONGEST_PERIOD + 1):
        if len(children) < 2 * period:
            break
        out: list[Element] = []
        i = 0
        while i < len(children):
            keys = [c.key for c in children[i : i + period]]
            times = 1
            while len(keys) == period and [c.key for c in children[i + times * period : i + (times + 1) * period]] == keys:
                times += 1
            if times == 1 or (period > 1 and len(set(keys)) == 1):
                out.append(children[i])
                i += 1
                continue
            merged = children[i : i + period]
            for k in range(1, times):
                following = children[i + k * period : i + (k + 1) * period]
                merged = [merge(a, b) for a, b in zip(merged, following, strict=True)]
            if period == 1:
                merged[0].repeated = True
                out.append(merged[0])
            else:
                out.append(Element(GROUP, merged, repeated=True))
            i += times * period
        children = out
    return children


def merge(a: Element, b: Element) -> Element:
    """The wrapper that accepts what either accepts; both have the same key."""
    whole = _joined(a, b)
    todo = [whole]
    while todo:
        node = todo.pop()
        if node.pending is not None:
            sequences, node.pending = node.pending, None
            node.children = sequences[0]
            for other in sequences[1:]:
                node.children = align(node.children, other)
            todo += node.children
    return whole


def _joined(a: Element, b: Element) -> Element:
    """An element in the place of both, whose children are still to be aligned."""
    constant = a.constant if a.constant == b.constant else None
    pending = [sequence for e in (a, b) for sequence in (e.pending if e.pending is not None else [e.children])]
    return Element(a.key, [], a.optional or b.optional, a.repeated or b.repeated, constant, pending)


def align(left: list[Element], right: list[Element]) -> list[Element]:
    """Align two sequences of siblings; a mismatch is resolved by the nearest place where both agree again.

    What lies before that place on either side becomes optional. Linear in the number of siblings. Children of the siblings are
    left for ``merge`` to align.
    """
    left, right = _regroup(left, right), _regroup(right, left)
    if [e.key for e in left] == [e.key for e in right]:
        return [_joined(a, b) for a, b in zip(left, right, strict=True)]
    places: dict[str, list[int]] = {}
    for j in range(len(right) - 1, -1, -1):
        places.setdefault(right[j].key, []).append(j)
    out: list[Element] = []
    j = 0

    def missing(element: Element) -> Element:
        element = element.copy()
        element.optional = True
        return element

    for element in left:
        waiting = places.get(element.key, [])
        while waiting and waiting[-1] < j:
            waiting.pop()
        if waiting:
            k = waiting.pop()
            out += map(missing, right[j:k])
            out.append(_joined(element, right[k]))
            j = k + 1
        else:
            out.append(missing(element))
    out += map(missing, right[j:])
    return _settle(_join_neighbours(out))


def _regroup(children: list[Element], other: list[Element]) -> list[Element]:
    """Write single occurrences of the groups that ``other`` has as groups too."""
    for group in other:
        keys = [c.key for c in group.children]
        if group.key != GROUP or any(c.key == GROUP for c in children):
            continue
        for i in range(len(children) - len(keys) + 1):
            if [c.key for c in children[i : i + len(keys)]] == keys:
                found = Element(GROUP, children[i : i + len(keys)])
                children = [*children[:i], found, *children[i + len(keys) :]]
                break
    return children


def _settle(children: list[Element]) -> list[Element]:
    """Siblings in too many orders become one repeated group of optional kinds, (A?B?C?)+, which accepts them all."""
    if len(children) <= LONGEST_SEQUENCE:
        return children
    kinds: dict[str, Element] = {}
    todo = list(children)
    while todo:
        child = todo.pop(0)
        if child.key == GROUP:
            todo = child.children + todo
        else:
            kinds[child.key] = _joined(kinds[child.key], child) if child.key in kinds else child.copy()
    for kind in kinds.values():
        kind.optional, kind.repeated = True, False
    return [Element(GROUP, list(kinds.values()), repeated=True)]


def _join_neighbours(children: list[Element]) -> list[Element]:
    """Neighbours of one key that alignment has put side by side are one repeated group."""
    out: list[Element] = []
    for child in children:
        if out and out[-1].key == child.key and child.key != GROUP:
            optional = out[-1].optional and child.optional
            out[-1] = _joined(out[-1], child)
            out[-1].optional, out[-1].repeated = optional, child.key != TEXT
        else:
            out.append(child)
    return out


def _words(names: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"\b(class|id|role)=", " ", names).lower())) - {""}


PLAIN, ASIDE, SUSPECT = 0, 1, 2


@lru_cache(maxsize=100_000)
def hint_of(key: str) -> int:
    """What the names of an element say: ASIDE if a name consists of aside words (and neutral ones), SUSPECT if one is among others."""
    hint = PLAIN
    for name in re.sub(r"\b(class|id|role)=", " ", key.partition(" ")[2]).split():
        words = _words(name)
        if words & ASIDE_WORDS:
            hint = ASIDE if words <= ASIDE_WORDS | NEUTRAL_WORDS else max(hint, SUSPECT)
        if hint == ASIDE:
            break
    return hint


@lru_cache(maxsize=100_000)
def is_main(key: str) -> bool:
    name, _, names = key.partition(" ")
    return name in MAIN_TAGS or "role=main" in names


@lru_cache(maxsize=200_000)
def path_of(parent: str, key: str) -> str:
    """A place as a digest of the elements from the root: as long for deep pages as for others."""
    return blake2b(f"{parent}>{key}".encode(), digest_size=9).hexdigest()


def around_main(events: list) -> set[int]:
    """Numbers of the events that open an element which holds a main region."""
    holds: set[int] = set()
    stack: list[int] = []
    for number, event in enumerate(events):
        if event[0] == "open":
            if is_main(event[1]):
                for above in reversed(stack):
                    if above in holds:
                        break
                    holds.add(above)
            stack.append(number)
        elif event[0] == "close":
            stack.pop()
    return holds


class Reader:
    """Reads a page along its places. ``aside`` are suspect places that the host's pages have shown to be beside the article."""

    def __init__(self, page: str | list, aside: frozenset[str] = frozenset()):
        self.events = list(walk(page)) if isinstance(page, str) else page
        self.aside = aside
        self.holds = around_main(self.events)
        self.lines, self.has_main, self.suspects = self._read(set())
        if not self.has_main and self.holds:
            # The only main region is inside something that its names call aside: they are about its surroundings.
            self.lines, self.has_main, self.suspects = self._read(self.holds)

    def _is_aside(self, number: int, key: str, name: str, main: bool, path: str, spared: set[int]) -> bool:
        holds = number in self.holds
        if name in ASIDE_TAGS or name == "header":
            if name not in AROUND_TAGS or not (holds or (name == "header" and main)):
                return True
        if name in ("html", "body", "article", "main") or (main and name in HEADINGS) or number in spared:
            return False
        hint = hint_of(key)
        return hint == ASIDE or (hint == SUSPECT and path in self.aside and not holds)

    def _read(self, spared: set[int]) -> tuple[list, bool, dict]:
        """(place, in a main region, line) of each line that is not aside, whether there is a main region, and of

        suspect places: characters, those in links, and digests of the texts. One line per block, white space made single spaces.
        """
        lines: list[tuple[str, bool, str]] = []
        parts: list[str] = []
        begins: list[tuple[str, bool]] = []
        suspects: dict[str, list] = {}
        open_suspects: list[tuple[str, list]] = []
        has_main, links = False, 0

        def flush() -> None:
            if parts and (line := _SPACE.sub(" ", "".join(parts)).strip()):
                lines.append((*begins[0], line))
            parts.clear()
            begins.clear()

        stack = [("", "", "", False, False, False)]  # place, name, place of the block, aside, main, whether suspect
        for number, event in enumerate(self.events):
            place, name, block, aside, main, suspect = stack[-1]
            if event[0] == "text":
                if not aside:
                    if not event[1].isspace():
                        begins.append((block, main))
                    if begins or parts:
                        parts.append(event[1])
                    for _, gathered in open_suspects:
                        gathered.append(event[1] if not links else (event[1],))
            elif event[0] == "open":
                key, name = event[1], event[2]
                if name in BLOCKS:
                    flush()
                elif name in ("td", "th"):
                    parts.append(" ")
                links += name == "a"
                path = path_of(place, key)
                aside = aside or self._is_aside(number, key, name, main, path, spared)
                main = main or (not aside and is_main(key))
                has_main = has_main or main
                doubtful = not aside and hint_of(key) == SUSPECT and number not in self.holds and name not in HEADINGS
                if doubtful:
                    open_suspects.append((path, []))
                stack.append((path, name, path if name in BLOCKS else block, aside, main, doubtful))
            elif event[0] == "close":
                stack.pop()
                links -= name == "a"
                if name in BLOCKS:
                    flush()
                if suspect:
                    path, gathered = open_suspects.pop()
                    _note(suspects, path, gathered)
            elif event[1] == "br":
                parts.append(" ")
            elif event[1] == "hr":
                flush()
        flush()
        return lines, has_main, suspects

    def text(self, same: dict[str, frozenset[str]]) -> str:
        """The article; ``same`` has the digests of lines that a place has on all pages of the host."""
        if self.has_main:
            return "\n".join(line for _, main, line in self.lines if main)
        own = [line for place, _, line in self.lines if place not in same or _digest(line) not in same[place]]
        return "\n".join(own or [line for _, _, line in self.lines])


def _note(suspects: dict[str, list], path: str, gathered: list) -> None:
    chars = links = 0
    for piece in gathered:
        size = len((piece if isinstance(piece, str) else piece[0]).strip())
        chars += size
        links += 0 if isinstance(piece, str) else size
    whole = _SPACE.sub(" ", "".join(piece if isinstance(piece, str) else piece[0] for piece in gathered)).strip()
    known = suspects.setdefault(path, [0, 0, set()])
    known[0] += chars
    known[1] += links
    known[2].add(_digest(whole))


@dataclass
class Places:
    """What the places of a wrapper hold on all pages.

    lines: place -> smallest and largest digest of the pages that have it, and digests of the lines all of them have there.
    suspects: place -> the same of the pages, characters, those in links, and digests of the texts all of them have.
    """

    lines: dict[str, list] = field(default_factory=dict)
    suspects: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def of(page: str, reader: Reader) -> Places:
        mark, found = _digest(page), Places()
        for place, _, line in reader.lines:
            found.lines.setdefault(place, [mark, mark, set()])[2].add(_digest(line))
        for place, (chars, links, texts) in reader.suspects.items():
            found.suspects[place] = [mark, mark, chars, links, texts]
        return found

    def add(self, other: Places) -> Places:
        """The places of both; in any order of pages the result is the same, and repeated pages change no decision."""
        for mine, theirs in ((self.lines, other.lines), (self.suspects, other.suspects)):
            for place, facts in theirs.items():
                if (own := mine.get(place)) is None:
                    mine[place] = facts
                else:
                    between = [a + b for a, b in zip(own[2:-1], facts[2:-1], strict=True)]
                    mine[place] = [min(own[0], facts[0]), max(own[1], facts[1]), *between, own[-1] & facts[-1]]
        return self

    def pack(self) -> str:
        plain = lambda table: {place: [*facts[:-1], sorted(facts[-1])] for place, facts in sorted(table.items())}
        return json.dumps([plain(self.lines), plain(self.suspects)], separators=(",", ":"))

    @staticmethod
    def unpack(packed: str) -> Places:
        return Places(*({place: [*facts[:-1], set(facts[-1])] for place, facts in table.items()} for table in json.loads(packed)))

    def same(self) -> dict[str, list[str]]:
        """Digests of the lines that at least two different pages, and all that have their place, have there."""
        return {place: sorted(lines) for place, (low, high, lines) in sorted(self.lines.items()) if low != high and lines}

    def aside(self) -> list[str]:
        """Suspect places whose text is mostly links, or the same on all of at least two different pages."""
        return sorted(
            place
            for place, (low, high, chars, links, texts) in self.suspects.items()
            if (chars and 2 * links >= chars) or (low != high and texts)
        )


def page_text(page: str, places: Places | None = None) -> str:
    """The article of a page of a host whose pages have ``places`` in common."""
    if places is None:
        return Reader(page).text({})
    same = {place: frozenset(lines) for place, lines in places.same().items()}
    return Reader(page, frozenset(places.aside())).text(same)


Partial = tuple[Element, Places]


def _rows(found: dict[str, Partial]) -> pa.RecordBatch:
    packed = [json.dumps(element.pack(), separators=(",", ":")) for element, _ in found.values()]
    places = [p.pack() for _, p in found.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(packed, pa.string()), pa.array(places, pa.string())],
        ["host", "wrapper", "places"],
    )


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper and places (packed), expression, same and aside (JSON) from host, html of all pages."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Partial] = {}
        for batch in slices(batches, 64):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = page or ""
                reader = Reader(page)
                new, places = page_wrapper(reader.events), Places.of(page, reader)
                found[host] = (merge(found[host][0], new), found[host][1].add(places)) if host in found else (new, places)
            if len(found) > HELD_HOSTS:
                yield _rows(found)
                found = {}
        if found:
            yield _rows(found)

    def combine(table):  # Spark tells the kind of function by its hints: none, or all
        merged: Element | None = None
        for packed in dict.fromkeys(table.column("wrapper").to_pylist()):
            other = Element.unpack(json.loads(packed))
            merged = other if merged is None else merge(merged, other)
        places = Places()
        for packed in table.column("places").to_pylist():
            places.add(Places.unpack(packed))
        return pa.Table.from_batches([_rows({table.column("host")[0].as_py(): (merged, places)})])

    schema = "host string, wrapper string, places string"
    partial = pages.select("host", "html").mapInArrow(own, schema)
    salt = F.pmod(F.hash("wrapper"), F.lit(SALTS))
    salted = partial.groupBy("host", salt.alias("salt")).applyInArrow(combine, schema)
    whole = salted.groupBy("host").applyInArrow(combine, schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = [Element.unpack(json.loads(p)) for p in batch.column("wrapper").to_pylist()]
            places = [Places.unpack(p) for p in batch.column("places").to_pylist()]
            told = {
                "expression": ["".join(map(str, w.children)) for w in wrappers],
                "same": [json.dumps(p.same()) for p in places],
                "aside": [json.dumps(p.aside()) for p in places],
            }
            columns = [*(batch.column(c) for c in ("host", "wrapper", "places")), *(pa.array(v, pa.string()) for v in told.values())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "places", *told])

    return whole.mapInArrow(tell, f"{schema}, expression string, same string, aside string")


def host_of(url):
    """The host of a URL column in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    A null or empty page has the empty text. Pages without a usable URL form a host of their own.
    Repeated pages change nothing: a wrapper of equal pages is that of one. Only page_id, url and html are read.
    """
    rows = pages.select("page_id", "url", "html", host_of(pages["url"]).alias("host"))
    wrappers = stored(infer(rows).select("host", "same", "aside"), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("same") + F.octet_length("aside") + F.lit(100))).first()[0]
    side = F.broadcast(wrappers) if (size or 0) <= BROADCAST_BYTES else wrappers
    told = rows.join(side, "host", "left").select("page_id", "url", "html", "same", "aside")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in slices(batches, 64):
            texts = []
            columns = (batch.column(c).to_pylist() for c in ("html", "same", "aside"))
            for page, *told in zip(*columns, strict=True):
                if tuple(told) not in known:
                    if len(known) > HELD_HOSTS:
                        known.clear()
                    same, aside = (json.loads(t) if t else {} for t in told)
                    known[tuple(told)] = {place: frozenset(lines) for place, lines in same.items()}, frozenset(aside)
                same, aside = known[tuple(told)]
                texts.append(Reader(page or "", aside).text(same))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return told.mapInArrow(apply, f"page_id {kind}, url string, text string, n_chars long")
