"""HTML extraction by wrappers: union-free regular expressions over token streams of one host.

Pages of a host are aligned one after another to one expression (after
RoadRunner, Crescenzi et al., 2001).  A token that the expression has further
back begins a repeated group, a token that it lacks, or that a page lacks, is
an optional group, and texts that differ are slots.  A host that is dealt over
several tasks has the expressions of its parts aligned in turn.

The expression then says where the article is: what counts is text in slots
(a text that is the same on pages that differ belongs to the template) outside
links and outside of what HTML itself sets apart (nav, footer, header, aside,
form).  Words in class names only weigh where that leaves two parts close.
"""

from __future__ import annotations

import html as entities
import marshal
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import materialize, shuffle_partitions
from waymark.llm.url_filters import split_url

#: Pages of a host that one task aligns; parts of a host that one task aligns in turn; hosts of more pages that may be broadcast.
SLICE, PARTS, HOT_HOSTS = 256, 256, 100_000
#: A text is a constant of the template if it is equal on all pages of a host, and on at least so many whose content differs.
CONSTANT_PAGES = 3
#: The share of the text in slots with which a part leads the others; the share with which <article> or <main> is believed.
LEADS, BELIEVED = 0.7, 0.1
#: What class names make of a part's text, beside an article or around it; the share of linked text from which a list is a menu.
BESIDE, AROUND, MENU = 0.25, 2.0, 0.8

# Names of HTML elements and of roles.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_RAW = {"script", "style"}
_HIDDEN = {"noscript", "template", "iframe", "object", "svg", "canvas", "title", "audio", "video", "textarea"}
_OUTSIDE = {"nav", "footer", "header", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head"}
_OUTSIDE_ROLES = {"role=navigation", "role=banner", "role=complementary", "role=contentinfo", "role=search", "role=dialog", "role=alert", "role=menu"}
_MAIN_MARKS = {"role=main", "role=article", "itemprop=articlebody"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_P_ENDS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_P_WALLS = ("td", "th", "li", "div", "section", "article", "button")
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_LISTS = {"ul", "ol", "dl", "table"}
# Whole class names and identifiers that tell what stands beside an article, and what stands around it.
_BESIDE = re.compile(
    r"(?:ad|ads|advert|adverts|advertisement|advertising|adslot|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|menu|navbar|navigation|nav|breadcrumbs?|sidebar|side-bar|footer|header|masthead|share|sharing|social|related|recommended|recommendations|comments?|commentlist|disqus|replies|respond|widgets?|pager|pagination|toolbar)"
    r"|(?:ads?|advert|cookies?|share|sharing|social|comments?|related|newsletter|promo|sponsor|sidebar|nav|menu|footer|breadcrumbs?)[-_](?:box|bar|banner|block|wrap|wrapper|container|list|links|icons|buttons?|section|area|slot|unit|items?|posts?|articles?|stories|notice|consent|form|widget|thread|menu|nav)"
    r"|(?:site|page|top|bottom|left|right|primary|secondary|global)[-_](?:nav|navigation|menu|footer|header|sidebar|ads?|banner|notice)|(?:post|article|reader|user)[-_](?:comments|share|ads?)"
)
_AROUND = re.compile(r"(?:article|post|entry|story|main)(?:[-_](?:body|content|text))?|content|articlebody")

_TAG = re.compile(r"</?([a-zA-Z][-\w:]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?![-\w:])", re.I) for tag in _RAW | _HIDDEN}


class Kind:
    """What a label says by itself."""

    __slots__ = ("tag", "outside", "main", "factor")

    def __init__(self, label: str):
        self.tag, _, marks = label.partition(" ")
        words = marks.split()
        self.main = self.tag in ("article", "main") or any(w in _MAIN_MARKS for w in words)
        self.outside = not self.main and (self.tag in _OUTSIDE or any(w in _OUTSIDE_ROLES for w in words))
        beside = self.tag not in ("html", "body") and not self.main and any(map(_BESIDE.fullmatch, words))
        self.factor = BESIDE if beside else AROUND if any(map(_AROUND.fullmatch, words)) else 1.0


_kinds: dict[str, Kind] = {}


def kind(label: str) -> Kind:
    if label not in _kinds:
        if len(_kinds) > 100_000:
            _kinds.clear()
        _kinds[label] = Kind(label)
    return _kinds[label]


def _label(tag: str, attributes: str) -> str:
    """Tag and marks; numbers in marks are all alike."""
    marks = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        prefix = f"{name.lower()}=" if name.lower() in ("role", "itemprop") else ""
        marks += [prefix + w for w in "".join(values).lower().split()]
    return " ".join([tag, *(re.sub(r"\d+", "#", m) for m in marks)])


def parse(text: str) -> list:
    """A page's events: (label,) opens a block, None closes one, (text, linked characters) is a block of text.

    Inline markup melts into the text around it, hidden elements are left out.
    Time and memory are in proportion to the page, whatever it holds.
    """
    events: list = []
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    run: list[str] = []
    linked: list[str] = []
    unclosed: set[str] = set()
    in_link = False
    lasts = {q: text.rfind(q) for q in "\"'>"}

    def flush():
        if run:
            said = " ".join(entities.unescape("".join(run)).split())
            if said:
                events.append((said, len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0))
            run.clear()
            linked.clear()

    def say(raw):
        run.append(raw)
        if in_link:
            linked.append(raw)

    def close_to(at):
        nonlocal in_link
        while len(stack) > at:
            places[stack.pop()].pop()
            events.append(None)
        in_link = False

    def innermost(tags):
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def tag_end(at):
        i = at
        while m := _STOP.search(text, i):
            if m.group() == ">":
                return m.start()
            if text[max(at, m.start() - 9) : m.start()].rstrip().endswith("="):
                if m.start() >= lasts[m.group()]:
                    break  # a quote that is never closed
                i = text.index(m.group(), m.start() + 1) + 1
            else:
                i = m.start() + 1
        return text.find(">", at)

    pos = 0
    while pos < len(text):
        at = text.find("<", pos)
        if at < 0:
            say(text[pos:])
            break
        if at > pos:
            say(text[pos:at])
        if text.startswith(("<!", "<?"), at):
            end = "-->" if text.startswith("<!--", at) else "]]>" if text.startswith("<![CDATA[", at) else ">"
            end_at = text.find(end, at + 2)
            pos = end_at + len(end) if end_at >= 0 else len(text)
            continue
        m = _TAG.match(text, at)
        if not m or at > lasts[">"]:
            say("<")
            pos = at + 1
            continue
        tag, end = m.group(1).lower(), tag_end(m.end())
        attributes, pos = text[m.end() : end], end + 1
        if text[at + 1] == "/":
            if tag == "a":
                in_link = False
            elif tag not in _INLINE and tag not in _VOID and places.get(tag):
                flush()
                close_to(places[tag][-1])
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in _INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in _RAW or tag in _HIDDEN:
            flush()
            if not attributes.endswith("/") and tag not in unclosed:
                if closing := _ENDS[tag].search(text, pos):
                    end = text.find(">", closing.end())
                    pos = end + 1 if end >= 0 else len(text)
                elif tag in _RAW:
                    pos = len(text)
                else:
                    unclosed.add(tag)
            continue
        flush()
        if tag in _P_ENDS and (p := innermost(("p",))) > innermost(_P_WALLS):
            close_to(p)
        if tag in _CLOSES:
            ends, walls = _CLOSES[tag]
            wall = innermost(walls)
            own = [places[t] for t in ends if places.get(t)]
            if first := [min(i for i in o if i > wall) for o in own if o[-1] > wall]:
                close_to(min(first))
        events.append((_label(tag, attributes) if attributes else tag,))
        if attributes.endswith("/"):
            events.append(None)
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
    flush()
    close_to(0)
    return events


def content(events: list) -> int:
    """A digest of a page's blocks and texts; markup that says nothing doesn't count."""
    held = xxhash.xxh64()
    for e in events:
        held.update(b"\2" if e is None else (b"\1" if len(e) == 1 else b"\0") + e[0].encode("utf-8", "surrogatepass"))
    return held.intdigest()


class Group:
    """A part of an expression: a label with its parts, or a text; once, optional or repeated."""

    __slots__ = ("label", "parts", "order", "runs", "instances", "present", "repeated", "text", "pages", "chars", "linked", "weight", "main", "first", "following", "up")

    def __init__(self, label: str, order: float = 0.0):
        self.label, self.order = label, order
        self.parts: dict[str, Group] = {}
        self.first: Group | None = None  # the parts in order: the first, and what follows each
        self.following: Group | None = None
        self.up: Group | None = None  # what holds it, once the expression is complete
        self.runs: set[tuple[str, str]] = set()  # first and last part of what is repeated together
        self.instances = self.present = 0  # how often it occurs, and in how many occurrences of what holds it
        self.repeated = False
        self.text: str | None = None  # of a text: its constant, None for a slot
        self.pages: tuple[int, ...] = ()  # of a text: digests of pages that hold it, as many as tell a constant
        self.chars = self.linked = 0  # of texts, all of them once the expression is complete
        self.weight, self.main = 0.0, False

    def ordered(self) -> list[Group]:
        out, p = [], self.first
        while p is not None:
            out.append(p)
            p = p.following
        return out

    def add(self, label: str, after: Group | None) -> Group:
        """A new part right after another, or the first."""
        part = self.parts[label] = Group(label)
        if after is None:
            self.first, part.following = part, self.first
        else:
            after.following, part.following = part, after.following
        lower, upper = after.order if after else 0.0, part.following.order if part.following else None
        part.order = lower + 1.0 if upper is None else lower + (upper - lower) / 64  # the next one mostly comes after this one
        if upper is not None and not lower < part.order < upper:
            for i, p in enumerate(self.ordered()):
                p.order = float(i + 1)
        return part

    def constant(self) -> bool:
        return self.text is not None and len(self.pages) >= CONSTANT_PAGES

    def __str__(self):
        if self.label == "#text":
            return "#text" if self.text is None else repr(self.text)
        ordered = self.ordered()
        place = {p.label: i for i, p in enumerate(ordered)}
        spans: list[list[int]] = []
        for lo, hi in sorted((place[a], place[b]) for a, b in self.runs):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        said = []
        for i, p in enumerate(ordered):
            together = any(lo <= i <= hi for lo, hi in spans)
            optional, repeated = p.present < self.instances, p.repeated and not together
            body = f"<{p.label}>{p}</>" if p.label != "#text" else str(p)
            body = f"({body}){'*' if optional else '+'}" if repeated else f"({body})?" if optional else body
            said.append("(" * any(i == lo for lo, _ in spans) + body + ")+" * any(i == hi for _, hi in spans))
        inner = " ".join(said)
        return inner if self.label != "#page" else f"<#page>{inner}</>"


class _Cursor:
    """An occurrence of a group that is being aligned."""

    __slots__ = ("group", "last", "seen")

    def __init__(self, group: Group):
        self.group, self.last, self.seen = group, None, set()

    def step(self, label: str) -> Group:
        """The part that a token aligns with."""
        g, part = self.group, self.group.parts.get(label)
        if part is None:
            part = g.add(label, self.last)
        elif self.last is not None and part.order < self.last.order:
            g.runs.add((label, self.last.label))
        if label in self.seen:
            part.repeated = True
        else:
            self.seen.add(label)
            part.present += 1
        part.instances += 1
        self.last = part
        return part


def _say(part: Group, text: str | None, pages: tuple, chars: int, linked: int) -> None:
    part.text = text if not part.chars or part.text == text else None
    if part.pages != pages:
        part.pages = tuple(sorted({*part.pages, *pages})[:CONSTANT_PAGES])
    part.chars += chars
    part.linked += linked


def align(wrapper: Group, events: list) -> None:
    """Align a page's events to an expression."""
    page = (content(events),)
    wrapper.instances += 1
    stack = [_Cursor(wrapper)]
    for e in events:
        if e is None:
            stack.pop()
        elif len(e) == 1:
            stack.append(_Cursor(stack[-1].step(e[0])))
        else:
            _say(stack[-1].step("#text"), e[0], page, len(e[0]), e[1])


def merge(a: Group, b: Group) -> None:
    """Align an expression to another."""
    a.instances += b.instances
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        x.runs |= y.runs
        last = None
        for p in y.ordered():
            own = x.parts.get(p.label)
            if own is None:
                own = x.add(p.label, last)
            elif last is not None and own.order < last.order:
                x.runs.add((p.label, last.label))
            if p.label == "#text":
                _say(own, p.text, p.pages, p.chars, p.linked)
            own.present += p.present
            own.instances += p.instances
            own.repeated |= p.repeated
            last = own
            stack.append((own, p))


def infer(pages: list[list]) -> Group:
    """The wrapper of pages, complete."""
    wrapper = Group("#page")
    for events in pages:
        align(wrapper, events)
    return complete(wrapper)


def _preorder(wrapper: Group) -> list[Group]:
    out, stack = [], [wrapper]
    while stack:
        g = stack.pop()
        out.append(g)
        stack += reversed(g.ordered())
    return out


def dump(wrapper: Group) -> bytes:
    """A wrapper (not yet completed) as bytes: its groups in order, each with its number of parts."""
    return marshal.dumps([(g.label, g.instances, g.present, g.repeated, g.text, g.pages, g.chars, g.linked, sorted(g.runs), len(g.parts)) for g in _preorder(wrapper)])


def load(data: bytes) -> Group:
    root, stack = None, []
    for label, instances, present, repeated, text, pages, chars, linked, runs, parts in marshal.loads(data):
        g = Group(label)
        g.instances, g.present, g.repeated, g.text, g.pages, g.chars, g.linked, g.runs = instances, present, repeated, text, pages, chars, linked, {tuple(r) for r in runs}
        if stack:
            holder = stack[-1]
            g.order = float(len(holder[0].parts) + 1)
            holder[0].parts[label] = g
            if holder[2] is None:
                holder[0].first = g
            else:
                holder[2].following = g
            holder[1], holder[2] = holder[1] - 1, g
        else:
            root = g
        stack.append([g, parts, None])
        while stack and not stack[-1][1]:
            stack.pop()
    return root


def complete(wrapper: Group) -> Group:
    """Sum texts over the parts of an expression: characters, linked ones, and the weight of unlinked text in slots outside of what HTML sets apart."""
    for g in reversed(_preorder(wrapper)):
        if g.label == "#text":
            g.weight = 0.0 if g.constant() else float(max(0, g.chars - g.linked))
            continue
        parts = g.parts.values()
        for p in parts:
            p.up = g
        g.chars, g.linked = sum(p.chars for p in parts), sum(p.linked for p in parts)
        g.weight = sum((p.weight for p in parts if not outside(p)), 0.0)
        g.main = kind(g.label).main or any(p.main for p in parts)
    return wrapper


def outside(g: Group) -> bool:
    """Set apart by HTML, unless it holds the article."""
    return g.label != "#text" and kind(g.label).outside and not g.main


def article(wrapper: Group) -> list[Group]:
    """The groups on the way to the part that holds the article (none: the whole page)."""
    here = wrapper
    while True:  # what HTML calls the article, if it holds a part of the text worth mentioning
        found, stack = [], [here]
        while stack:
            for p in stack.pop().parts.values():
                if p.main and not outside(p):
                    (found if kind(p.label).main else stack).append(p)
        best = max(found, key=lambda p: (p.weight, p.label), default=None)
        inside = here is not wrapper
        if best is None or best.weight <= (LEADS if inside else BELIEVED) * here.weight or inside and best.repeated:
            break
        here = best
    while here is wrapper or not kind(here.label).main:  # else go down while one part holds nearly all text and isn't itself a paragraph
        inner = [(p.weight * kind(p.label).factor, p) for p in here.parts.values() if p.label != "#text" and not outside(p)]
        top, part = max(inner, key=lambda x: (x[0], x[1].label), default=(0, None))
        total = sum(w for w, _ in inner) + (here.parts["#text"].weight if "#text" in here.parts else 0)
        if part is None or not top or top < LEADS * total or part.repeated or set(part.parts) <= {"#text"} or kind(part.label).main:
            break
        here = part
    path = []
    while here is not wrapper:
        path.append(here)
        here = here.up
    return path[::-1]


def _menu(g: Group) -> bool:
    return kind(g.label).tag in _LISTS and g.chars > 0 and g.linked >= MENU * g.chars


def _read(events: list, wrapper: Group, path: list[Group]) -> list[str]:
    region = path[-1] if path else wrapper
    said_by_html = kind(region.label).main
    out: list[str] = []
    # of each open block: its group, how far along the path it is (the length of the path: inside), and its tag
    stack = [(wrapper, 0, "")]
    skipped = 0
    for e in events:
        if e is None:
            if skipped:
                skipped -= 1
            else:
                stack.pop()
        elif skipped:
            skipped += len(e) == 1
        elif len(e) == 2:
            group, depth, tag = stack[-1]
            slot = group.parts.get("#text")
            if depth == len(path) and (slot is None or not slot.constant() or said_by_html and tag in _HEADINGS):
                out.append(e[0])
        else:
            group, depth, _ = stack[-1]
            part = group.parts.get(e[0])
            if depth < len(path):
                enter = part is path[depth]
            else:
                enter = part is not None and not outside(part) and not _menu(part) and (kind(part.label).factor >= 1 or 2 * part.weight > region.weight)
            if enter:
                stack.append((part, min(depth + 1, len(path)), kind(part.label).tag))
            else:
                skipped = 1
    return out


def extract(events: list, wrapper: Group, path: list[Group] | None = None) -> list[str]:
    """The blocks of the article, read off a page by the wrapper of its host (complete), whose article is ``path``."""
    path = article(wrapper) if path is None else path
    found = _read(events, wrapper, path)
    if not found:  # a page built otherwise than its host: its own expression decides
        own = infer([events])
        found = _read(events, own, article(own))
    return found


_PARTS = ["host", "salt", "wrapper"]


def _part(host, salt, data):
    return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], names=_PARTS)


def _infer_parts(batches):
    """Rows (host, salt, page_id, url, html) in order of host and salt; the wrapper of each host and salt."""
    wrapper, key = None, None
    for b in batches:
        for host, salt, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 4)), strict=True):
            if (host, salt) != key:
                if wrapper is not None:
                    yield _part(*key, dump(wrapper))
                wrapper, key = Group("#page"), (host, salt)
            align(wrapper, parse(text or ""))
    if wrapper is not None:
        yield _part(*key, dump(wrapper))


def _merge_parts(batches):
    """Rows (host, part, salt, wrapper) in order of host and part; the wrapper of each of these, with one of its salts."""
    wrapper, key, own = None, None, 0
    for b in batches:
        for host, part, salt, data in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if (host, part) == key:
                merge(wrapper, load(data))
                continue
            if wrapper is not None:
                yield _part(key[0], own, dump(wrapper))
            wrapper, key, own = load(data), (host, part), salt
    if wrapper is not None:
        yield _part(key[0], own, dump(wrapper))


def _extract(batches):
    """Rows (page_id, url, html, wrapper) in order of host, whose first row alone has the wrapper."""
    wrapper, path = None, None
    for b in batches:
        texts = []
        for text, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if data is not None:
                wrapper = complete(load(data))
                path = article(wrapper)
            texts.append("\n\n".join(extract(parse(text or ""), wrapper, path)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text (blocks joined by two line feeds; empty if none), n_chars (its code points).

    Null html is empty.  Pages with null urls, or without a host, are aligned
    with one another; a page that is alone on its host is its own expression.
    Repeated rows stay repeated, null ids stay null, other columns are not
    read.  Character references are decoded, white space within a block is one
    space, markup that is never closed ends where HTML says or at the page's
    end; very long and very deep pages cost in proportion to their length.
    All pages of a host are aligned together; copies of a page, told by its
    blocks and texts, count as one where a text is judged a constant.
    """
    spark = pages.sparkSession
    host = split_url(F.col("url"))[0]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    hot = materialize(rows.groupBy("host").count().where(F.col("count") > SLICE).select("host", F.ceil(F.col("count") / SLICE).cast("int").alias("salts")), "hot")
    few = hot.limit(HOT_HOSTS + 1).count() <= HOT_HOSTS
    rows = rows.withColumn("place", F.xxhash64("page_id", F.monotonically_increasing_id()))
    rows = rows.join(F.broadcast(hot) if few else hot, "host", "left").withColumn("salt", F.pmod("place", F.coalesce("salts", F.lit(1))).cast("int"))
    ordered = rows.select("host", "salt", "page_id", "url", "html", "place").repartition(shuffle_partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", "place")
    parts = ordered.drop("place").mapInArrow(_infer_parts, "host string, salt int, wrapper binary")
    schema = "host string, salt int, wrapper binary"
    if not hot.isEmpty():
        # a wrapper for every PARTS parts of a host, then one of these for each host
        own = parts.select("host", F.floor(F.col("salt") / PARTS).cast("int").alias("part"), "salt", "wrapper")
        parts = own.repartition("host", "part").sortWithinPartitions("host", "part", "salt").mapInArrow(_merge_parts, schema)
        one = parts.select("host", F.lit(0).alias("part"), "salt", "wrapper")
        merged = one.repartition("host").sortWithinPartitions("host", "part", "salt").mapInArrow(_merge_parts, schema)
        merged = merged.drop("salt")
        merged = merged.join(F.broadcast(hot) if few else hot, "host", "left").select("host", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "wrapper")
    else:
        merged = parts
    # both uses of the pages read one shuffle; only the first row of each host and salt carries the wrapper to Python
    both = ordered.join(merged.hint("merge"), ["host", "salt"], "left")
    first = F.row_number().over(Window.partitionBy("host", "salt").orderBy("place")) == 1
    led = both.select("host", "salt", "page_id", "url", "html", F.when(first, F.col("wrapper")).alias("wrapper"))
    return led.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
