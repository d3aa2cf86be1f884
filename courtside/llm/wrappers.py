"""HTML extraction by wrappers: a union-free regular expression per host (operator 6).

A page is a stream of tokens: starts and ends of blocks, and texts. The streams of a host are aligned block
by block, and each mismatch is resolved the way that union-free expressions allow: a block that some have
and others don't becomes optional, one that stands in different numbers becomes a repeated group, blocks in
changing order become a repeated group of optional ones, and texts that differ become a slot. Texts that
don't differ are the template's. What comes out doesn't depend on the order of the pages, so the wrapper of
a host is made from partial wrappers in rounds, however many pages it has.

The main text of a page is what its host's wrapper has in the article, or in main where pages have no such element:
slots and what the template repeats between them, but no bars of links that are the same on all pages. Where pages have
neither, it is all slots and the headings beside them, without what else the template repeats.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import Scratch
from courtside.llm.urls import host_of

#: Partial wrappers that one task merges, and blocks that a task holds before it writes its partial wrappers.
FAN_IN, HELD = 64, 50_000
#: Blocks of one name side by side up to which their places are told apart; more are a repeated group at once.
PLACES = 8
#: Different labels of one element in one place; more are one block, whatever its label.
LABELS = 64
#: Blocks within blocks; what lies deeper counts to the block at this depth.
DEPTH = 100
#: A text is the template's on this many different pages, and on this share of those that have its place.
PAGES, SHARE = 3, 0.5
#: A place where this share of the text is in links is a menu.
LINKED = 0.8
#: Wrappers are broadcast up to this many characters together; else the join on the host shuffles.
BROADCAST_CHARS = 16_000_000

TEMPLATE = "array<struct<place:bigint,text:bigint>>"

# Element names of HTML, and names that mark furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary address".split())
FURNITURE = set("head nav footer aside form script style noscript template iframe button select dialog menu textarea svg object noembed noframes".split())
NAMES = set("ad ads advert advertisement adverts sponsor sponsored promo banner menu nav navbar navigation sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal comment comments reply replies disqus share sharing related newsletter subscribe login adsbygoogle gdpr respond".split())
#: Words that only say where or of what shape something is: a name of these and of NAMES is furniture too.
SHAPES = set("site page main top bottom left right box bar area wrap wrapper container block section list slot unit widget side global primary secondary header links icons buttons form item items thread post posts article articles user users story stories text inner outer".split())
HEADERS = set("header site-header page-header".split())
#: Names that a paragraph, heading or list item may have for its looks.
LOOKS = set("alert menu".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
#: An element of the key ends an open one of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}}
BOUNDS = set("ul ol dl table select".split())
ENDABLE = LEAF | {"tr", "thead", "option"}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
HIDDEN = re.compile(r"(?<![\w=-])hidden(?![\w-])", re.I)
UNSEEN = re.compile(r"""\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
REST = re.compile(r"""((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _named(word: str, besides: frozenset | set = frozenset()) -> bool:
    """Whether a class or an id names furniture: ``comments``, ``comment-list``, ``ad-slot-1``, not ``social-history``."""
    parts = [p for p in re.split(r"[-_]", word) if p and not p.isdigit()]
    return any(p in NAMES and p not in besides for p in parts) and all(p in NAMES or p in SHAPES for p in parts)


def furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form, script, style, comment list or hidden."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    low = attributes.lower()
    if "hidden" in low and HIDDEN.search(QUOTED.sub("=", attributes)) or "display" in low and UNSEEN.search(attributes):
        return True
    for key, *values in ATTRIBUTE.findall(attributes):
        words = next((v for v in values if v), "").lower().split()
        if key.lower() == "role":
            if ROLES.intersection(words):
                return True
        elif any(_named(w, LOOKS if name in LEAF else frozenset()) or w in HEADERS and not in_article for w in words):
            return True
    return False


def blocks(html: str) -> Iterator[tuple]:
    """Events of a page without its furniture: ("(", label), (")",) and ("#", text, characters of it in links).

    Every start has its end. Time is linear in the length of the page: what is open or unfinished is looked for once.
    """
    stack: list[tuple[str, bool]] = []  # (name, whether it is the root of furniture); inline elements are not kept
    open_: Counter = Counter()
    text: list[str] = []
    linked = links = junk = 0
    muted, within = "", 0  # an inline element that is furniture, and how many of its name are open in it
    quoted = True  # whether quotes of attributes can be trusted to be closed

    def flush():
        nonlocal linked
        words = entities.unescape("".join(text)).split() if text and not junk else None
        text.clear()
        here, linked = linked, 0
        if words:
            yield "#", " ".join(words), here

    def close(depth: int):
        nonlocal junk
        yield from flush()
        while len(stack) > depth:
            name, bad = stack.pop()
            open_[name] -= 1
            junk -= bad
            if not junk and not bad:
                yield (")",)

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            if not muted:
                text.append(html[at:start])
                if links:
                    linked += start - at
            at = start
            continue
        m = TAG.match(html, at)
        if m is None:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), at):
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            else:
                text.append("<")
                at += 1
            continue
        slash, name = m[1], m[2].lower()
        rest = REST.match(html, m.end()) if quoted else None
        if rest is not None:
            attributes, at = rest[1], rest.end()
        else:  # an open quote or tag to the end of the page
            quoted = False
            end = html.find(">", m.end())
            if end < 0:
                break
            attributes, at = html[m.end() : end], end + 1
        if muted:
            if name == muted:
                within += -1 if slash else 1
                muted = muted if within else ""
                continue
            if name in INLINE:
                continue
            if not slash:  # it holds blocks, so it is one
                yield from flush()
                stack.append((muted, True))
                open_[muted] += 1
                junk += 1
            muted = ""  # the end of a block ends what was left open
        if name in INLINE:
            if slash and open_[name]:
                yield from close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name == "br":
                text.append(" ")
            elif not slash and name not in VOID and attributes and furniture(name, attributes, open_["article"] > 0):
                muted, within = name, 1
            elif name == "a":
                links = 0 if slash else 1
            continue
        if slash:
            if open_[name]:
                yield from close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            else:
                yield from flush()
            links = 0
            continue
        yield from flush()
        links = 0
        if name in VOID:
            continue
        for k in range(len(stack) - 1, max(-1, len(stack) - 17), -1):  # implied ends, among the innermost elements
            if stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ()):
                yield from close(k)
                break
            if stack[k][0] in BOUNDS or stack[k][0] not in ENDABLE:
                break
        bad = furniture(name, attributes, open_["article"] > 0)
        stack.append((name, bad))
        open_[name] += 1
        junk += bad
        if not junk:
            label = next((next(v for v in values if v) for key, *values in ATTRIBUTE.findall(attributes) if key.lower() == "class" and any(values)), "") if attributes else ""
            first = re.sub(r"[^\w-]|\d", "", label.split()[0]) if label.split() else ""  # numbers in labels are the page's own
            yield "(", f"{name}.{first}" if first else name
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
            stop = end.start() if end else n
            if name in ("title", "textarea"):
                text.append(html[at:stop])
            at = stop
    yield from close(0)


# --- wrappers ---------------------------------------------------------------------------------------
#
# A block of a wrapper is {"n": how often it stands, "k": {label: [blocks that have it, number in each or 0, places]},
# "e": {label: labels that follow}}; a text is {"n", "c": characters, "l": those in links, "t": the text's hash or null
# where texts differ, "d": up to PAGES hashes of pages that have it}.


def _slot(text: str, linked: int, page: int) -> dict:
    return {"n": 1, "c": len(text), "l": min(linked, len(text)), "t": zlib.crc32(text.encode("utf-8", "replace")), "d": [page]}


def tree(html: str) -> dict:
    """The wrapper of one page: its blocks and texts as they stand."""
    events = list(blocks(html))
    page = zlib.crc32("\n".join(e[1] for e in events if e[0] == "#").encode("utf-8", "replace"))
    root: dict = {"n": 1, "k": {}, "e": {}}
    path, last, deeper = [root], ["^"], 0
    for kind, *more in events:
        if kind == ")":
            if deeper:
                deeper -= 1
            else:
                path.pop()
                last.pop()
            continue
        if kind == "(" and (deeper or len(path) > DEPTH):
            deeper += 1
            continue
        label = "#" if kind == "#" else more[0]
        new = _slot(*more, page) if kind == "#" else {"n": 1, "k": {}, "e": {}}
        kids, edges = path[-1]["k"], path[-1]["e"]
        if last[-1] != label and label not in (after := edges.setdefault(last[-1], [])):
            after.append(label)
        last[-1] = label
        kids.setdefault(label, [1, 0, []])[2].append(new)
        if kind == "(":
            path.append(new)
            last.append("^")
    return _settled(root)


def _settled(block: dict) -> dict:
    """Numbers of equal labels counted, and long rows of them folded."""
    todo = [block]
    found = []
    while todo:  # inner blocks last
        now = todo.pop()
        found.append(now)
        todo += [b for _, _, places in now.get("k", {}).values() for b in places]
    for now in reversed(found):
        for kid in now.get("k", {}).values():
            kid[1] = len(kid[2])
            if kid[1] > PLACES:
                _fold(kid)
        _relabel(now)
    return block


def _fold(kid: list) -> None:
    """A repeated group of what stood side by side."""
    first, *others = kid[2]
    for b in others:
        merge(first, b)
    kid[1], kid[2] = 0, [first]


def _relabel(block: dict) -> None:
    """Elements with too many different labels become one label ``name.*``."""
    if len(block.get("k", {})) <= LABELS and not any(label.endswith(".*") for label in block.get("k", {})):
        return
    of: dict[str, list[str]] = {}
    for label in block["k"]:
        of.setdefault(label.split(".")[0], []).append(label)
    for name, labels in of.items():
        any_ = f"{name}.*"
        if len(labels) > LABELS or any_ in labels:
            for label in labels:
                if label != any_:
                    _join(block, any_, block["k"].pop(label))
            to = dict.fromkeys(labels, any_)
            edges: dict[str, list[str]] = {}
            for a, after in block["e"].items():
                known = edges.setdefault(to.get(a, a), [])
                known += [b for b in dict.fromkeys(to.get(x, x) for x in after) if b not in known and b != to.get(a, a)]
            block["e"] = edges


def _join(block: dict, label: str, other: list) -> None:
    """Add what ``other`` knows of a label: places one by one where numbers agree, else as a repeated group."""
    if label not in block["k"]:
        if label.endswith(".*") and len(other[2]) > 1:
            _fold(other)
        block["k"][label] = [other[0], 0 if label.endswith(".*") else other[1], other[2]]
        return
    own = block["k"][label]
    own[0] += other[0]
    if own[1] and own[1] == other[1]:
        for a, b in zip(own[2], other[2]):
            merge(a, b)
    else:
        own[2] += other[2]
        _fold(own)


def merge(a: dict, b: dict) -> dict:
    """The wrapper of both, in ``a``. The order of pages doesn't matter."""
    a["n"] += b["n"]
    if "c" in a:
        a["c"] += b["c"]
        a["l"] += b["l"]
        a["t"] = a["t"] if a["t"] == b["t"] else None  # texts that differ make a slot
        a["d"] = sorted({*a["d"], *b["d"]})[:PAGES]
        return a
    for label, kid in b["k"].items():
        _join(a, label, kid)
    for label, after in b["e"].items():
        known = a["e"].setdefault(label, [])
        known += [x for x in after if x not in known]
    _relabel(a)
    return a


def _order(block: dict) -> list[list[str]]:
    """Labels of a block in an order that all pages have; labels in changing order are together (strong components)."""
    edges = {a: [b for b in after if b != a] for a, after in block["e"].items()}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    work = [("^", iter(sorted(edges.get("^", []))))]
    index["^"] = low["^"] = 0
    stack.append("^")
    while work:
        label, after = work[-1]
        for b in after:
            if b not in index:
                index[b] = low[b] = len(index)
                stack.append(b)
                work.append((b, iter(sorted(edges.get(b, [])))))
                break
            if b in stack:
                low[label] = min(low[label], index[b])
        else:
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[label])
            if low[label] == index[label]:
                part = []
                while not part or part[-1] != label:
                    part.append(stack.pop())
                out.append(sorted(part))
    return [p for p in reversed(out) if p != ["^"]]


def expression(block: dict) -> str:
    """The wrapper as a union-free regular expression over space-ended tokens; ``#`` is a slot, ``=`` a text of the template."""

    def one(label: str, b: dict) -> str:
        if label == "#":
            return "[#] " if b["t"] is None or len(b["d"]) < PAGES else "[=] "
        return f"{re.escape(label)} {expression(b)}/{re.escape(label)} "

    out = []
    for part in _order(block):
        free = len(part) > 1
        group = ""
        for label in part:
            seen, count, places = block["k"][label]
            inner = "".join(one(label, b) for b in places)
            optional = seen < block["n"] or free
            group += f"(?:{inner})" + ("*" if not count and optional else "+" if not count else "?" if optional else "")
        out.append(f"(?:{group})+" if free else group)
    return "".join(out)


HEADINGS = set("h1 h2 h3 h4 h5 h6 dt th".split())


def labelled(block: dict) -> tuple[dict, bool]:
    """The wrapper ready for extraction, and whether it has texts outside of articles and main: each text is {"id", "zone",
    "keep", "sure"}, each block {label: its places}.

    Zones: 2 inside an article, 1 inside main, 0 else. ``main`` of the root is the zone of the main text: the
    article's, unless most of main's text stands outside of it. In zones 2 and 1 all is kept but bars of links that
    are the template's, be they repeated or not. In zone 0 slots are kept (but for menus), and of the template the headings
    of blocks that have slots (``sure``).
    """
    mass: Counter = Counter()
    number = 0

    def bar(text: dict) -> bool:
        return text["l"] >= LINKED * text["c"] and len(text["d"]) >= PAGES

    def constant(text: dict) -> bool:
        return text["t"] is not None and len(text["d"]) >= PAGES

    has_slots: dict[int, bool] = {}

    def slots(b: dict) -> bool:
        if id(b) not in has_slots:
            has_slots[id(b)] = any(not constant(x) and not bar(x) if label == "#" else label.split(".")[0] not in HEADINGS and slots(x) for label, kid in b["k"].items() for x in kid[2])
        return has_slots[id(b)]

    def walk(b: dict, zone: int, name: str, outer: dict | None) -> dict:
        nonlocal number
        out = {}
        for label in sorted(b["k"]):
            places = []
            for inner in b["k"][label][2]:
                if label == "#":
                    number += 1
                    mass[zone] += inner["c"]
                    sure = name in HEADINGS and outer is not None and slots(outer)
                    keep = not (constant(inner) and bar(inner)) if zone else not bar(inner) and (sure or not constant(inner))
                    places.append({"id": number, "zone": zone, "keep": keep, "sure": sure})
                else:
                    kind = label.split(".")[0]
                    places.append(walk(inner, 2 if kind == "article" else max(zone, 1) if kind == "main" else zone, kind, b))
            out[label] = places
        return out

    wrapped = walk(block, 0, "", None)
    return {"main": 2 if mass[2] and mass[2] >= mass[1] else 1, "root": wrapped}, bool(mass[0])


def placed(html: str, wrapper: dict) -> Iterator[tuple[dict, str]]:
    """(place in the wrapper, text) of each text of a page of the wrapper's host."""
    path: list = [(wrapper["root"], Counter())]
    deeper = 0
    for kind, *more in blocks(html):
        if kind == ")":
            if deeper:
                deeper -= 1
            else:
                path.pop()
            continue
        if kind == "(" and (deeper or len(path) > DEPTH):
            deeper += 1
            continue
        kids, met = path[-1]
        label = "#" if kind == "#" else more[0]
        places = kids.get(label) or kids[f"{label.split('.')[0]}.*"]
        at = places[min(met[label], len(places) - 1)]
        met[label] += 1
        if kind == "#":
            yield at, more[0]
        else:
            path.append((at, Counter()))


def text_hash(text: str) -> int:
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


def main_text(html: str, wrapper: dict, template: set) -> str:
    """The main text of a page; ``template`` holds (place, hash) of texts that most pages of the host share.

    A page without the host's zone of the main text takes the next wider one. A page that is nothing but
    template has no other main text than that.
    """
    texts = list(placed(html, wrapper))
    zones = {at["zone"] for at, _ in texts}
    zone = next((z for z in range(wrapper["main"], 0, -1) if z in zones), 0)
    inside = [(at, t) for at, t in texts if at["zone"] >= zone]
    kept = [t for at, t in inside if at["keep"] and (at["zone"] or at["sure"] or (at["id"], text_hash(t)) not in template)]
    return "\n".join(kept or [t for _, t in inside])


# --- over a corpus ----------------------------------------------------------------------------------


def _size(block: dict) -> int:
    todo, n = [block], 0
    while todo:
        now = todo.pop()
        n += 1
        todo += [b for _, _, places in now.get("k", {}).values() for b in places]
    return n


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, wrapper): the pages of a task merged by host."""
    held: dict[str, dict] = {}
    pages = size = 0

    def written():
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1)):
            page = tree(html.as_py() or "")
            pages += 1
            held[host] = merge(held[host], page) if host in held else page
            if len(held) > HELD // 50 or pages % 256 == 0 and sum(map(_size, held.values())) > HELD:
                yield written()
                held.clear()
    if held:
        yield written()


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, pattern)``: the wrapper of each host from all its pages ``(host, html)``, and its expression.

    Null htmls are pages without a token. Partial wrappers are merged ``FAN_IN`` at a time until one is left of
    each host, so no task ever gathers a host's pages. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    schema = "host string, wrapper string"
    now = scratch.save(pages.select("host", "html").mapInArrow(_partial, schema).withColumn("part", F.monotonically_increasing_id()))

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole: dict | None = None
        for w in pdf["wrapper"]:
            whole = merge(whole, json.loads(w)) if whole else json.loads(w)
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(whole)]})

    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 1) > 1:
        parts = -(-most // FAN_IN)
        new = now.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(parts)))
        new = scratch.save(new.groupBy("host", "bucket").applyInPandas(merged, schema).withColumn("part", F.monotonically_increasing_id()))
        scratch.drop(now)
        now = new

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [json.loads(w) for w in b.column(1).to_pylist()]
            whole, open_ = zip(*map(labelled, trees)) if trees else ((), ())
            yield pa.record_batch([b.column(0), pa.array(map(json.dumps, whole), pa.string()), pa.array(open_, pa.bool_()), pa.array(map(expression, trees), pa.string())], ["host", "wrapper", "open", "pattern"])

    return now.select("host", "wrapper").mapInArrow(ready, "host string, wrapper string, open boolean, pattern string")


class _Held:
    """The wrappers of hosts: all of them where they are few enough to be sent to every executor, else as rows bring them."""

    def __init__(self, sent):
        self.sent, self.loaded = sent, {}

    def __call__(self, host: str, wrapper: str | None = None, template: list | None = None) -> tuple[dict, set]:
        if host not in self.loaded:
            if self.sent is not None:
                wrapper, template = self.sent.value[host]
            if len(self.loaded) > 256:
                self.loaded.clear()
            self.loaded[host] = json.loads(wrapper), {(t["place"], t["text"]) for t in template or []}
        return self.loaded[host]


def _with_wrappers(rows: DataFrame, ready: DataFrame, small: bool):
    """``rows`` joined with ``ready(host, wrapper, template)``, and what a task needs to read it: the wrappers
    themselves if they are small together, so that no row carries its own."""
    if not small:
        return rows.join(ready, "host").select(*rows.columns, "wrapper", "template"), None
    every = {r.host: (r.wrapper, r.template) for r in ready.collect()}  # BROADCAST_CHARS at most
    return rows.join(F.broadcast(ready.select("host")), "host").select(*rows.columns), rows.sparkSession.sparkContext.broadcast(every)


def _shared(scratch: Scratch, rows: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """``(host, template)``: places and hashes of texts that most different pages with that place share.

    Only places outside of articles and main are counted, on hosts that have such. Pages that have the same such texts are
    one page. At most ``1 / SHARE`` texts for each text of a page of the host come out.
    """
    some = found.where("open").select("host", "wrapper", F.lit(None).cast(TEMPLATE).alias("template"))
    with_wrapper, sent = _with_wrappers(rows.select("host", "html"), some, small)

    def open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(sent)
        for b in batches:
            out = []
            for host, html, *own in zip(*(c.to_pylist() for c in b.columns)):
                texts = [(at["id"], text_hash(t)) for at, t in placed(html or "", held(host, *own)[0]) if not at["zone"] and at["keep"] and not at["sure"]]
                page = text_hash(repr(texts))
                out += [(host, place, h, page) for place, h in set(texts)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "place", "text", "page"])

    texts = with_wrapper.mapInArrow(open_texts, "host string, place long, text long, page long").distinct()
    texts = scratch.save(texts)
    pages = texts.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count("*").alias("of"))
    counted = texts.groupBy("host", "place", "text").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    often = counted.join(pages, ["host", "place"]).where(F.col("n") >= SHARE * F.col("of"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("template"))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``: the main text of the whole html.

    A null or empty html has the empty text. Pages without a host (null urls too) share one wrapper, of
    the empty host. Repeated rows are extracted each; null ids and urls are carried along. Other columns
    are not read. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "extract")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = scratch.save(wrappers(rows))
    chars, open_ = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0)), F.count_if("open")).first()
    small = chars <= BROADCAST_CHARS
    shared = scratch.save(_shared(scratch, rows, found, small)) if open_ else None
    ready = found.select("host", "wrapper").join(shared, "host", "left") if open_ else found.select("host", "wrapper", F.lit(None).cast(TEMPLATE).alias("template"))
    joined, sent = _with_wrappers(rows, ready, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(sent)
        for b in batches:
            out = [main_text(html or "", *held(host, *own)) for html, host, *own in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
