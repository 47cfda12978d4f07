"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, functions as F

from orientlake.llm.common import LOWER, UPPER, Scratch, keep_columns, map_rows
from orientlake.session import shuffle_width

# Which elements break a line, hold no children, hold no markup, or are no part of an article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
DROPPED_TAGS = frozenset("aside audio button canvas datalist dialog footer form frameset head header menu nav object optgroup option select svg template video".split())
DROPPED_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disqus "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion related reply "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar topbar widget widgets".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: A start tag closes an open element of these, up to an element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}

TEXT = "#"  # a text slot in a wrapper
_DEPTH = 100  # elements nested deeper count as part of the one at this depth
_FAN = 64  # wrappers that are merged at a time
_FLUSH = 20_000
_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: [label, optional, repeated, items inside, group]; neighbours of one group above 0 repeat together, each of them optional
Item = list


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip("/ \n") else {}


def _names(found: dict[str, str]) -> list[str]:
    return [*found.get("class", "").split(), *found.get("id", "").split()]


def _is_dropped(tag: str, found: dict[str, str]) -> bool:
    if tag in DROPPED_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in DROPPED_ROLES:
        return True
    if tag == "main":
        return False
    for name in _names(found):
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in ("has", "with", "no", "without") and not DROPPED_WORDS.isdisjoint(words):
            return True
    return False


def _label(tag: str, found: dict[str, str]) -> str:
    """Tag, classes and id without digits, as these number pages rather than parts."""
    out = tag
    for mark, names in ((".", sorted(found.get("class", "").split())), ("#", found.get("id", "").split())):
        out += "".join(mark + re.sub(r"\d+", "", n) for n in names)
    return out


# --- union-free expressions ---

def _grouped(items: list[Item], spans: Iterable[tuple[int, int]]) -> None:
    """Make each of the spans (and what overlaps it) one repeated group."""
    joined: list[list[int]] = []
    for lo, hi in sorted(spans):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(hi, joined[-1][1])
        else:
            joined.append([lo, hi])
    for item in items:
        item[4] = 0
    for n, (lo, hi) in enumerate(joined, 1):
        for item in items[lo:hi + 1]:
            item[1], item[4] = True, n


def _spans(items: list[Item]) -> list[tuple[int, int]]:
    found: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        if item[4]:
            found.setdefault(item[4], []).append(i)
    return [(p[0], p[-1]) for p in found.values()]


def add_item(items: list[Item], item: Item) -> None:
    """Read one more element of a page: next to its like it repeats; if its like stands further back, all from there on repeat together."""
    for i in range(len(items) - 1, -1, -1):
        if items[i][0] == item[0]:
            last = i == len(items) - 1
            items[i] = merged(items[i], item)
            if last:
                items[i][2] = True
            else:
                _grouped(items, [*_spans(items), (i, len(items) - 1)])
            return
    items.append(item)


def merged(a: Item, b: Item) -> Item:
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3]), a[4] or b[4]]


def _increasing(places: list[int]) -> set[int]:
    """Positions of a longest increasing run of ``places``."""
    tails, at, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(at[k - 1] if k else -1)
        tails[k:k + 1], at[k:k + 1] = [p], [i]
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


def aligned(xs: list[Item], ys: list[Item]) -> list[Item]:
    """One expression for both: like elements are aligned in order, others become optional, those in another order repeat as a group."""
    place = {y[0]: j for j, y in enumerate(ys)}
    common = [x for x in xs if x[0] in place]
    fixed = {common[i][0] for i in _increasing([place[x[0]] for x in common])}
    of_x = {x[0]: x for x in xs}
    out: list[Item] = []
    spans: list[list[int]] = []
    moved: dict[str, list[int]] = {}
    marks: dict[tuple[str, int], list[int]] = {}

    def put(item: Item, *groups: tuple[str, int]) -> None:
        for g in groups:
            if g[1]:
                marks.setdefault(g, []).append(len(out))
        out.append([*item[:4], 0])

    j = 0
    for x in [*xs, None]:
        if x is not None and x[0] not in fixed:
            if x[0] in place:
                moved.setdefault(x[0], []).append(len(out))
                put(merged(x, ys[place[x[0]]]), ("x", x[4]), ("y", ys[place[x[0]]][4]))
            else:
                put([x[0], True, *x[2:]], ("x", x[4]))
            continue
        stop = place[x[0]] if x is not None else len(ys)
        for y in ys[j:stop]:
            if y[0] in of_x:  # stands elsewhere in xs; this is where the group has to reach
                moved.setdefault(y[0], []).append(len(out) - 1 if len(out) else 0)
            else:
                put([y[0], True, *y[2:]], ("y", y[4]))
        if x is not None:
            put(merged(x, ys[stop]), ("x", x[4]), ("y", ys[stop][4]))
            j = stop + 1
    spans += [[min(p), max(p)] for p in (*moved.values(), *marks.values())]
    _grouped(out, [(lo, min(hi, len(out) - 1)) for lo, hi in spans])
    return out


def expression(items: list[Item]) -> str:
    """The wrapper as text: ``?`` optional, ``+`` repeated, ``#`` a text slot."""
    out, i = [], 0

    def one(item: Item) -> str:
        body = item[0] if item[0] == TEXT else f"<{item[0]}>{expression(item[3])}</>"
        return (f"({body})+" if item[2] else body if not item[1] else f"({body})") + ("?" if item[1] else "")

    while i < len(items):
        k = i + 1
        while items[i][4] and k < len(items) and items[k][4] == items[i][4]:
            k += 1
        out.append("".join(map(one, items[i:k])) if not items[i][4] else f"({''.join(map(one, items[i:k]))})+")
        i = k
    return "".join(out)


# --- pages ---

class Page:
    """Token stream of a page: its text blocks with the path of their elements, and its own expression.

    Elements that are no part of an article hold no blocks. Missing end tags
    are supplied; an ``article`` or ``main`` ends a dropped element that is
    never closed, and a form around it.
    """

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str, int]] = []
        self.items: list[Item] = []
        # tag, path, dropped, items
        self.stack: list[tuple[str, str, bool, list[Item]]] = [("", "", False, self.items)]
        self.dropped = self.deeper = 0
        self.buffer: list[str] = []
        self.link, self.linked = False, 0
        if html:
            self._read(html)
        self._flush()
        self._close(1)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text and not self.dropped:
                self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
                add_item(self.stack[-1][3], [TEXT, False, False, [], 0])
            self.buffer, self.linked = [], 0

    def _close(self, depth: int) -> None:
        """Close elements until so many are open."""
        while len(self.stack) > depth:
            tag, path, drop, items = self.stack.pop()
            self.dropped -= drop
            if not self.dropped:
                add_item(self.stack[-1][3], [path.rsplit(" ", 1)[-1], False, False, items, 0])

    def _find(self, tags, until=frozenset()) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in until:
                break
        return 0

    def _read(self, html: str) -> None:
        at, low = 0, None
        for m in iter(lambda: _TAG.search(html, at), None):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
                continue
            if tag in RAW_TAGS:
                low = low if low is not None else html.lower()
                self._flush() if tag in BLOCK_TAGS else None
                end = low.find(f"</{tag}", at) if len(low) == len(html) else -2
                if end == -2:  # lower-casing changed the length
                    found = re.compile(f"</{tag}", re.I).search(html, at)
                    end = found.start() if found else -1
                at = len(html) if end < 0 else end
                continue
            self._start(tag, m[3] or m[6] or "", html, at)
        if at < len(html):
            self._text(html[at:])

    def _text(self, raw: str) -> None:
        if self.dropped:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self.buffer.append(text)
        self.linked += len(text) if self.link else 0

    def _start(self, tag: str, rest: str, html: str, at: int) -> None:
        if tag in ("br", "hr"):
            self._flush()
        if tag in VOID_TAGS or tag == "html":
            return
        block = tag in BLOCK_TAGS
        if self.stack[-1][0] == "head" and block and tag != "head":
            self._close(len(self.stack) - 1)
        if tag == "body":
            self._flush()
            return
        found = _attributes(rest)
        drop = _is_dropped(tag, found)
        if not block and not drop:
            self.link = tag == "a" or self.link
            return
        self._flush()
        self.link = False
        if tag in ("article", "main") and self.dropped and not drop:
            for i in range(1, len(self.stack)):
                # an element that is never closed, or a form around the page
                if self.stack[i][2] and (self.stack[i][0] == "form" or not re.compile(f"</{re.escape(self.stack[i][0])}", re.I).search(html, at)):
                    self._close(i)
                    break
        if block:
            i = self._find({"p"}, {"td", "th", "table", "caption", "button"})
            if i:
                self._close(i)
            if tag in CLOSES:
                i = self._find(*CLOSES[tag])
                if i:
                    self._close(i)
        if len(self.stack) > _DEPTH and not drop:
            self.deeper += 1
            return
        self.stack.append((tag, f"{self.stack[-1][1]} {_label(tag, found)}".strip(), drop, []))
        self.dropped += drop

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag not in BLOCK_TAGS:
            i = self._find({tag})
            if i:  # an inline element that is dropped
                self._flush()
                self._close(i)
            return
        self._flush()
        self.link = False
        if self.deeper and tag != "p":
            self.deeper -= 1
            return
        i = self._find({tag})
        if i:
            self._close(i)


def _tag_of(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


def main_parts(wrapper: list[Item], slots: list[tuple[str, int, int, int, bool]]) -> dict:
    """Which parts of a host's pages hold the article: ``roots`` (lists of paths in order of preference), ``region`` and ``fixed``.

    ``slots`` has for each path of the wrapper with text: pages, characters,
    characters inside links, and whether the text is the same on all pages.
    First come the ``article`` elements of the wrapper, then ``main``; without
    any, the region is the deepest element around slots with most of the text
    that is not linked and differs from page to page, and slots of it that are the same on
    all pages or mostly links are template.
    """
    roots: dict[str, list[str]] = {"article": [], "main": []}

    def walk(items: list[Item], path: str) -> None:
        for item in items:
            here = f"{path} {item[0]}".strip()
            tag = _tag_of(item[0])
            if tag in roots:
                roots[tag].append(here)
            if tag != "article":
                walk(item[3], here)

    walk(wrapper, "")
    pages = max((s[1] for s in slots), default=0)
    own = {path: chars - links for path, n, chars, links, same in slots if not (same and pages >= 3 and n >= 3) and 2 * links <= chars}
    if not own:
        own = {path: chars for path, n, chars, links, same in slots}
    total, region = sum(own.values()), ""
    while True:
        inside: dict[str, int] = {}
        for path, n in own.items():
            if path.startswith(f"{region} ") if region else path:
                step = path[len(region):].split()[0]
                inside[step] = inside.get(step, 0) + n
        best = max(sorted(inside), key=inside.__getitem__, default=None)
        deeper = f"{region} {best}".strip()
        if best is None or 10 * inside[best] < 7 * total or deeper in own:
            break
        region = deeper
    return {"roots": [r for r in (roots["article"], roots["main"]) if r], "region": region,
            "fixed": [path for path, *_ in slots if path not in own]}


def _under(path: str, root: str) -> bool:
    return not root or path == root or path.startswith(f"{root} ")


def main_text(page: Page, parts: dict) -> str:
    """The blocks of a page inside the parts that hold the article, in order, joined by one blank."""
    for roots in parts["roots"]:
        found = [text for path, text, _ in page.blocks if any(_under(path, r) for r in roots)]
        if found:
            return " ".join(found)
    fixed = set(parts["fixed"])
    return " ".join(text for path, text, _ in page.blocks if _under(path, parts["region"]) and path not in fixed)


def _observe(batches) -> Iterator[dict]:
    """Distinct expressions of each host's pages, and what stands in their slots, summed within the task."""
    names = ("host", "wrapper", "path", "pages", "chars", "links", "low", "high")
    seen: dict[tuple[str, str], int] = {}
    slots: dict[tuple[str, str], list[int]] = {}

    def told():
        rows = [(h, w, None, n, 0, 0, 0, 0) for (h, w), n in seen.items()] + [(h, None, p, *s) for (h, p), s in slots.items()]
        return dict(zip(names, map(list, zip(*rows))))

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"]):
            page = Page(html)
            one = (host, json.dumps(page.items, ensure_ascii=False, separators=(",", ":")))
            seen[one] = seen.get(one, 0) + 1
            own: dict[str, list] = {}
            for path, text, linked in page.blocks:
                s = own.setdefault(path, [0, 0, blake2b(digest_size=8)])
                s[0] += len(text)
                s[1] += linked
                s[2].update(text.encode("utf-8", "surrogatepass") + b"\n")
            for path, (chars, linked, said) in own.items():
                mark = int.from_bytes(said.digest(), "little", signed=True)
                s = slots.get((host, path))
                slots[host, path] = [1, chars, linked, mark, mark] if s is None else [s[0] + 1, s[1] + chars, s[2] + linked, min(s[3], mark), max(s[4], mark)]
            if len(seen) + len(slots) > _FLUSH:
                yield told()
                seen.clear()
                slots.clear()
    if seen:
        yield told()


def _merge(batches) -> Iterator[dict]:
    for batch in batches:
        out = {"host": batch["host"], "wrapper": []}
        for all_of in batch["all"]:
            items: list[Item] = []
            for i, text in enumerate(sorted(all_of)):
                items = aligned(items, json.loads(text)) if i else json.loads(text)
            out["wrapper"].append(json.dumps(items, ensure_ascii=False, separators=(",", ":")))
        yield out


def host_of(url: str) -> Column:
    """The host of an address: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def infer_wrappers(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """One wrapper per host: ``host``, ``pages``, ``wrapper`` (``expression`` prints it) and its ``slots``.

    General: the particle records hold no markup. Each page is a stream of
    tags and texts. Reading it, like elements next to each other become a
    repeated group; distinct pages of a host are then aligned one after the
    other, and every mismatch becomes an optional or a repeated group or a
    text slot. Pages of the same expression are one before any shuffle; the
    others are aligned ``_FAN`` at a time, in rounds, so a host with a third
    of all pages is no task of its own.

    Null or empty pages have an empty expression; a null address or one
    without ``://`` is on the host ''. No rows: an empty result.
    """
    rows = keep_columns(pages, url, html, where="pages").select(host_of(url).alias("host"), F.col(html).alias("html"))
    seen = scratch.cut(map_rows(rows, _observe, "host string, wrapper string, path string, pages bigint, chars bigint, links bigint, low bigint, high bigint"), "seen")
    distinct = seen.where("wrapper is not null").groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"))
    counts = distinct.groupBy("host").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("n"))
    level = scratch.cut(distinct.select("host", "wrapper"), "wrappers")
    while True:
        n = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (n.agg(F.max("n")).first()[0] or 1) <= 1:
            break
        dealt = level.join(n, "host").groupBy("host", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / _FAN)).alias("deal")).agg(F.collect_list("wrapper").alias("all"))
        level = scratch.cut(map_rows(dealt.select("host", "all"), _merge, "host string, wrapper string").distinct(), "wrappers")
    slots = seen.where("path is not null").groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("low") == F.max("high")).alias("same"))
    # as many slots as the wrapper of the host has
    per_host = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "pages", "chars", "links", "same"))).alias("slots"))
    return level.join(counts.select("host", "pages"), "host").join(per_host, "host", "left")


def _decide(batches) -> Iterator[dict]:
    for batch in batches:
        yield {"host": batch["host"], "pages": batch["pages"], "parts": [
            json.dumps(main_parts(json.loads(w), [(s["path"], s["pages"], s["chars"], s["links"], s["same"]) for s in slots or []]), ensure_ascii=False)
            for w, slots in zip(batch["wrapper"], batch["slots"])]}


def _extract(batches) -> Iterator[dict]:
    for batch in batches:
        known: dict[str, dict] = {}
        texts = []
        for html, parts in zip(batch["html"], batch["parts"]):
            if parts not in known:
                known[parts] = json.loads(parts)
            texts.append(main_text(Page(html), known[parts]))
        yield {"_key": batch["_key"], "_url": batch["_url"], "text": texts}


def extract_articles(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: ``key``, ``url``, ``text`` (empty if there is none).

    General: the particle records hold no markup. The wrapper of a page's host
    (``infer_wrappers``) says which elements hold the article
    (``main_parts``); menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are told by their elements, classes,
    ids and roles and never taken. Character references are decoded, white
    space inside a block becomes one blank, and the blocks are joined by one
    blank in the order of the page; line breaks and block elements end a
    block, inline elements do not. Nothing else is left out.

    Null and empty pages: empty text. Null keys and addresses and repeated
    rows are pages like any other. No rows: an empty result.
    """
    rows = keep_columns(pages, key, url, html, where="pages").select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("html"), host_of(url).alias("host"))
    kind = rows.schema["_key"].dataType.simpleString()
    told = map_rows(infer_wrappers(pages, scratch, url, html).select("host", "pages", "wrapper", "slots"), _decide, "host string, pages bigint, parts string")
    parts = scratch.cut(told, "parts")
    # hosts with more than a fraction of the pages are dealt to several tasks; there can be no more such hosts than its inverse
    share = 4 * shuffle_width(pages.sparkSession)
    total = parts.agg(F.sum("pages")).first()[0] or 1
    hot = parts.where(F.col("pages") * share > total).select("host", F.ceil(F.col("pages") * share / total).cast("int").alias("deals"))
    deal = F.coalesce(F.pmod(F.xxhash64("html", "_url"), "deals"), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("deal", deal).drop("deals")
    # written, so that its true size is known before the join: few hosts are sent to all tasks, and no page is shuffled for them
    spread = scratch.cut(parts.join(F.broadcast(hot), "host", "left").select(
        "host", "parts", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal")), "spread")
    joined = dealt.join(spread, ["host", "deal"]).select("_key", "_url", "html", "parts")
    return map_rows(joined, _extract, f"_key {kind}, _url string, text string").withColumnsRenamed({"_key": key, "_url": url})
