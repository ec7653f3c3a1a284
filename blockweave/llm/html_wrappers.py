"""Main text of web pages by wrappers, union-free regular expressions inferred from the pages of a host.

A page is a tree of tags (with class, id and role) and texts. Within a page, siblings that follow themselves at once are one
repeated group, written (...)+. Pages of a host are aligned with the wrapper so far, level by level: what both have stays, what
one lacks is an optional group, written (...)?, siblings that the other repeats are taken as repeated, and texts that differ
become a slot, while texts that are the same stay part of the template.

A page is then matched with its host's wrapper. Its texts that fall on slots are data, and data in an article or main part, or
where the host has none anywhere but in menus and the like, is main text. Template text is not, if at least LEAST_PAGES pages
that differ have it and the wrapper has slots of main text beside it.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches, stage

#: Tags without text of their own, tags that don't part blocks, tags that close their like, parts that are no
#: main text by tag, role or a word of class or id.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input meta link".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
ASIDE = frozenset("head title nav header footer aside form button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header comment comments replies respond disqus share sharing social related widget".split())
MAIN = frozenset(("article", "main"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Pages that differ and have the same text, for it to count as part of the template.
LEAST_PAGES = 3
#: Elements nested deeper are no level of their own in the wrapper; their names still count.
DEPTH = 150
#: Wrappers of a host that are aligned in one group.
FAN_IN = 64
#: Shapes of pages that a task holds before it passes them on.
HELD = 5000
#: Wrappers of at most so many bytes together are broadcast; more are joined, and hosts with more than a share of all pages, and
#: PAGES pages at least, are split for that.
BROADCAST_BYTES, HOSTS, PAGES = 8 << 20, 10_000, 20_000


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, label) of tags that part blocks, kind open or close, and (text, text, '')."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = (m["name"] or "").lower()
        if name in ("br", "img", "hr", "input"):
            yield "text", " ", ""
        if not name or name in VOID or name in INLINE:
            continue
        if m["end"]:
            yield "close", name, ""
        else:
            marks = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m["rest"] or ""))
            yield "open", name, "".join(f"[{k}={v}]" for k, v in marks)
    if at < len(page):
        yield "text", page[at:], ""


def _aside(label: str, inside_main: bool) -> bool:
    name, _, marks = label.partition("[")
    if name in ASIDE and not (name == "header" and inside_main):
        return True
    found = re.findall(r"(class|id|role)=([^\]]*)\]", "[" + marks)
    return any(v.lower() in ROLES if k == "role" else WORDS & set(re.split(r"[\s_\-]+", v.lower())) for k, v in found)


def named(path: list[str]) -> tuple[bool, bool]:
    """(in an article or main part, in no menu or the like), by the names on the way to a text."""
    where = next((i for i, x in enumerate(path) if x.partition("[")[0] in MAIN and not _aside(x, False)), None)
    return where is not None, not any(_aside(x, where is not None and i > where) for i, x in enumerate(path))


# Items of a tree: ("#", digest, pages) a text, where digest is empty for a slot; ("<", label, items) an element; ("+", items) a
# repeated and ("?", items) an optional group. A shape has neither digests nor pages.
TEXT = ("#", "", ())


def _folded(children: list[tuple[tuple, list[list[int]]]]) -> list[tuple[tuple, list[list[int]]]]:
    """Siblings (item, texts at each of its places) with those that follow themselves as repeated groups.

    Where a tag has thousands of children, only groups of few of them are looked for.
    """
    p = 1
    while 2 * p <= len(children) and p * len(children) <= 4_000_000:
        numbers: dict[tuple, int] = {}
        ids = np.array([numbers.setdefault(x, len(numbers)) for x, _ in children])
        same = np.concatenate([ids[:-p] == ids[p:], [False]])
        if p > 1 and not np.any(np.convolve(same[:-1], np.ones(p, int), "valid") == p):
            p += 1
            continue
        out, i = [], 0
        while i < len(children):
            j = i
            while j < len(same) and same[j]:
                j += 1
            times = (j - i) // p + 1
            if times > 1:
                groups = [[o for _, at in children[i + k * p : i + k * p + p] for o in at] for k in range(times)]
                out.append((("+", tuple(x for x, _ in children[i : i + p])), [sum(o, []) for o in zip(*groups, strict=True)]))
                i += times * p
            else:
                out.append(children[i])
                i += 1
        children, p = out, p + 1
    return children


def parsed(page: str) -> tuple[tuple, list[list[int]], list[tuple[str, tuple[bool, bool]]]]:
    """A page's shape, the texts at each of the shape's places, and the texts (decoded, named()) in order of the page.

    An unclosed paragraph or list item ends where the next begins.
    """
    texts: list[tuple[str, tuple[bool, bool]]] = []
    stack: list[tuple[str, str]] = []
    levels: list[list] = [[]]
    held: list[str] = []
    known: dict[int, tuple[bool, bool]] = {}

    def flush() -> None:
        text = block("".join(held))
        held.clear()
        if text:
            if not known:
                known[0] = named([n + x for n, x in stack])
            levels[-1].append((TEXT, [[len(texts)]]))
            texts.append((text, known[0]))

    def close() -> None:
        name, marks = stack.pop()
        known.clear()
        if len(stack) < DEPTH:
            inner = _folded(levels.pop())
            levels[-1].append((("<", name + re.sub(r"\d+", "0", marks), tuple(x for x, _ in inner)), [o for _, at in inner for o in at]))

    for kind, name, label in tokens(page):
        if kind == "text":
            held.append(name)
            continue
        flush()
        if kind == "open":
            if stack and (stack[-1][0] == name and name in ("p", "li", "td", "tr", "dt", "dd", "option") or stack[-1][0] == "p" and name != "p"):
                close()
            if len(stack) < DEPTH:
                levels.append([])
            stack.append((name, label))
            known.clear()
        elif any(n == name for n, _ in stack):
            while stack[-1][0] != name:
                close()
            close()
    flush()
    while stack:
        close()
    found = _folded(levels[0])
    return tuple(x for x, _ in found), [o for _, at in found for o in at], texts


def block(raw: str) -> str:
    """A block's text: references decoded, white space one blank."""
    return " ".join(html.unescape(raw).split())


def _digest(*texts: str) -> str:
    return hashlib.blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=8).hexdigest()


def facts(places: list[list[int]], texts: list[tuple[str, tuple[bool, bool]]]) -> tuple[list[str], str]:
    """The digest of the text at each place, empty where it differs within the page, and a digest of the page's texts outside menus."""
    found = []
    for at in places:
        here = {texts[i][0] for i in at}
        found.append(_digest(here.pop()) if len(here) == 1 else "")
    return found, _digest(*(t for t, (_, plain) in texts if plain))


def filled(shape: tuple, digests: Iterator[str], pages: tuple[str, ...]) -> tuple:
    """A shape with the digests at its places and the pages that have them."""
    return tuple(("#", next(digests), pages) if x[0] == "#" else (*x[:-1], filled(x[-1], digests, pages)) for x in shape)


def _key(x: tuple):
    return x[0] if x[0] == "#" else "<" + x[1] if x[0] == "<" else tuple(map(_key, x[1]))


def _entries(items: tuple, groups: set[tuple]) -> list[tuple[object, bool, list[tuple]]]:
    """(key, optional, instances) of some siblings; those of a group that either side repeats are instances of one entry."""
    flat = [(x, True) for x in ()]
    for y in items:
        flat += [(x, True) for x in y[1]] if y[0] == "?" else [(y, False)]
    out, i = [], 0
    while i < len(flat):
        x, optional = flat[i]
        if x[0] == "+":
            out.append((("+", _key(x)), optional, [x[1]]))
            i += 1
            continue
        for g in groups:
            n = len(g)
            if tuple(_key(x) for x, _ in flat[i : i + n] if x[0] != "+") == g:
                out.append((("+", g), all(o for _, o in flat[i : i + n]), [tuple(x for x, _ in flat[i : i + n])]))
                i += n
                break
        else:
            out.append((_key(x), optional, [(x,)]))
            i += 1
    joined: list[tuple[object, bool, list[tuple]]] = []
    for key, optional, instances in out:
        if joined and isinstance(key, tuple) and joined[-1][0] == key:
            joined[-1] = (key, joined[-1][1] and optional, joined[-1][2] + instances)
        else:
            joined.append((key, optional, instances))
    return joined


def _aligned(a: tuple, b: tuple) -> Iterator[tuple[tuple | None, tuple | None]]:
    """Entries of both that go together, and those of one alone, in order."""
    groups = {_key(x) for w in (a, b) for y in w for x in (y[1] if y[0] == "?" else (y,)) if x[0] == "+"}
    x, y = _entries(a, groups), _entries(b, groups)
    for kind, i, j, k, m in SequenceMatcher(None, [e[0] for e in x], [e[0] for e in y], autojunk=False).get_opcodes():
        if kind == "equal":
            yield from zip(x[i:j], y[k:m], strict=True)
        else:
            yield from ((e, None) for e in x[i:j])
            yield from ((None, e) for e in y[k:m])


def _one(x: tuple, y: tuple) -> tuple:
    """Two items of the same key as one."""
    if x[0] == "#":
        return ("#", x[1] if x[1] == y[1] else "", tuple(sorted({*x[2], *y[2]})[:LEAST_PAGES]))
    return (*x[:-1], merged(x[-1], y[-1]))


def merged(a: tuple, b: tuple) -> tuple:
    """The wrapper for what either describes."""
    out: list[tuple[bool, tuple]] = []
    for x, y in _aligned(a, b):
        key = (x or y)[0]
        alike = [*(x[2] if x else []), *(y[2] if y else [])]
        items = reduce(lambda s, t: tuple(map(_one, s, t)), alike)
        out.append((x is None or y is None or x[1] or y[1], ("+", items) if isinstance(key, tuple) else items[0]))
    wrapper: list[tuple] = []
    group: list[tuple] = []
    for optional, item in [*out, (False, None)]:
        if optional:
            group.append(item)
            continue
        if group:
            wrapper.append(("?", tuple(group)))
            group = []
        if item is not None:
            wrapper.append(item)
    return tuple(wrapper)


def dumped(items: tuple) -> str:
    return json.dumps(items, separators=(",", ":"))


def loaded(text: str) -> tuple:
    fix = lambda x: tuple(map(fix, x)) if isinstance(x, list) else x
    return fix(json.loads(text))


def expression(items: tuple) -> str:
    """The wrapper as a regular expression, for people; a slot is #, template text its digest."""

    def one(x: tuple) -> str:
        if x[0] == "#":
            return x[1] or "#"
        if x[0] == "<":
            return f"<{x[1]}>{expression(x[2])}</{x[1].partition('[')[0]}>"
        return f"({expression(x[1])}){x[0]}"

    return "".join(map(one, items))


def decided(wrapper: tuple) -> tuple:
    """The wrapper with, in place of each text, whether it is main text."""
    found: list[tuple[bool, bool, bool]] = []

    def walk(items: tuple, path: list[str]) -> None:
        for x in items:
            if x[0] == "#":
                found.append((*named(path), bool(x[1]) and len(x[2]) >= LEAST_PAGES))
            else:
                walk(x[-1], [*path, x[1]] if x[0] == "<" else path)

    walk(wrapper, [])
    any_main = any(inside and plain for inside, plain, _ in found)
    main = [plain and (inside or not any_main) for inside, plain, _ in found]
    slots = any(m and not template for m, (_, _, template) in zip(main, found, strict=True))
    role = iter([m and not (template and slots) for m, (_, _, template) in zip(main, found, strict=True)])

    def put(items: tuple) -> tuple:
        return tuple(("#", next(role), ()) if x[0] == "#" else (*x[:-1], put(x[-1])) for x in items)

    return put(wrapper)


def _places(items: tuple) -> int:
    return sum(1 if x[0] == "#" else _places(x[-1]) for x in items)


def matched(wrapper: tuple, shape: tuple) -> list[bool | None]:
    """For each place of a shape whether the wrapper says that it is main text; None where they don't match."""
    out: list[bool | None] = []
    for x, y in _aligned(wrapper, shape):
        for instance in y[2] if y else []:
            for k, item in enumerate(instance):
                if x is None:
                    out += [None] * _places((item,))
                elif item[0] == "#":
                    out.append(x[2][0][k][1])
                else:
                    out += matched(x[2][0][k][-1], item[-1])
    return out


def extract(page: str, wrapper: tuple, known: dict[tuple, list[bool | None]]) -> str:
    """The main text of a page by its host's decided wrapper. What the wrapper doesn't match goes by names alone; known remembers shapes."""
    shape, places, texts = parsed(page)
    if shape not in known:
        known[shape] = matched(wrapper, shape)
    role: list[bool | None] = [None] * len(texts)
    for at, r in zip(places, known[shape], strict=True):
        for i in at:
            role[i] = r
    any_main = any(inside and plain for _, (inside, plain) in texts)
    names = [plain and (inside or not any_main) for _, (inside, plain) in texts]
    if not any(role):  # the host's article part, say, is missing on this page
        role = names
    return "\n\n".join(t for (t, _), r, n in zip(texts, role, names, strict=True) if (n if r is None else r))


def host(url: F.Column) -> F.Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_SHAPES = "host string, shape string, digests array<string>, pages array<string>"


def _joined(a: tuple[list[str], set[str]], digests: list[str], pages) -> tuple[list[str], set[str]]:
    """Facts about one shape from two sets of pages."""
    return [x if x == y else "" for x, y in zip(a[0], digests, strict=True)], set(sorted({*a[1], *pages})[:LEAST_PAGES])


def shapes(pages: DataFrame) -> DataFrame:
    """(host, shape, digests, pages): each task's distinct shapes of a host with what is known of their texts."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, tuple], tuple[list[str], set[str]]] = {}

        def flush() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [dumped(s) for _, s in held], [d for d, _ in held.values()], [sorted(p) for _, p in held.values()]]
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "shape", "digests", "pages"])

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape, places, texts = parsed(page or "")
                digests, digest = facts(places, texts)
                held[h, shape] = _joined(held.get((h, shape), (digests, set())), digests, [digest])
            if len(held) >= HELD:
                yield flush()
                held = {}
        if held:
            yield flush()

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, _SHAPES)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages: facts about equal shapes are put together, then a host's distinct shapes are aligned in
    groups of a bounded size, and the groups' wrappers in further rounds until each host has one."""

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        known = None
        for digests, found in zip(pdf["digests"], pdf["pages"], strict=True):
            known = _joined(known or (list(digests), set()), list(digests), found)
        wrapper = filled(loaded(pdf["shape"].iloc[0]), iter(known[0]), tuple(sorted(known[1])))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [dumped(wrapper)]})

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(pdf["wrapper"], key=lambda s: (len(s), s))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [dumped(reduce(merged, map(loaded, found)))]})

    one = stage(shapes(pages).groupBy("host", "shape").applyInPandas(together, "host string, wrapper string"), "shapes")
    while True:
        most = one.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return one
        sizes = one.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("parts"))
        dealt = one.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        one = stage(dealt.groupBy("host", "part").applyInPandas(align, "host string, wrapper string"), "wrappers")


def with_wrappers(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with their hosts' wrappers, broadcast if they are few, else joined with large hosts split."""
    found = wrappers(pages)
    hosted = pages.withColumn("host", host(F.col("url")))
    if (found.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return hosted.join(F.broadcast(found), "host", "left")
    sizes = hosted.groupBy("host").count()
    least = max(PAGES, pages.count() // HOSTS)
    large = stage(sizes.filter(F.col("count") > least).select("host", F.ceil(F.col("count") / least).cast("int").alias("salts")), "hosts")  # HOSTS rows at most
    spread = found.join(F.broadcast(large), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salted = hosted.join(F.broadcast(large), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return salted.join(spread, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    Null or empty html has an empty text. Pages whose url is null or has no host share the wrapper of the empty host. Repeated
    rows give a row each, and count as one page of the host. Very long pages are parsed whole. Other columns, whatever their
    names, are ignored. An empty table gives an empty result.
    """
    joined = with_wrappers(need(pages, "page_id", "url", "html")).select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple, dict[tuple, list[bool | None]]]] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) >= HELD:
                        known.clear()
                    known[wrapper] = (decided(loaded(wrapper)) if wrapper else (), {})
                if len(known[wrapper][1]) >= HELD:
                    known[wrapper][1].clear()
                texts.append(extract(page or "", *known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
