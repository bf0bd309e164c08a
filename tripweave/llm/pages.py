"""Main text of web pages by wrappers of their hosts.

Pages of one host come from one template. A page is a stream of blocks, each
known by its path of block elements and its text; a run of equal groups becomes
one repeated group, and streams are aligned, page by page and wrapper by wrapper
in a tree. What stands in the same order on nearly all distinct pages of the host
is template and dropped, also inside an article; what lies between are slots,
whose paths are judged by all pages: a path that always has one text is template,
one that varies carries text. Names and tags tell menus and the like.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.sizing import fits_broadcast
from tripweave.sources import scratch_path

#: A slot with one text on so many pages of different texts is template.
TEMPLATE_PAGES = 3
#: Streams or wrappers that one task aligns.
FAN = 64
_LONGEST_GROUP = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|select|button)\b(?P<rest>[^>]*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
_CLOSED_BY_ITSELF = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
_NOT_MAIN_TAGS = frozenset("nav header footer aside form head menu dialog".split())
#: An element is furniture by a whole class, id or role of such words, with what commonly goes with them.
_NOT_MAIN_WORD = re.compile(
    r"nav[a-z]*|menu[a-z]*|header|footer|sidebar|aside|cookies?|consent|notices?|gdpr|banners?|ads?|advert[a-z]*"
    r"|promo[a-z]*|sponsor[a-z]*|comments?|respond|repl(?:y|ies)|share|sharing|social|related|breadcrumbs?|newsletter"
    r"|subscribe|login|search|popup|modal|disqus|contentinfo|complementary"
)
_PLACES = frozenset("site page global top bottom left right main primary secondary widget".split())
_WITH_IT = frozenset("link links bar box list menu wrap wrapper container area section block widget widgets button buttons inner form posts icon icons slot".split())
#: Such elements hold articles of their own, which are not the page's.
_OTHER_ARTICLES = re.compile(r"comments?|respond|repl(?:y|ies)|related|ads?|advert|sponsor")
_FRAMES = frozenset(("html", "body", "main", "article"))
_MAIN = frozenset(("article", "main"))


#: Elements whose content is text up to their end tag, whatever it holds; the other ones end at a block if unclosed.
_RAW_TEXT = frozenset("script style textarea iframe title".split())
_NO_NESTING = frozenset("noscript select button".split())
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg iframe title select button".split()}
_RAW_AGAIN = {t: re.compile(rf"<{t}\b", re.I) for t in _NO_NESTING}
_BLOCK_TAG = re.compile(rf"</?(?:html|body|li|dt|dd|tr|td|th|tbody|{'|'.join(sorted(_ENDS_P))})\b", re.I)


class _Raw:
    """Where elements end whose content is not read; a tag that was not found once is not sought again."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def _next(self, pattern: re.Pattern, at: int) -> int:
        known = self.found.get(pattern, (-1, -1))
        if known[0] < at:
            m = pattern.search(self.page, at)
            self.found[pattern] = known = m.span() if m else (len(self.page), -1)
        return known[0]

    def end(self, tag: str, at: int) -> int:
        close = self._next(_RAW_ENDS[tag], at)
        none = close == len(self.page)
        if not none and not (tag in _NO_NESTING and self._next(_RAW_AGAIN[tag], at) < close):
            return self.found[_RAW_ENDS[tag]][1]
        return close if tag in _RAW_TEXT else self._next(_BLOCK_TAG, at)


def _tokens(page: str) -> Iterator[re.Match]:
    at, raw = 0, _Raw(page)
    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            if m["raw"]:
                tag = m["raw"].lower()
                at = m.end() if tag == "svg" and m["rest"].endswith("/") else raw.end(tag, m.end())
                break
            yield m
        else:
            return


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """``(path, text, linked)`` of each block: its open block elements, its text and its characters inside links."""
    stack: list[str] = []
    parts: list[str] = []
    links = linked = 0
    path = ""

    def cut(upto: int) -> None:
        del stack[upto:]

    for m in _tokens(page):
        kind = m.lastgroup
        if kind == "text":
            parts.append(m["text"])
            linked += len(m["text"]) if links else 0
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        if tag == "br":
            parts.append(" ")
        if tag in _INLINE or tag == "br":
            continue
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield path, text, linked
            parts, linked = [], 0
        links = 0
        names = [s.split(" ", 1)[0] for s in stack]
        if m["end"]:
            if tag in names:
                cut(len(names) - 1 - names[::-1].index(tag))
        else:
            if tag in _ENDS_P and "p" in names:
                cut(len(names) - 1 - names[::-1].index("p"))
            elif tag in _CLOSED_BY_ITSELF:
                closed = _CLOSED_BY_ITSELF[tag].split()
                if names and names[-1] in closed:
                    cut(len(names) - 1)
            if tag not in _VOID:
                found = " ".join("".join(g) for g in _NAMES.findall(m["attrs"])) if m["attrs"] else ""
                stack.append(f"{tag} {found.lower()}".rstrip().replace("/", "_"))
        path = "/".join(stack)
    text = " ".join(html.unescape("".join(parts)).split())
    if text:
        yield path, text, linked


@lru_cache(maxsize=1 << 14)
def _names_furniture(name: str, word: re.Pattern) -> bool:
    parts = re.split("[_-]", name.replace("side-bar", "sidebar"))
    if len(parts) > 1 and (parts[0] in _PLACES or (parts[0] in ("article", "post", "entry") and parts[1] != "header")):
        parts = parts[1:]
    return bool(word.fullmatch(parts[0])) and all(x in _WITH_IT or x.isdigit() or _NOT_MAIN_WORD.fullmatch(x) for x in parts[1:])


def is_furniture(path: str) -> bool:
    """Some open element is a menu, header, footer, advert and the like by its tag or its own names.

    Names of html, body, main and article and of what is around the outermost
    main or article tell of the layout, not of the element. The header of an
    article belongs to it.
    """
    steps = [step.partition(" ") for step in path.split("/")]
    tags = [tag for tag, _, _ in steps]
    frame = min((tags.index(t) for t in _MAIN if t in tags), default=0)
    in_article = False
    for n, (tag, _, names) in enumerate(steps):
        if tag in _NOT_MAIN_TAGS and not (in_article and tag == "header"):
            return True
        if names and tag not in _FRAMES:
            word = _OTHER_ARTICLES if n < frame else _NOT_MAIN_WORD
            if any(_names_furniture(name, word) and not (in_article and name == "header") for name in names.split()):
                return True
        in_article |= tag == "article"
    return False


def _in_main(path: str) -> bool:
    return any(s.split(" ", 1)[0] in _MAIN or " main" in s for s in path.split("/"))


def _fold(stream: list) -> list:
    """Replace each run of two or more equal groups by one repeated group."""
    for size in range(1, _LONGEST_GROUP + 1):
        out, i = [], 0
        while i < len(stream):
            unit, j = stream[i : i + size], i + size
            while len(unit) == size and stream[j : j + size] == unit:
                j += size
            if j > i + size:
                out.append(("+", *unit))
                i = j
            else:
                out.append(stream[i])
                i += 1
        stream = out
    return stream


def _repeat_known(stream: list, units: set) -> list:
    """Mark single occurrences of groups that repeat on the other side."""
    for unit in sorted(units, key=len, reverse=True):
        body, out, i = list(unit[1:]), [], 0
        while i < len(stream):
            if stream[i : i + len(body)] == body:
                out.append(unit)
                i += len(body)
            else:
                out.append(stream[i])
                i += 1
        stream = out
    return stream


def align(wrapper: list[tuple], stream: list) -> list[tuple]:
    """Generalise ``wrapper``, pairs of (token, optional), so that it also matches ``stream``."""
    old = [t for t, _ in wrapper]
    units = {t for t in (*old, *stream) if t[0] == "+"}
    if any(t[0] != "+" for t in old):
        optional = {}
        for t, o in wrapper:
            optional[t] = optional.get(t, False) or o
        old = _repeat_known(old, units)
        wrapper = [(t, optional.get(t, False)) for t in old]
    stream = _repeat_known(stream, units)
    merged, i, j = [], 0, 0
    for m in SequenceMatcher(None, old, stream, autojunk=False).get_matching_blocks():
        merged += [(t, True) for t in old[i : m.a]] + [(t, True) for t in stream[j : m.b]]
        merged += wrapper[m.a : m.a + m.size]
        i, j = m.a + m.size, m.b + m.size
    return merged


def _shown(token: tuple) -> str:
    return f"({' '.join(map(_shown, token[1:]))})+" if token[0] == "+" else f"<{token[1]}>#text"


def _key(path: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")))


def folded(keys: list[int]) -> list[tuple[int, int, int]]:
    """``(token, first, end)`` of a stream of blocks: runs of two or more equal groups are one token, however long."""
    stream = [(k, i, i + 1) for i, k in enumerate(keys)]
    for size in range(1, _LONGEST_GROUP + 1):
        names, out, i = [k for k, _, _ in stream], [], 0
        while i < len(stream):
            unit, j = names[i : i + size], i + size
            while len(unit) == size and names[j : j + size] == unit:
                j += size
            if j > i + size:
                group = b"+" + b"".join(k.to_bytes(8, "little", signed=True) for k in unit)
                out.append((_signed(xxhash.xxh64_intdigest(group)), stream[i][1], stream[j - 1][2]))
                i = j
            else:
                out.append(stream[i])
                i += 1
        stream = out
    return stream


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` whose second places rise, too."""
    ends, at, before = [], [], [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        ends[k:k + 1], at[k:k + 1] = [y], [n]
        before[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal tokens in order: ends alike, then tokens that occur once on both sides, then what is between them."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        once = {b[y]: y for y in range(j, j_end) if in_b[b[y]] == 1}
        anchors = _rising([(x, once[a[x]]) for x in range(i, i_end) if in_a[a[x]] == 1 and a[x] in once])
        if anchors:
            found += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(found)


#: A wrapper: its tokens in order, on how many pages each was found, the pages, and their tokens altogether.
_Wrapper = tuple[list[int], list[int], int, int]


def _aligned(one: _Wrapper, other: _Wrapper) -> _Wrapper:
    """Both wrappers in one; tokens of one side are optional, and go if most of eight pages or more lack them."""
    tokens, counts, i, j = [], [], 0, 0
    for x, y in [*matches(one[0], other[0]), (len(one[0]), len(other[0]))]:
        tokens += one[0][i:x] + other[0][j:y]
        counts += one[1][i:x] + other[1][j:y]
        if x < len(one[0]):
            tokens.append(one[0][x])
            counts.append(one[1][x] + other[1][y])
        i, j = x + 1, y + 1
    pages = one[2] + other[2]
    if pages >= 8:
        kept = [n for n, c in enumerate(counts) if 2 * c >= pages]
        tokens, counts = [tokens[n] for n in kept], [counts[n] for n in kept]
    return tokens, counts, pages, one[3] + other[3]


def merged(wrappers: list[_Wrapper]) -> _Wrapper:
    """Neighbours are aligned two by two until one is left."""
    while len(wrappers) > 1:
        wrappers = [_aligned(*wrappers[n : n + 2]) if n + 1 < len(wrappers) else wrappers[n] for n in range(0, len(wrappers), 2)]
    return wrappers[0]


def _template(wrapper: _Wrapper) -> list[int]:
    """Tokens on nine of ten pages and ``TEMPLATE_PAGES`` at least; none if they make up most of the pages, which are then versions of one text."""
    tokens, counts, pages, total = wrapper
    kept = [t for t, c in zip(tokens, counts) if c >= TEMPLATE_PAGES and 10 * c >= 9 * pages]
    return [] if 2 * len(kept) * pages > total else kept


def _page_slots(page: str) -> tuple[bool, int, dict[str, tuple[int, int, int]], list[int]]:
    """Whether a page has a main element, a hash of its texts, hash, characters and linked characters of each path, and its folded tokens.

    Furniture is left out, so copies under other urls and menus have one hash.
    """
    found = [b for b in blocks(page) if not is_furniture(b[0])]
    slots: dict[str, list] = {}
    for path, text, linked in found:
        slot = slots.setdefault(path, [xxhash.xxh64(), 0, 0])
        slot[0].update(text.encode("utf-8", "surrogatepass") + b"\0")
        slot[1] += len(text)
        slot[2] += linked
    whole = "\0".join(x for path, text, _ in found for x in (path, text)).encode("utf-8", "surrogatepass")
    closed = {path: (_signed(h.intdigest()), chars, linked) for path, (h, chars, linked) in slots.items()}
    tokens = [t for t, _, _ in folded([_key(path, text) for path, text, _ in found])]
    return any(_in_main(path) for path in slots), _signed(xxhash.xxh64_intdigest(whole)), closed, tokens


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def infer_wrapper(pages: list[str]) -> dict:
    """Wrapper of a list of pages of one host: its expression, and what is known of its slots as in :func:`host_wrappers`.

    The expression shows the paths of the template; texts are chosen by its tokens and slots.
    """
    wrapper: list[tuple] = []
    streams: dict[int, list[int]] = {}
    seen: dict[str, dict[int, tuple]] = {}
    framed = False
    for n, page in enumerate(pages):
        stream = _fold([("#", path) for path, _, _ in blocks(page)])
        wrapper = [(t, False) for t in stream] if n == 0 else align(wrapper, stream)
        own, key, slots, streams[key] = _page_slots(page)
        framed |= own
        for path, slot in {} if own else slots.items():
            seen.setdefault(path, {})[key] = slot
    slots = {}
    for path, s in seen.items():
        hashes, chars, linked = zip(*s.values())
        if len(s) >= TEMPLATE_PAGES and len(set(hashes)) == 1:
            slots[path] = False
        elif len(s) > 1 and 0 < 2 * sum(linked) < sum(chars):
            slots[path] = True
    shown = " ".join(_shown(t) + ("?" if o else "") for t, o in wrapper)
    template = _template(merged([(t, [1] * len(t), 1, len(t)) for _, t in sorted(streams.items())])) if streams else []
    return {"expression": shown, "framed": framed, "slots": slots, "template": template}


def main_text(page: str | None, wrapper: dict | None) -> str:
    """Article text of one page.

    Blocks that the wrapper has in the same order are template. Where the page
    has an article or main element, the text is what else stands inside and is
    no furniture. Else it is what is no furniture, no template slot of the
    wrapper, and is not mostly links unless its slot is known for texts. A
    page with nothing but templates keeps them.
    """
    found = [(path, text, linked) for path, text, linked in blocks(page or "") if not is_furniture(path)]
    slots, template = (wrapper or {}).get("slots", {}), (wrapper or {}).get("template", [])
    framed = any(_in_main(path) for path, _, _ in found)
    if template:
        stream = folded([_key(path, text) for path, text, _ in found])
        constant = {n for i, _ in matches([t for t, _, _ in stream], template) for n in range(*stream[i][1:])}
        own = [block for n, block in enumerate(found) if n not in constant]
        if any(_in_main(path) for path, _, _ in own) if framed else own:
            found = own
    if framed:
        return " ".join(text for path, text, _ in found if _in_main(path))
    loose = [(slots.get(path), text) for path, text, linked in found if 2 * linked < len(text) or slots.get(path)]
    return " ".join(text for known, text in loose if known is not False) or " ".join(text for _, text in loose)


def host(url: str = "url") -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_STREAM = pa.schema(
    [
        ("host", pa.string()), ("page", pa.int64()), ("tokens", pa.list_(pa.int64())),
        ("slots", pa.list_(pa.struct([("path", pa.string()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))),
    ]
)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            framed, key, slots, tokens = _page_slots(page.as_py())
            found = [] if framed else [dict(zip(("path", "text", "chars", "linked"), (path, *slot))) for path, slot in slots.items()]
            rows.append({"host": name, "page": key, "tokens": tokens, "slots": found})
        yield pa.RecordBatch.from_pylist(rows, _STREAM)


def _merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    tokens, counts, pages, total = merged([(r["tokens"], r["counts"], r["pages"], r["total"]) for r in rows])
    return pa.table(
        {
            "host": pa.array([rows[0]["host"]], pa.string()), "place": pa.array([rows[0]["part"]], pa.int64()),
            "tokens": pa.array([tokens], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
            "pages": pa.array([pages], pa.int64()), "total": pa.array([total], pa.int64()),
        }
    )


def _templates(streams: DataFrame) -> DataFrame:
    """``host, template`` from the distinct streams of each host, aligned ``FAN`` or so at a time in as many rounds as the largest host takes."""
    sizes = streams.groupBy("host").agg(F.countDistinct("page").alias("n"))
    path = scratch_path(streams.sparkSession, "host-sizes")
    sizes.write.parquet(path)
    sizes = streams.sparkSession.read.schema(sizes.schema).parquet(path)
    left = sizes.agg(F.max("n")).first()[0] or 0
    if fits_broadcast(sizes, F.octet_length("host") + 64, 32 * 1024 * 1024):
        sizes = F.broadcast(sizes)
    once = streams.groupBy("host", "page").agg(F.min("tokens").alias("tokens"))
    ones = F.transform("tokens", lambda _: F.lit(1).cast("long"))
    rows = once.join(sizes, "host").select(
        "host", F.col("page").alias("place"), "tokens", ones.alias("counts"), F.lit(1).cast("long").alias("pages"),
        F.size("tokens").cast("long").alias("total"), F.pmod(F.xxhash64("page"), F.ceil(F.col("n") / FAN)).alias("part"),
    )
    schema = "host string, place long, tokens array<long>, counts array<long>, pages long, total long"
    while True:
        # a join by host leaves a host in one place; its groups are dealt out anew
        wrappers = rows.repartition("host", "part").groupBy("host", "part").applyInArrow(_merge_group, schema)
        left = -(-left // FAN)
        if left <= 1:
            break
        rows = wrappers.withColumn("part", F.expr(f"place div {FAN}"))
    found = F.udf(lambda t, c, n, total: _template((t, c, n, total)), "array<long>")
    return wrappers.select("host", found("tokens", "counts", "pages", "total").alias("template")).where("size(template) > 0")


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) of each host that has a template or known slots.

    The template are the tokens of the host's aligned streams that nearly all its
    distinct pages have; counts of the alignment are lower bounds. Slots are block
    paths of pages without an article or main element. A slot is false (template)
    where it has one text on ``TEMPLATE_PAGES`` pages or more, and true where it
    holds links but more text than links; others are not listed. Pages of equal
    texts count once. Rows of a host are combined before they meet, first by page
    and then by path.
    """
    html = pages.where("html is not null").select(host().alias("host"), "html")
    path = scratch_path(pages.sparkSession, "page-streams")
    schema = "host string, page long, tokens array<long>, slots array<struct<path:string,text:long,chars:long,linked:long>>"
    html.mapInArrow(_streams, schema).write.parquet(path)
    streams = pages.sparkSession.read.schema(schema).parquet(path)
    rows = streams.select("host", "page", F.inline("slots"))
    once = rows.groupBy("host", "path", "page").agg(F.min("text").alias("text"), F.min("chars").alias("chars"), F.min("linked").alias("linked"))
    totals = once.groupBy("host", "path").agg(
        F.count("*").alias("pages"), (F.min("text") == F.max("text")).alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    template = F.col("same") & (F.col("pages") >= TEMPLATE_PAGES)
    mixed = (F.col("pages") > 1) & (F.col("linked") > 0) & (2 * F.col("linked") < F.col("chars"))
    known = totals.where(template | mixed).select("host", "path", (~template).alias("kept"))
    listed = known.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "kept")))).alias("slots"))
    both = listed.join(_templates(streams), "host", "full")
    return both.select("host", F.to_json(F.struct("slots", "template")).alias("wrapper"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str | None, dict | None] = {None: None}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("html"), batch.column("wrapper")):
            w = wrapper.as_py()
            if w not in parsed:
                if len(parsed) > 10_000:
                    parsed = {None: None}
                parsed[w] = json.loads(w)
            texts.append(main_text(page.as_py(), parsed[w]))
        kept = [batch.column(n) for n in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    A null page has an empty text; pages without a host share the empty host.
    Repeated rows give repeated rows. Wrappers are broadcast only if their
    measured size allows it.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "wrappers")
    host_wrappers(pages).write.parquet(path)
    wrappers = spark.read.parquet(path)
    if fits_broadcast(wrappers, F.octet_length("wrapper") + 64, 32 * 1024 * 1024):
        wrappers = F.broadcast(wrappers)
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(wrappers, "host", "left")
    texts = rows.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
