"""Main text of web pages by union-free regular expressions, one wrapper for each host.

A page is a stream of symbols: tags (with class or id) and text slots, each slot with the role that its
elements give it: article, page furniture, or neither. Repeated neighbours are folded into groups. A host's
wrapper starts as one stream and is aligned with the others in turn; a mismatch becomes a repeated group
where the strange part repeats what was just matched, an optional group where either side goes on later,
and an optional slot where only one side has text. Streams that a wrapper accepts change nothing.

1. Equal streams of a host are counted once (partial aggregation), so the number of pages doesn't matter.
2. Shares of a host's streams are aligned apart; each passes on the streams that changed its wrapper, and
   those are aligned once more. No task gathers a host's pages.
3. Each page is aligned with its host's wrapper, which gives its texts slots; a repeated group is one place
   in the wrapper, however often a page repeats it. A slot is constant if half of the host's pages and LEAST
   different ones have it, all with the same texts: that is the template's text, others are the pages' own.
   Only the least and greatest digest of a slot's texts and a few digests of pages are gathered.
4. The main text is that of marked articles without constant slots of loosely named elements in them, or on pages without such marks (whatever the host's other pages
   have) that of slots outside page furniture which are not constant. What a wrapper does not align is never
   constant, and a page of constant slots alone keeps them.

A class or id is page furniture for certain if it has no other words than such of furniture; headings, captions and
the anchors of sections in an article are not. One word of it is enough outside articles; in an article it takes
constant slots too. It never hides a <main>, and an <article> only if it is certain.

Scripts, styles, comments and forms are no text. Blocks end at block elements and at <br>. References are
decoded, white space within a block is one space, blocks are joined by a line feed.

Null and empty html give empty text. Pages without a host are a host of their own. Unclosed tags, comments
and scripts end with the page. Very long pages are one row; nothing is cut. Repeated rows give repeated
results. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe_replay import blocks
from corvane.llm.common import staged

SHARES, LONGEST_REPEAT = 16, 12
FAR = 400  # symbols that alignment looks ahead after a mismatch
LEAST = 4  # different pages that a constant slot takes

# HTML element names and the words that mark page furniture.
RAW = "script|style|noscript|template|textarea|svg|iframe|select|button|title|object|canvas|audio|video|math"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset("nav header footer aside form menu head dialog fieldset label input legend search".split())
ARTICLE = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget related recommended share sharing social follow header masthead footer copyright legal comment comments commentlist disqus reply replies respond discussion pagination pager toolbar skip form".split()
)
# A class or id names a kind of furniture for certain if it has only such words and these beside them. States
# (has-sidebar) name none. In an article some words are the text's own subject, and ids are its anchors.
BESIDE_WORDS = frozenset("area article articles bar block body bottom box button buttons container content entry group icon icons id inline inner item items left link links list main outer page pages panel post posts right section site slot text thread title top unit wrap wrapper".split())
STATE = re.compile(r"(?:^|[-_])(?:no|has|with|without|hide|is)[-_]")
SUBJECT_WORDS = frozenset("discussion legal notice alert follow".split())
CERTAIN_IDS = frozenset("comments commentlist disqus respond sidebar nav navbar breadcrumb breadcrumbs newsletter cookie cookies sharing masthead toolbar pager pagination".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 figcaption caption".split())
ARTICLE_ROLES = frozenset("main article".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
CLOSES = {"p": BLOCK - {"br", "option", "title", "head", "html", "body"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def names_furniture(name: str, within: bool, is_id: bool) -> int:
    """2: a class or id names furniture for certain; 1: one of its words does; 0: none. within: in an article."""
    words = WORD.findall(name)
    found = FURNITURE_WORDS.intersection(words)
    if not found or STATE.search(name):
        return 0
    if within and not (found & CERTAIN_IDS if is_id else found - SUBJECT_WORDS):
        return 1
    return 2 if all(w in found or w in BESIDE_WORDS for w in words) else 1


def role_of(name: str, attributes: str, within: bool = False) -> tuple[str, str]:
    """(role, what tells elements of one name apart). "x": furniture, "m": article, "w", "l": furniture by its
    class or id for certain or by a word of it, or "". within: the element lies in an article."""
    mark = ""
    role = "x" if name in FURNITURE else "m" if name in ARTICLE else ""
    words = 0
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = role or ("x" if value in FURNITURE_ROLES else "m" if value in ARTICLE_ROLES else "")
        else:
            mark = mark or value.split(" ")[0][:40]
            if name not in ("html", "body") and not (within and name in HEADINGS):
                words = max([words, *(names_furniture(v, within, m[1].lower() == "id") for v in value.split())])
    return role or ("", "l", "w")[words], mark


def role_within(outer: str, own: str, name: str) -> str:
    """The role within an element of its own role, in an element of the role outer.

    "c": in an article, loosely named furniture; "v": an article in loosely named furniture outside.
    """
    if outer == "x" or own == "x":
        return "x"
    if own == "m":
        return "m" if outer not in ("w", "l") or name == "main" else "x" if outer == "w" else "v"
    if outer in ("m", "c", "v"):
        return "x" if own == "w" else "c" if own == "l" and outer == "m" else outer
    return "w" if "w" in (outer, own) else own or outer


def parse(page: str) -> tuple[list[str], list[tuple[int, str]]]:
    """(symbols, texts: (symbol's place, decoded text)); a text symbol is T, Tm in articles, Tx, Tw, Tl in furniture; Tc, Tv: see role_within."""
    symbols: list[str] = []
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and the role within them
    at, role = 0, ""

    def text(raw: str) -> None:
        raw = html.unescape(raw)
        if raw and not raw.isspace():
            if not (symbols and symbols[-1][0] == "T"):
                symbols.append("T" + role)
            texts.append((len(symbols) - 1, raw))
        elif raw and texts:
            texts.append((-1, " "))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                role = stack[-1][1] if stack else ""
            symbols.append("/" + name)
        else:
            while stack and name in CLOSES.get(stack[-1][0], ()):
                stack.pop()
            role = stack[-1][1] if stack else ""
            own, mark = role_of(name, m[4] or m[7] or "", role in ("m", "c", "v"))
            if role in ("m", "c", "v") and own and own != "m" and (name == "header" or "header" in mark):
                own = ""  # an article's own heading
            symbols.append(f"{name}.{mark}" if mark else name)
            if name not in VOID and not (m[4] or m[7] or "").endswith("/"):
                role = role_within(role, own, name)
                stack.append((name, role))
        if name in BLOCK:
            texts.append((-1, "\n"))
    if at < len(page):
        text(page[at:])
    return symbols, texts


def fold(s: list) -> list:
    """Neighbouring equal runs of up to LONGEST_REPEAT symbols become one repeated group."""
    out: list = []
    for x in s:
        out.append(x)
        again = True
        while again:
            again = False
            for n in range(1, min(LONGEST_REPEAT, len(out) - 1) + 1):
                tail = tuple(out[-n:])
                if out[-n - 1] == ("+", tail):
                    del out[-n:]
                    again = True
                    break
                if len(out) >= 2 * n and tuple(out[-2 * n : -n]) == tail and any(isinstance(y, str) and y[0] == "T" for y in tail):
                    out[-2 * n :] = [("+", tail)]
                    again = True
                    break
    return out


def match(body, s: list, j: int) -> int | None:
    """Where s goes on after body, matched greedily from j; None if it doesn't."""
    for x in body:
        if j < len(s) and s[j] == x:
            j += 1
        elif isinstance(x, str):
            return None
        elif x[0] == "?":
            k = match(x[1], s, j)
            j = j if k is None else k
        else:
            some = x[0] == "*"
            while j < len(s) and (k := j + 1 if s[j] == ("+", x[1]) else match(x[1], s, j)) is not None and k > j:
                j, some = k, True
            if not some:
                return None
    return j


def accepts(wrapper: list, s: list) -> bool:
    return match(wrapper, s, 0) == len(s)


def generalise(w: list, s: list) -> list:
    """The wrapper w, changed to accept the stream s as well."""
    out: list = []
    i = j = 0
    while i < len(w) or j < len(s):
        a, b = (w[i] if i < len(w) else None), (s[j] if j < len(s) else None)
        if a is not None and a == b:
            out.append(a)
            i, j = i + 1, j + 1
            continue
        if isinstance(a, tuple):
            k = match([a], s, j)
            if k is not None:
                out.append(a)
                i, j = i + 1, k
                continue
            if a[0] == "+":  # it may be missing
                out.append(("*", a[1]))
                i += 1
                continue
        if isinstance(b, tuple):  # the stream repeats what the wrapper has once
            n = len(b[1])
            if tuple(w[i : i + n]) == b[1]:
                out.append(b)
                i, j = i + n, j + 1
                continue
            if tuple(out[-n:]) == b[1]:
                out[-n:] = [b]
                j += 1
                continue
        for side, k in ((s, j), (w, i)):  # what comes next repeats what was just matched
            n = next((n for n in range(1, LONGEST_REPEAT + 1) if k + n <= len(side) and (tuple(out[-n:]) == tuple(side[k : k + n]) or out and out[-1] in (("+", tuple(side[k : k + n])), ("*", tuple(side[k : k + n])))) and any(isinstance(y, str) and y[0] == "T" for y in side[k : k + n])), 0)
            if n:
                if isinstance(out[-1], str) or out[-1][0] == "?" or out[-1][1] != tuple(side[k : k + n]):
                    out[-n:] = [("+", tuple(side[k : k + n]))]
                i, j = (i, j + n) if side is s else (i + n, j)
                break
        else:
            if isinstance(a, str) and a[0] == "T":
                out.append(("?", (a,)))
                i += 1
            elif isinstance(b, str) and b[0] == "T":
                out.append(("?", (b,)))
                j += 1
            else:
                in_s = s.index(a, j) - j if a is not None and a in s[j:] else None
                in_w = w.index(b, i) - i if b is not None and b in w[i:] else None
                if in_s is not None and (in_w is None or in_s <= in_w):
                    out.append(("?", tuple(s[j : j + in_s])))
                    j += in_s
                elif in_w is not None:
                    out.append(("?", tuple(w[i : i + in_w])))
                    i += in_w
                else:
                    if a is not None:
                        out.append(a if isinstance(a, tuple) and a[0] in "?*" else ("?", (a,)))
                        i += 1
                    if b is not None:
                        out.append(b if isinstance(b, tuple) and b[0] in "?*" else ("?", (b,)))
                        j += 1
    return out


def slots(w) -> set[str]:
    return {y for x in w for y in (slots(x[1]) if not isinstance(x, str) else {x} if x[0] == "T" else ())}


def thawed(x):
    """A wrapper or stream from JSON."""
    return [y if isinstance(y, str) else (y[0], tuple(thawed(y[1]))) for y in x]


def numbered(wrapper, first: int = 0) -> tuple[list, int]:
    """The wrapper as (sign, symbol or body, slot or -1), its text slots numbered from first; and the next number."""
    out = []
    for x in wrapper:
        if isinstance(x, str):
            out.append(("", x, first if x[0] == "T" else -1))
            first += x[0] == "T"
        else:
            body, first = numbered(x[1], first)
            out.append((x[0], body, -1))
    return out, first


def place(body, s: list[str], j: int, found: list[tuple[int, int]]) -> int | None:
    """match() on a numbered wrapper and an unfolded stream; adds (place in s, slot) of texts to found."""
    for sign, x, slot in body:
        if not sign:
            if j >= len(s) or s[j] != x:
                return None
            if slot >= 0:
                found.append((j, slot))
            j += 1
            continue
        some = sign != "+"
        while j < len(s):
            n = len(found)
            k = place(x, s, j, found)
            if k is None or k == j:
                del found[n:]
                break
            j, some = k, True
            if sign == "?":
                break
        if not some:
            return None
    return j


def head(x) -> str:
    """The first symbol of a numbered wrapper's part."""
    while not isinstance(x[1], str):
        x = x[1][0]
    return x[1]


def places(wrapper, s: list[str]) -> dict[int, int]:
    """{place in s: slot} of the texts that the numbered wrapper aligns; what either side has alone is passed over."""
    found: list[tuple[int, int]] = []
    i = j = 0
    while i < len(wrapper) and j < len(s):
        n = len(found)
        k = place(wrapper[i : i + 1], s, j, found)
        if k is not None:
            i, j = i + 1, k
            continue
        del found[n:]
        x = head(wrapper[i])
        in_s = next((k for k in range(j, min(j + FAR, len(s))) if s[k] == x), None)
        in_w = next((k for k in range(i + 1, min(i + FAR, len(wrapper))) if head(wrapper[k]) == s[j] and place(wrapper[k : k + 1], s, j, []) not in (None, j)), None)
        if in_s is not None and in_s > j and (in_w is None or in_s - j <= in_w - i):
            j = in_s
        elif in_w is not None:
            i = in_w
        else:
            i, j = i + 1, j + 1
    return dict(found)


def slot_texts(symbols: list[str], texts: list[tuple[int, str]], slot_of: dict[int, int]) -> dict[int, str]:
    """{slot: its texts on a page}."""
    got: dict[int, list[str]] = {}
    for at, raw in texts:
        if at >= 0 and at in slot_of:
            got.setdefault(slot_of[at], []).append(raw.strip())
    return {slot: "\n".join(t) for slot, t in got.items()}


def marked(symbols: list[str]) -> bool:
    return "Tm" in symbols or "Tc" in symbols


def main_text(page: str | None, wrapper: list | None, constant: frozenset[int] = frozenset()) -> str:
    """wrapper: numbered; constant: its slots with the template's text."""
    symbols, texts = parse(page or "")
    # what other pages of the host mark says nothing about a page without marks
    wanted = ("Tm", "Tc") if marked(symbols) else ("T", "Tv")
    kept = {i for i, x in enumerate(symbols) if x in wanted}
    decided = ("Tc",) if marked(symbols) else wanted
    if constant and any(x in decided for x in symbols):
        slot_of = places(wrapper, symbols)
        kept = {i for i in kept if symbols[i] not in decided or slot_of.get(i) not in constant} or kept
    parts, block = [], []
    for at, raw in [*texts, (-1, "\n")]:
        if at >= 0:
            if at in kept:
                block.append(raw)
        elif raw == "\n":
            if line := " ".join("".join(block).split()):
                parts.append(line)
            block = []
        else:
            block.append(raw)
    return "\n".join(parts)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def streams(pages: DataFrame) -> DataFrame:
    """(host, stream): each page's folded symbols as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps(fold(parse(h or "")[0])) for h in b.column("html").to_pylist()], pa.string())], names=["host", "stream"])

    return pages.select("host", "html").mapInArrow(run, "host string, stream string")


def aligned(sorted_streams: DataFrame, last: bool) -> DataFrame:
    """Of rows sorted by host (and share): the streams that changed a wrapper, or at last the wrappers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = wrapper = None
        hosts, out = [], []
        for b in batches:
            for host, share, text in zip(*(b.column(c).to_pylist() for c in ("host", "share", "stream")), strict=True):
                s = thawed(json.loads(text))
                if (host, share) != key:
                    if last and key is not None:
                        hosts.append(key[0])
                        out.append(json.dumps(wrapper))
                    key, wrapper, changed = (host, share), s, True
                else:
                    changed = not accepts(wrapper, s)
                    if changed:
                        wrapper = generalise(wrapper, s)
                if changed and not last:
                    hosts.append(host)
                    out.append(text)
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.string())], names=["host", "stream"])
                hosts, out = [], []
        if last and key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([json.dumps(wrapper)], pa.string())], names=["host", "stream"])

    return sorted_streams.mapInArrow(run, "host string, stream string")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html), with wrappers as JSON."""
    kinds = staged(streams(pages).distinct().withColumn("share", F.pmod(F.xxhash64("stream"), F.lit(SHARES)).cast("int")), "streams")
    order = lambda df: df.repartition("host", "share").sortWithinPartitions("host", "share", F.length("stream"), "stream")
    witnesses = aligned(order(kinds), last=False).distinct().withColumn("share", F.lit(0))
    return staged(aligned(order(witnesses), last=True).withColumnRenamed("stream", "wrapper"), "wrappers")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def constants(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, wrapper, constant: the wrapper's slots with the template's text) of pages (host, html) and wrappers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in blocks(batches, "html"):
            # (host, marked, slot): least and greatest digest of its texts, pages, least digests of pages; slot -1 is the page
            seen: dict[tuple[str, bool, int], list] = {}
            for host, page, text in zip(*(b.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                if len(known) > 5000:
                    known.clear()
                if text not in known:
                    known[text] = numbered(thawed(json.loads(text)))[0]
                symbols, texts = parse(page or "")
                m, got, whole = marked(symbols), {-1: ""}, 0
                decided = ("Tc",) if m else ("T", "Tv")
                if any(x in decided for x in symbols):
                    whole = digest("\n".join(t for _, t in texts))
                    got |= slot_texts(symbols, texts, {i: k for i, k in places(known[text], symbols).items() if symbols[i] in decided})
                for slot, t in got.items():
                    d = digest(t)
                    x = seen.setdefault((host, m, slot), [d, d, 0, set()])
                    x[0], x[1], x[2] = min(x[0], d), max(x[1], d), x[2] + 1
                    x[3].add(whole)
                    if len(x[3]) > 2 * LEAST:
                        x[3] = set(sorted(x[3])[:LEAST])
            rows = [(*k, x[0], x[1], x[2] if n == 0 else 0, p) for k, x in seen.items() for n, p in enumerate(sorted(x[3])[:LEAST])]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.bool_(), *[pa.int64()] * 5], strict=True)], names=["host", "marked", "slot", "lo", "hi", "n", "page"])

    # a wrapper has all slots of its host's pages; without these there is nothing to decide
    open_ = found.where(F.col("wrapper").rlike('"T[cv]?"'))
    each = pages.join(open_, "host").select("host", "html", "wrapper").mapInArrow(run, "host string, marked boolean, slot long, lo long, hi long, n long, page long")
    # the distinct pages are counted up to LEAST by a sketch of bounded size, exact for so few
    total = staged(each.groupBy("host", "marked", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.approx_count_distinct("page").alias("kinds")), "slots")
    half = total.where("slot = -1").select("host", "marked", (F.col("n") / 2).alias("half"))
    fixed = total.where(f"slot >= 0 and lo = hi and kinds >= {LEAST}").join(half, ["host", "marked"]).where("n >= half").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("constant"))
    return staged(found.join(fixed, "host", "left"), "constants")


def extract(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, url, text) for every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of("url"))
    both = rows.join(constants(rows, wrappers(rows)), "host", "left").select("id", "url", "html", "wrapper", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in blocks(batches, "html"):
            found, fixed = b.column("wrapper").to_pylist(), b.column("constant").to_pylist()
            if len(known) > 5000:
                known.clear()
            for w, c in zip(found, fixed, strict=True):
                if c and w not in known:
                    known[w] = numbered(thawed(json.loads(w)))[0]
            got = [main_text(h, known.get(w), frozenset(c or ())) for h, w, c in zip(b.column("html").to_pylist(), found, fixed, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(got, pa.string())], names=["id", "url", "text"])

    return both.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
