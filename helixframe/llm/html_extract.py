"""Main-text extraction: page structure where a page marks its article, its host's suffix array for all other pages.

A page is cut into blocks in one pass over its markup. If it marks its article (article, main, or a main
role, class or id), the blocks in it that lie in no menu, notice, advert, form or comment are the text. Repeats must not
decide there: articles share passages with other pages of their host. On pages without such a mark, the blocks outside all
recognised boilerplate are open. Their token streams are concatenated by host into a suffix array (sorted
by the first `run` tokens); substrings of at least that length that stand in distinct pages of the host
are boilerplate, and the unique runs between them are the text. Copies are content, too: pages whose open
texts are near-duplicates (see near_dedup) count as one page, so they do not remove what they share.

Hosts are dealt over parts of bounded size by page, so a host with a third of all pages is many tasks. The
suffix array finds what repeats in a part; runs that repeat in other parts of the host are found by their
128-bit hashes, which are counted over the whole host, so results do not depend on its size.

Defined results: null or empty html gives an empty text; a null url is a host of its own; broken markup is
read as far as it goes, pages are read whole; rows that repeat a page are one page for the repeats, and each
gives a row; other columns are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, ship, written
from .near_dedup import near_duplicates

#: The elements that end a block, those whose content is no text, those that nest, and the void ones among them.
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = "script|style|noscript|template|title|textarea|iframe|svg|object|select|button"
NESTED = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table td th tr ul".split())
#: What is no part of an article, by element and by a word of its class, id or role.
OTHER = frozenset("aside dialog fieldset footer form menu nav".split())
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
TOP_WORDS = frozenset({"header", "banner", "masthead"})
#: Words that in a compound class name only say where or how the other word is.
PLACE_WORDS = frozenset("site page global main primary secondary top bottom left right upper lower inner outer box bar block area section container wrapper wrap list links link buttons button item items post posts article articles content".split())

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: The least tokens of a repeat, and the most pages of a host in one part.
RUN, PART_PAGES = 8, 2_000


@dataclass
class Element:
    up: int  # the element around it, or -1
    name: str
    other: set[str]  # the boilerplate words of its class names, id and role
    main: bool
    size: int = 0  # characters of text inside it
    kind: str = "open"
    root: int = -1  # the outermost element whose class made it "other"


def marks(attributes: str) -> tuple[set[str], bool]:
    """The boilerplate words of whole names in class, id and role, and whether one of the names says main.

    A compound counts if all its words are boilerplate or say where or how: site-footer does, no-sidebar does not."""
    words: set[str] = set()
    main = False
    if "=" in attributes:
        for m in MARKED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = set(re.split(r"[_-]+", name)) - {""}
                if parts <= OTHER_WORDS | TOP_WORDS | PLACE_WORDS:
                    words |= parts & (OTHER_WORDS | TOP_WORDS)
                main |= "main" in parts
    return words, main


def parse(page: str) -> tuple[list[Element], list[tuple[str, int]]]:
    """The nesting elements, outer ones first, and (text, innermost element or -1) in page order."""
    found: list[Element] = []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[int] = []
    at = 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, stack[-1] if stack else -1))
        held.clear()

    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7]) if m[6] else ("", m[1] or "", "")
        name = name.lower()
        if name == "br":
            held.append(" ")
        if name not in BLOCK:
            continue
        close()
        if name not in NESTED:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if found[stack[i]].name == name:
                    del stack[i:]
                    break
        elif not attributes.endswith("/"):
            words, main = marks(attributes)
            found.append(Element(stack[-1] if stack else -1, name, words, name == "main" or main and name != "body"))
            stack.append(len(found) - 1)
    held.append(page[at:])
    close()
    return found, out


def classify(found: list[Element], texts: list[tuple[str, int]]) -> None:
    """Sets the kinds. A class marks neither body, main and outer articles nor what holds the page's largest article."""
    for text, i in texts:
        if i >= 0:
            found[i].size += len(text)
    for e in reversed(found):
        if e.up >= 0:
            found[e.up].size += e.size
    free, outer = set(), {"article": [], "main": []}
    barred: list[tuple[bool, bool]] = []  # inside an element of OTHER, inside an article
    for i, e in enumerate(found):
        other, nested = barred[e.up] if e.up >= 0 else (False, False)
        other |= e.name in OTHER
        if e.name == "article" and not nested or e.name in ("body", "main"):
            free.add(i)
        if e.size and not other and not nested and (e.name == "article" or e.main):
            outer["article" if e.name == "article" else "main"].append(i)
        barred.append((other, nested or e.name == "article"))
    if held := outer["article"] or [i for i in outer["main"] if not found[i].other or found[i].name == "main"]:
        i = max(held, key=lambda i: found[i].size)
        while i >= 0:
            free.add(i)
            i = found[i].up
    for i, e in enumerate(found):
        up = found[e.up] if e.up >= 0 else None
        around = up.kind if up else "open"
        inside = around in ("article", "main")
        by_class = i not in free and e.other - (TOP_WORDS if inside else set())
        if around == "other" or e.name in OTHER or by_class or not inside and e.name == "header" and i not in free:
            e.kind = "other"
            if e.name not in OTHER and e.name != "header":
                e.root = up.root if around == "other" else i
        else:
            e.kind = "article" if "article" in (e.name, around) else "main" if e.main or around == "main" else around


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, kind) in page order. kind: "article", "main", "open" or "other"."""
    found, texts = parse(page)
    classify(found, texts)
    return [(t, found[i].kind if i >= 0 else "open") for t, i in texts]


def extract(page: str) -> tuple[str, list[str]]:
    """(the article's text, []) if the page marks it, else ("", the open blocks).

    If a main element holds more text outside its articles than all articles have, the main elements are the text. If
    classes leave nothing, the largest element that a class marks is open."""
    found, texts = parse(page)
    classify(found, texts)
    kinds = [found[i].kind if i >= 0 else "open" for _, i in texts]
    size = {k: sum(len(t) for (t, _), x in zip(texts, kinds, strict=True) if x == k) for k in ("article", "main", "open")}
    if size["article"] or size["main"]:
        within: list[bool] = []  # in a main element
        for e in found:
            within.append(e.kind != "other" and (e.main or e.up >= 0 and within[e.up]))
        if size["article"] >= size["main"]:
            return "\n".join(t for (t, _), k in zip(texts, kinds, strict=True) if k == "article"), []
        return "\n".join(t for (t, i), k in zip(texts, kinds, strict=True) if k in ("article", "main") and within[i]), []
    if not size["open"]:
        by_root: dict[int, list[str]] = {}
        for t, i in texts:
            if i >= 0 and found[i].root >= 0:
                by_root.setdefault(found[i].root, []).append(t)
        return "", max(by_root.values(), key=lambda x: sum(map(len, x)), default=[])
    return "", [t for (t, _), k in zip(texts, kinds, strict=True) if k == "open"]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` tokens (a power of two), by prefix doubling; equal prefixes have equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:]
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1] + 1
        h *= 2
    return rank


def repeated(pages: list[list[str]], run: int = RUN, families: list[int] | None = None) -> list[np.ndarray]:
    """For each page's tokens, which lie in a substring of at least `run` tokens that stands in distinct pages too.

    families: a number for each page; pages with one number count as one."""
    words: dict[str, int] = {}
    lengths = [len(p) for p in pages]
    ids = [words.setdefault(w, len(words)) for p in pages for w in p]
    ends = np.cumsum([0, *(n + 1 for n in lengths)])
    stream = np.empty(ends[-1], dtype=np.int64)
    owner = np.repeat(np.arange(len(pages)) if families is None else np.array(families, dtype=np.int64), [n + 1 for n in lengths])
    place = np.ones(len(stream), dtype=bool)
    place[ends[1:] - 1] = False
    stream[place] = ids
    stream[~place] = len(words) + np.arange(len(pages))  # a separator of its own after each page
    depth = 1 << (run - 1).bit_length()
    rank = suffix_ranks(stream, depth)
    order = np.argsort(rank, kind="stable")  # the suffix array, to the depth
    groups = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
    first, last = np.minimum.reduceat(owner[order], groups), np.maximum.reduceat(owner[order], groups)
    size = np.diff(np.r_[groups, len(order)])
    hit = np.empty(len(stream), dtype=bool)
    hit[order] = np.repeat(first != last, size)
    steps = np.zeros(len(stream) + depth, dtype=np.int64)
    np.add.at(steps, np.flatnonzero(hit), 1)
    np.add.at(steps, np.flatnonzero(hit) + depth, -1)
    covered = np.cumsum(steps)[: len(stream)] > 0
    return [covered[a : b - 1] for a, b in pairwise(ends)]


class RunHashes(dict):
    """Two 64-bit numbers by token, and from them those of every run of `run` tokens of a page."""

    ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        d = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self[word] = out = (int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big"))
        return out

    def of(self, tokens: list[str], run: int) -> np.ndarray:
        n = len(tokens) - run + 1
        out = np.zeros((2, max(0, n)), dtype=np.uint64)
        if n > 0:
            words = np.array([self[w] for w in tokens], dtype=np.uint64).T
            for row, word, odd in zip(out, words, self.ODD, strict=True):
                for i in range(run):
                    row *= np.uint64(odd)
                    row += word[i : i + n]
        return out.view(np.int64)


def unique_runs(pages: list[list[str]], run: int = RUN, elsewhere: list[list[int]] | None = None, families: list[int] | None = None) -> list[str]:
    """Each page's open blocks (white space already single) without the tokens that are covered by repeats.

    elsewhere: for each page, where runs begin that repeat on pages that are not given. families: see repeated()."""
    tokens = [[w for block in p for w in block.split(" ")] for p in pages]
    out = []
    for page, gone, starts in zip(pages, repeated(tokens, run, families), elsewhere or [[]] * len(pages), strict=True):
        for i in starts:
            gone[i : i + run] = True
        kept, at = [], 0
        for block in page:
            w = block.split(" ")
            if rest := [x for x, g in zip(w, gone[at : at + len(w)], strict=True) if not g]:
                kept.append(" ".join(rest))
            at += len(w)
        out.append("\n".join(kept))
    return out


def main_text(pages: DataFrame, run: int = RUN, part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, url, text: one row a page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shape = "page_id long, url string, text string"

    def read(batches: Iterator) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                got = [extract(p) for p in part.column(2).to_pylist()]
                cols = [pa.array([t for t, _ in got], pa.string()), pa.array([o for _, o in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", "text", "open"])

    def settle(host: pa.Table) -> pa.Table:
        keys = host["key"].to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}  # rows that repeat a page are one
        same = host.take(pa.array(list(first.values()), pa.int64()))
        texts = unique_runs(same["open"].to_pylist(), run, [x or [] for x in same["elsewhere"].to_pylist()], same["family"].to_pylist())
        by_key = dict(zip(first, texts, strict=True))
        return host.select(["page_id", "url"]).append_column("text", pa.array([by_key[k] for k in keys], pa.string()))

    def runs(batches: Iterator) -> Iterator:
        hashes = RunHashes()
        for b in batches:
            for host, key, family, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h1, h2 = hashes.of([w for block in page for w in block.split(" ")], run)
                cols = [pa.array([host] * len(h1), pa.string()), pa.array(h1), pa.array(h2), *(pa.array(np.full(len(h1), x, dtype=np.int64)) for x in (key, family)), pa.array(np.arange(len(h1), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "h1", "h2", "key", "family", "at"])

    ship(pages.sparkSession)
    # what extract() finds decides; each page is parsed once
    pages = written(rows.mapInArrow(read, f"{shape}, open array<string>"), "pages")
    found = pages.where("text != ''").select("page_id", "url", "text")
    loose = pages.where("text = ''").select("page_id", "url", "open")
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host")
    loose = loose.select("*", host, F.xxhash64("page_id", "url", "open").alias("key"))
    if loose.isEmpty():
        return found
    same = near_duplicates(loose.select("key", F.array_join("open", " ").alias("t")), id_col="key", text_col="t").select(F.col("doc_id").alias("key"), F.col("component_id").alias("family")).distinct()
    loose = loose.join(same, "key")
    parts = loose.groupBy("host").agg(F.ceil(F.count("*") / F.lit(part_pages)).cast("int").alias("parts"))
    dealt = loose.join(parts, "host").withColumn("part", F.pmod("key", F.col("parts")))
    if parts.where("parts > 1").isEmpty():
        dealt = dealt.withColumn("elsewhere", F.lit(None).cast("array<int>"))
    else:
        places = dealt.where("parts > 1").select("host", "key", "family", "open").mapInArrow(runs, "host string, h1 long, h2 long, key long, family long, at int")
        shared = places.groupBy("host", "h1", "h2").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a != b").select("host", "h1", "h2")
        dealt = dealt.join(places.join(shared, ["host", "h1", "h2"]).groupBy("key").agg(F.collect_set("at").alias("elsewhere")), "key", "left")
    return found.unionByName(dealt.groupBy("host", "part").applyInArrow(settle, shape))
