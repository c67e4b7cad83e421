"""Main text of web pages: roles of elements, and a style tree for each site that finds texts of low importance."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import saved

# Element names and words of class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("script style noscript template svg iframe object canvas head nav footer aside form button select textarea dialog menu".split())
#: Of the former, those whose content is no text.
SILENT = set("script style noscript template svg iframe object canvas head".split())
NOISE = set(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation footer breadcrumb breadcrumbs cookie cookies consent "
    "notice notices popup modal newsletter subscribe signup login share sharing social related comment comments respond reply replies disqus form widget complementary contentinfo search".split()
)
MAIN = {"article", "main"}
P_ENDS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: In an article these are content: only lists of words may take them out, never that other pages say the same.
SAID = set("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre td th tr caption figure figcaption details summary".split())
#: What a compound of a noise word first may end in: it names a part of the page (share-buttons), else a thing (share-price).
PARTS = set(
    "area articles bar block body box button buttons card column container content div feed field fields form footer group header icon icons inner item items label line link links list "
    "message module note outer panel part popup posts row section slot stories text thread title toolbar top unit widget wrap wrapper zone".split()
)
#: Compounds such as has-sidebar, no-comments or menu-open tell of a state, not of what the element is.
STATE_FIRST = set("has no not non with without is".split())
STATE_LAST = set("open opened closed collapsed expanded enabled disabled".split())
#: Attributes that hold content or addresses; the others are a style node's presentation.
CONTENT = set("href src srcset alt title content value datetime cite action placeholder".split())

#: A site is judged if it has so many pages of different texts, a branch if so many of these have it.
LEAST_PAGES = 5
#: In bits, so that it does not depend on the number of pages: less than two texts that are equally common.
LEAST_IMPORTANCE = 1.0
BROADCAST_TEXTS = 1_000_000


@lru_cache(maxsize=1 << 16)
def _words(label: str) -> frozenset[str]:
    """Words of class, id and role that say what the element is: the last of a compound, and the others if that is a part of a page.

    Compounds that tell of a state say nothing.
    """
    parts = [re.findall(r"[a-z]+", name) for name in label.split()]
    return frozenset(w for p in parts if p and p[0] not in STATE_FIRST and p[-1] not in STATE_LAST for w in (p if p[-1] in PARTS or p[-1] in NOISE else p[-1:]))


def _id(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A8C64E2 % ((1 << 61) - 1)


@lru_cache(maxsize=1 << 16)
def _step(path: int, tag: str, style: str) -> int:
    return _id(str(path), tag, style)


class _Page(HTMLParser):
    """One pass over a page: its pieces of text, which of them are kept, and its style nodes (all block elements)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.said, self.kept, self.nodes = [], [], bytearray(), []
        self.skipped, self.silent, self.inside, self.has_main = 0, 0, 0, False
        self.open = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in P_ENDS and self.open["p"] and next((e[0] for e in reversed(self.stack) if e[0] not in INLINE), "") == "p":
            self._close("p")
        if tag not in INLINE:
            self._add(" ")
        if self.stack:
            self.stack[-1][5].append(tag)
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs} if attrs else {}
        label = " ".join(named.get(k, "").lower() for k in ("class", "id", "role")) if named else ""
        words = _words(label) if label.strip() else ()
        noise = tag in NEVER or "hidden" in named or (tag == "header" and not self.inside)
        if tag not in ("html", "body") and tag not in MAIN and words:
            noise = noise or not NOISE.isdisjoint(words) or ("header" in words and not self.inside)
        main = tag in MAIN and not noise and not self.skipped
        silent = tag in SILENT
        self.skipped += noise
        self.silent += silent
        self.inside += main
        self.has_main |= main
        path = self.stack[-1][3] if self.stack else 0
        if tag not in INLINE:
            style = " ".join(f"{k}={re.sub('[0-9]+', '#', v)}" for k, v in sorted(named.items()) if k not in CONTENT and not k.startswith(("data-", "aria-"))) if named else ""
            path = _step(path, tag, style)
        self.open[tag] += 1
        self.stack.append((tag, noise, main, path, len(self.said), [], silent, self.inside))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self._add(" " if tag not in INLINE else "")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._add(" ")
        self._close(tag)

    def _close(self, tag):
        if not self.open[tag]:
            return
        while self.stack:
            if self._pop() == tag:
                break

    def _pop(self):
        name, noise, main, path, first, tags, silent, inside = self.stack.pop()
        self.open[name] -= 1
        said = inside and (name in SAID or any(t not in INLINE for t in tags))  # or it holds blocks
        if name not in INLINE and name not in ("html", "body") and name not in MAIN and not self.silent and not said:
            self.nodes.append((path, first, len(self.said), tags, inside))
        self.skipped -= noise
        self.silent -= silent
        self.inside -= main
        return name

    def handle_data(self, data):
        self._add(data)

    def _add(self, data):
        if not self.silent:
            self.said.append(data)
            self.kept.append(0 if self.skipped else 2 if self.inside else 1)

    def close(self):
        super().close()
        while self.stack:
            self._pop()

    def text(self):
        least = 2 if self.has_main else 1
        return " ".join("".join([s for s, k in zip(self.said, self.kept, strict=True) if k >= least]).split())

    def style(self):
        """The page's style nodes by path: each element's (text's hash, range of pieces), its presentation, whether in an article.

        An element's text is a run of the page's pieces, whose hash follows from those of the pieces up to its ends.
        """
        ends, upto, powers = [0], [0], [1]
        for piece in self.said:
            words = piece.split()
            if words:
                upto.append((upto[-1] * _BASE + _id(*words)) % _PRIME)
                powers.append(powers[-1] * _BASE % _PRIME)
            ends.append(len(upto) - 1)
        found = {}
        for path, first, last, tags, inside in self.nodes:
            a, b = ends[first], ends[last]
            if a < b:
                texts, shown, _ = found.setdefault(path, ([], [], inside))
                texts.append(((upto[b] - upto[a] * powers[b - a]) % _PRIME, first, last))
                shown.extend(tags)
        return found


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _ids(path, texts):
    """The id of what all elements of a path hold together, and those of each of them."""
    return _id("all", str(path), *(str(t[0]) for t in texts)), [_id("one", str(path), str(t[0])) for t in texts]


def read_page(html: str | None, low: set[int]) -> str:
    """Main text, without elements whose texts are of low importance on the site."""
    page = _parsed(html)
    if low:
        for path, (texts, _, _) in page.style().items():
            every, each = _ids(path, texts)
            for (_, first, last), one in zip(texts, each, strict=True):
                if every in low or one in low:
                    page.kept[first:last] = bytes(last - first)
    return page.text()


def low_texts(pages: DataFrame) -> DataFrame:
    """host, low: ids of the texts that the site style tree finds to be of low importance.

    Every block element is a style node: its path of tags and attributes, merged over the pages of a host. Pages of one
    main text count once. Outside article and main, a node's importance is the larger of the entropies of the texts and
    of the inner elements that the pages have there; below LEAST_IMPORTANCE its texts go, but those of a single page.
    Everywhere, an element goes whose text most pages have at that path; but in an article only one that holds its words
    itself and is no paragraph, heading, item or cell (SAID), and the articles themselves stay.
    """

    def trees(batches):
        for batch in batches:
            rows = []
            for html in batch.column("html").to_pylist():
                page = _parsed(html)
                branches, single = [], set()
                for path, (texts, shown, inside) in page.style().items():
                    every, each = _ids(path, texts)
                    single.update(each)
                    if not inside:
                        branches.append((path, every, _id(*shown)))
                rows.append((_id(page.text()), np.array(sorted(branches), np.int64).tobytes(), np.array(sorted(single), np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["host", "page", "branches", "single"]
            )

    def spread(batches):
        for batch in batches:
            for host, branches, single in zip(*(batch.column(c).to_pylist() for c in ("host", "branches", "single")), strict=True):
                b, s = np.frombuffer(branches, np.int64).reshape(-1, 3), np.frombuffer(single, np.int64)
                null = pa.nulls(len(s), pa.int64())
                yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(b), pa.string()), "path": pa.array(b[:, 0]), "text": pa.array(b[:, 1]), "tags": pa.array(b[:, 2])})
                yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(s), pa.string()), "path": null, "text": pa.array(s), "tags": null})

    found = pages.select("host", "html").mapInArrow(trees, "host string, page long, branches binary, single binary")
    once = found.groupBy("host", "page").agg(F.min(F.struct("branches", "single")).alias("x")).select("host", "x.branches", "x.single")
    once = saved(once, "html-trees")
    sites = once.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= LEAST_PAGES)
    counted = once.mapInArrow(spread, "host string, path long, text long, tags long").groupBy("host", "path", "text", "tags").agg(F.count("*").alias("n"))
    counted = saved(counted.where("path IS NOT NULL OR n > 1"), "html-nodes")
    nodes = counted.where("path IS NOT NULL")

    def importance(kind):
        each = nodes.groupBy("host", "path", kind).agg(F.sum("n").alias("n"))
        summed = each.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        return summed.select("host", "path", "m", (F.log2("m") - F.col("s") / F.col("m")).alias(f"of_{kind}"))

    both = importance("text").join(importance("tags").drop("m"), ["host", "path"])
    branches = both.where((F.col("m") >= LEAST_PAGES) & (F.greatest("of_text", "of_tags") < LEAST_IMPORTANCE)).select("host", "path")
    held = nodes.groupBy("host", "path", "text").agg(F.sum("n").alias("n")).where("n > 1").join(branches, ["host", "path"], "left_semi").select("host", "text")
    shared = counted.where("path IS NULL").join(sites, "host").where(2 * F.col("n") > F.col("of")).select("host", "text")
    return saved(held.union(shared).groupBy("host").agg(F.collect_set("text").alias("low")), "html-low")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    Text comes from the articles of a page, or its whole body if it has none, without elements whose name, class, id or
    role says that they are no part of it (these words are not asked of article and main), and without the texts that
    the site's style tree finds to be of low importance. White space is turned into
    single blanks, and blocks are joined by one. Null html is empty; a null url is a site of its own. Repeated rows
    stay; an empty table gives an empty result; other columns are not read.
    """
    source = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1), F.lit(""))).alias("host"))
    low = low_texts(source)
    small = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_TEXTS
    joined = source.join(F.broadcast(low) if small else low, "host", "left").select("page_id", "url", "html", "low")

    def read(batches):
        for batch in batches:
            texts = [read_page(h, set(b or ())) for h, b in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
