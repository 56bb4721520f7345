"""Main text of web pages by differencing each page with its nearest URL, checked against the page's marks.

A page's text comes as lines, one a block element. Elements that can only be furniture (menus, forms, scripts,
adverts and so on, by tag, role or class word) give no lines. Every page is compared with the page of the nearest URL path
on its host, one that marks
its article with the nearest that does so too, since they come from one template: both line lists are aligned by longest common subsequence, and the lines they share are deleted. A page that
marks its article is checked afterwards: lines outside its article and main elements go, and so does such an element that
differencing deletes whole while another has lines of its own; the elements that stay get their shared lines back, since
articles may hold equal lines. Pages of a host with equal lines and marks are copies: they take one place, that of the
first by path, and lose the same lines.

The nearest path is next to it in path order. Ranks within a host come from ordered chunks, so a host with a third
of all pages is spread; only line hashes travel between pages, and whole lines stay in one table.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage, ranked_in_chunks

CUT = frozenset("aside audio button canvas dialog embed footer form head iframe map menu nav noscript object script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol
    p pre section summary table tbody td tfoot th thead tr ul""".split())
MAIN = frozenset(("article", "main"))
#: Elements whose end tag may be left out, with the start tags that end them.
CELLS, GROUPS = frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("tbody", "tfoot"))
CLOSED_BY = {"p": BLOCK | frozenset(("aside", "footer", "form", "menu", "nav")), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
             "option": frozenset(("option", "optgroup")), "optgroup": frozenset(("optgroup",)), "tr": GROUPS | {"tr"}, "td": CELLS, "th": CELLS,
             "tbody": GROUPS, "thead": GROUPS, "tfoot": GROUPS}
#: Block elements that an implied end looks through.
LOOSE = frozenset(("address", "div", "p"))
CLOSERS = BLOCK | CUT               # their end tags end a cut element around them
STOPS = CLOSERS - LOOSE             # an implied end doesn't look past these
ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search".split())
MARKS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav
    navbar navigation newsletter notice notices popup promo promoted related replies share sharing sidebar signup skip social sponsor sponsored subscribe
    toolbar widget""".split())
COMMENTS = frozenset("comment comments disqus replies".split())


class Lines(HTMLParser):
    """The lines of one page: (text, number of the innermost article or main element around it, 0 outside)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self._text: list[str] = []
        self._main: list[int] = []          # numbers of the open article and main elements
        self._mains, self._cut = 0, 0
        self._path: list[str] = []          # open elements; those from place `_cut` (from 1; 0: none) are cut
        self._at: dict[str, list[int]] = {}         # places of the open elements of a tag
        self._ends: list[int] = []                  # places of open elements that matter to an implied end

    def _end_line(self) -> None:
        line = " ".join("".join(self._text).split())
        if line:
            self.lines.append((line, self._main[-1] if self._main else 0))
        self._text = []

    def _furniture(self, tag: str, attrs: list) -> bool:
        if tag in CUT or tag == "header" and not self._main:
            return True
        for name, value in attrs:
            if name == "role" and value in ROLES:
                return True
            if name in ("class", "id") and value:
                words = value.lower().replace("-", " ").replace("_", " ").split()
                if not (COMMENTS if tag == "article" else MARKS).isdisjoint(words):
                    return tag not in ("html", "body", "main")
        return False

    def _enter(self, tag: str) -> None:
        at = len(self._path)
        self._path.append(tag)
        self._at.setdefault(tag, []).append(at)
        if tag in STOPS or tag in CLOSED_BY:
            self._ends.append(at)

    def _leave(self, at: int) -> None:
        for tag in self._path[at:]:
            self._at[tag].pop()
        del self._path[at:]
        while self._ends and self._ends[-1] >= at:
            self._ends.pop()
        if at < self._cut:
            self._cut = 0

    def _end_implied(self, tag: str) -> None:
        """Ends the open elements that this start tag ends though their end tag was left out."""
        for at in reversed(self._ends):
            one = self._path[at]
            if tag in CLOSED_BY.get(one, ()):
                self._leave(at)
            elif one in STOPS:
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_implied(tag)
        if tag not in VOID:
            self._enter(tag)
        if self._cut:
            return
        if tag in BLOCK:
            self._end_line()
        if tag == "br":
            self._text.append(" ")
        if tag not in VOID and self._furniture(tag, attrs):
            self._cut = len(self._path)
        elif tag in MAIN:
            self._mains += 1
            self._main.append(self._mains)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        cut = self._cut
        if self._at.get(tag):
            at = self._at[tag][-1]
            if at >= cut - 1 or tag in CLOSERS:         # a cut element ends with its parent, not with a stray <b>
                self._leave(at)
            if cut and at >= cut - 1:
                return
        if self._cut:
            return
        if tag in BLOCK:
            self._end_line()
        if tag in MAIN and self._main:
            self._main.pop()

    def handle_data(self, data: str) -> None:
        if not self._cut:
            self._text.append(data)


def placed_lines(html: str | None) -> list[tuple[str, int]]:
    """Lines of a page, each with the number of its article or main element, 0 outside."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    return parser.lines


def page_lines(html: str | None) -> tuple[list[str], bool]:
    """Lines of a page by its marks alone, and whether it marks its article: those inside it, else all."""
    lines = placed_lines(html)
    inside = [t for t, main in lines if main]
    return (inside, True) if inside else ([t for t, _ in lines], False)


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.rpartition("@")[2].lower(), parts.path
    except ValueError:
        return "", url or ""


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of `a` in a longest common subsequence of a and b: for each line of a, its places in b, last first, extend
    the shortest known ends of common subsequences of every length."""
    head = len(commonprefix([a, b]))
    tail = len(commonprefix([a[head:][::-1], b[head:][::-1]]))
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    link, middle = chains[-1] if chains else None, []
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *middle[::-1], *range(len(a) - tail, len(a))]


def deletions(mains: list[int], shared: list[int]) -> list[int]:
    """Line numbers to delete, from those shared with the nearest page and each line's article or main element."""
    marked = set(mains) - {0}
    if not marked:
        return shared
    gone = set(shared)
    stay = {m for i, m in enumerate(mains) if m and i not in gone} or marked
    return [i for i, m in enumerate(mains) if m not in stay]


def _lines_table(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [placed_lines(h) for h in b["html"]]
            sites = [host_and_path(u) for u in b["url"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "host": [h for h, _ in sites], "path": [p for _, p in sites],
                                "lines": pd.Series([[t for t, _ in x] for x in found], dtype=object), "mains": pd.Series([[m for _, m in x] for x in found], dtype=object),
                                "hashes": pd.Series([[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in x] for x in found], dtype=object)})

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, host string, path string, lines array<string>, mains array<int>, hashes array<long>"
    return cut_lineage(p.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), compression="zstd")


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line numbers that a page loses by the nearer of its neighbours by path that is no copy of it, and by its marks."""
    for b in batches:
        rows, cuts = [], []
        for row, path, own, mains, *mates in zip(b["row"], b["path"], b["hashes"], b["mains"], b["path_before"], b["before"], b["path_after"], b["after"]):
            near = [(p, list(h)) for p, h in (mates[:2], mates[2:]) if h is not None]
            near.sort(key=lambda m: -len(commonprefix([path, m[0]])))
            found = (shared_lines(list(own), other) for _, other in near)
            cut = deletions(list(mains), next((same for same in found if len(same) < len(own)), []))
            if cut:
                rows.append(row)
                cuts.append(cut)
        yield pd.DataFrame({"row": pd.Series(rows, dtype="int64"), "cut": pd.Series(cuts, dtype=object)})


def main_text(pages: DataFrame, chunks: int = 4096) -> DataFrame:
    """One row per row of `pages` (page_id, url, html; other columns are ignored): page_id, url, text, n_chars.

    Null and empty html has no text. Pages without a host are neighbours of one another. Rows that share a page_id
    or url are pages of their own. No pages: no rows."""
    table = _lines_table(pages)
    every = table.where("size(hashes) > 0").select("row", "host", "path", "hashes", "mains", F.xxhash64("hashes", "mains").alias("class"))
    loose = cut_lineage(every.groupBy("host", "class").agg(F.min(F.struct("path", "row", "hashes", "mains")).alias("m"))
                        .select("host", (F.array_max("m.mains") > 0).alias("marked"), "class", "m.row", "m.path", "m.hashes", "m.mains"))
    parts = max(1, min(chunks, loose.count() // 512))
    placed = cut_lineage(loose.repartitionByRange(parts, "host", "marked", "path", "row").withColumn("chunk", F.spark_partition_id()))
    ranked = cut_lineage(ranked_in_chunks(placed, ["host", "marked"], F.col("chunk"), [F.col("path"), F.col("row")], F.lit(1), "rank"))
    mate = lambda step, name: ranked.select("host", "marked", (F.col("rank") + step).alias("rank"), F.col("path").alias(f"path_{name}"), F.col("hashes").alias(name))
    sides = ranked.join(mate(1, "before"), ["host", "marked", "rank"], "left").join(mate(-1, "after"), ["host", "marked", "rank"], "left")
    sides = sides.select("row", "path", "hashes", "mains", "path_before", "before", "path_after", "after")
    found = cut_lineage(sides.mapInPandas(_deleted, "row long, cut array<int>"))
    first = loose.select("host", "class", "row").join(found, "row").select("host", "class", "cut")
    cuts = cut_lineage(every.select("row", "host", "class").join(first, ["host", "class"]).select("row", "cut"))
    left = F.filter("lines", lambda x, i: F.col("cut").isNull() | ~F.array_contains("cut", i))
    text = F.array_join(left, "\n")
    return table.join(cuts, "row", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
