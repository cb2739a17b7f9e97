"""Main text of web pages by differencing with the page of the nearest URL.

Pages are ordered by host and path; each one is paired with the neighbour that shares more path segments.
The text lines of the two are aligned by their longest common subsequence and the shared ones deleted,
inside the page's article where they join the shared head or tail of the page, unless the neighbour is a
copy of the page. What the alignment leaves is content wherever it stands, but for elements of menus,
notices, forms and the like.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import binary
from tabsmith.session import scratch_path

# Element names of the page language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
NO_CONTENT = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video nav footer aside form button "
    "select option textarea fieldset dialog menu".split()
)
MAIN = frozenset("article main".split())
#: Words in the class, id or role of an element that mark it as no content.
NO_CONTENT_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted "
    "related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Parts of a class name that say how a page is laid out, not what the element is: no-sidebar, with-banner.
LAYOUT_WORDS = frozenset("has have layout no non not with without".split())
_OUTSIDE = ("", False, False, False)


def marked(names: str) -> bool:
    """Whether a class, id or role name marks an element as no content by one of its words."""
    for name in names.lower().split():
        words = set(name.replace("_", "-").split("-"))
        if not NO_CONTENT_WORDS.isdisjoint(words) and LAYOUT_WORDS.isdisjoint(words):
            return True
    return False


class _Reader(HTMLParser):
    """Collects (text, in main content, in a no-content element, in a wrapper) of every block in page order.

    A wrapper is a form or a marked element outside the article; it may hold the page's article.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, main, no content, wrapper
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, *(self.open[-1] if self.open else _OUTSIDE)[1:]))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_open(tag)
        if tag in VOID:
            return
        _, main, none, wrapper = self.open[-1] if self.open else _OUTSIDE
        values = {k: (v or "") for k, v in attrs}
        mark = tag == "form"
        none = none or (tag in NO_CONTENT and not mark) or (tag == "header" and not main)
        if not none and attrs and tag not in ("html", "body", "article", "main"):
            mark = mark or marked(" ".join(values.get(k, "") for k in ("class", "id", "role")))
            none = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        none, wrapper = none or (mark and main), wrapper or (mark and not main)
        if (none or wrapper) and tag in INLINE:
            self.flush()
        self.open.append((tag, main or tag in MAIN or values.get("role") == "main", none, wrapper))

    def _close_open(self, tag: str) -> None:
        """An open element of the same kind ends here, unless another block was opened inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag or (tag != "p" and name == "p"):
                del self.open[i:]
                return
            if name not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE or self.open[i][2] or self.open[i][3]:
                    self.flush()
                del self.open[i:]
                return
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, in main content, in a no-content element) of every block in page order.

    What a wrapper holds is no content, but for an article where the page has none outside of wrappers.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    free = any(main and not none and not wrapper for _, main, none, wrapper in reader.blocks)
    return [(text, main, none or (wrapper and (free or not main))) for text, main, none, wrapper in reader.blocks]


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def common_lines(left: list, right: list) -> list[int]:
    """Positions of ``left`` in a longest common subsequence with ``right`` (the earliest by position)."""
    where = defaultdict(list)
    for j, x in enumerate(right):
        where[x].append(j)
    ends: list[int] = []  # smallest end in right of a common subsequence of each length
    at: list[int] = []
    back: list[tuple[int, int]] = []  # (position in left, previous entry)
    for i, x in enumerate(left):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            if k < len(ends) and ends[k] == j:
                continue
            back.append((i, at[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                at.append(len(back) - 1)
            else:
                ends[k], at[k] = j, len(back) - 1
    out, entry = [], at[-1] if at else -1
    while entry >= 0:
        i, entry = back[entry]
        out.append(i)
    return out[::-1]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            lines = [[_line_hash(t) for t, _, _ in blocks(h)] if h else [] for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(lines, pa.list_(pa.int64()))], ["page_id", "lines"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("lines").to_pylist(), batch.column("others").to_pylist(), strict=True)
        gone = [common_lines(a, b) for a, b in both]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(gone, pa.list_(pa.int32()))], ["page_id", "shared"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            packed = [
                squeeze.compress(json.dumps(blocks(h), ensure_ascii=False).encode("utf-8", "replace")) if h else None
                for h in part.column("html").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), binary(packed)], ["page_id", "url", "packed"])


def kept_lines(found: list, shared: list[int]) -> list[str]:
    """The lines that are content: not shared with the neighbour, then not in a no-content element.

    Inside an article only shared lines in template position go: those that join the shared lines at the
    head or the tail of the page without a line of its own between. A sentence that another article happens
    to hold stays. A neighbour that shares every content line, or more than half of the article's
    characters, is a copy of the page: its alignment does not tell content from template, and only the
    elements decide.
    """
    gone = set(shared)
    content = [i for i, (_, _, none) in enumerate(found) if not none]
    head, tail = 0, len(found)
    while head < len(found) and head in gone:
        head += 1
    while tail > head and tail - 1 in gone:
        tail -= 1
    own = [i for i in content if i not in gone or (found[i][1] and head <= i < tail)]
    size = [sum(len(found[i][0]) for i in part if found[i][1]) for part in (own, content)]
    if own and 2 * size[0] >= size[1]:
        content = own
    elif any(found[i][1] for i in content):
        content = [i for i in content if found[i][1] or i not in gone]
    return [found[i][0] for i in content]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for packed, shared in zip(batch.column("packed").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            found = json.loads(zstandard.decompress(packed)) if packed else []
            texts.append(" ".join(kept_lines(found, shared or [])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(page_id, other): the page paired with each page of a host with several; see ``main_text``.

    Pages are sorted by (host, path, page_id) over the cluster and numbered through; neighbours are
    joined by number, so a host with most of the pages is spread like any other.
    """
    spark = pages.sparkSession
    address = F.regexp_replace(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.split(address, "[?#]")[0], r"(\.html?|/)+$", "")
    keys = pages.where("page_id IS NOT NULL").select(
        F.split(bare, "/")[0].alias("host"), F.regexp_replace(bare, "^[^/]*", "").alias("path"), F.col("page_id").cast("long").alias("page_id")
    ).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "page-order")
    keys.repartitionByRange(parts, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").withColumn(
        "at", F.monotonically_increasing_id()
    ).write.parquet(path)
    order = spark.read.parquet(path)
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part long, offset long"))
    ranked = order.withColumn("part", part).join(table, "part").select(
        "host", "path", "page_id", (F.col("at") - F.shiftleft("part", 33) + F.col("offset")).alias("rank")
    )
    steps = [(F.col("rank") + d).alias("rank") for d in (1, -1)]
    near = ranked.select("host", "path", F.col("page_id").alias("other"), F.explode(F.array(*steps)).alias("rank"))
    mine = ranked.select("page_id", "rank", F.col("host").alias("h"), F.col("path").alias("p"))
    pairs = near.join(mine, "rank").where("host = h AND other <> page_id")
    same = F.zip_with(F.split("path", "/"), F.split("p", "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    depth = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
    depth = F.when(depth == 0, F.size(same) + 1).otherwise(depth)
    return pairs.groupBy("page_id").agg(F.max_by("other", F.struct(depth, -F.col("other"))).alias("other"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages(page_id, url, html, ...)``.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined
    in page order by one blank. Null and empty html, and pages without content, have the empty text.
    See ``kept_lines`` for what is content. Pages of one host with equal paths are neighbours; a page alone on its host has
    none. A null url is the host of no name. Rows repeated with a page_id each get their result; a null
    page_id is passed on without a neighbour. Other columns are ignored; empty tables give empty results.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    lines = rows.where("page_id IS NOT NULL").select("page_id", "html").mapInArrow(_lines, "page_id long, lines array<long>")
    path = scratch_path(pages.sparkSession, "page-lines")
    lines.dropDuplicates(["page_id"]).write.parquet(path)
    lines = pages.sparkSession.read.parquet(path)
    pairs = nearest_pages(rows)
    both = pairs.join(lines, "page_id").join(lines.select(F.col("page_id").alias("other"), F.col("lines").alias("others")), "other")
    shared = both.select("page_id", "lines", "others").mapInArrow(_shared, "page_id long, shared array<int>")
    packed = rows.mapInArrow(_packed, "page_id long, url string, packed binary")
    return packed.join(shared, "page_id", "left").select("page_id", "url", "packed", "shared").mapInArrow(
        _texts, "page_id long, url string, text string"
    )
