"""Pages and sheets as blocks: a heading, the text below it and its links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements
from ..functions.links import resolve_url
from ..functions.parsing import _let

#: A block of fewer characters goes into the one before it. Fixed value.
SHORT = 30
#: An item of a gallery that a page carries as text. Fixed value.
GALLERY = r'"description":"((?:\\.|[^"\\])*)"\s*,\s*"title":"((?:\\.|[^"\\])*)"'
#: Bytes of an Arrow batch that goes to a Python worker; pages of one that comes back.
BATCH_BYTES, PAGES = 4 << 20, 64
_SEGMENTS = "page_id long, url string, html string, segments array<struct<kind:string,text:string,href:string>>"


def page_segments(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with their ``segments``, page by page; nothing is shuffled.

    Batches are bounded by bytes on their way in and by pages on their way out, however many pages a task has.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("href", pa.string())]))
        for batch in batches:
            for part in (batch.slice(at, PAGES) for at in range(0, batch.num_rows, PAGES)):
                found = [[dict(zip(("kind", "text", "href"), s, strict=True)) for s in elements.segments(h)] for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "html")), pa.array(found, kind)], ["page_id", "url", "html", "segments"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, _SEGMENTS)


def _unescaped(s: Column) -> Column:
    for escape, plain in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\"", '"'), ("\\\\", "\\"), ("\u00a0", " ")):
        s = F.replace(s, F.lit(escape), F.lit(plain))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _gallery(html: Column) -> Column:
    """(title, text) of the gallery's items that have both."""
    part = lambda k: F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(GALLERY), F.lit(k)), _unescaped)
    return F.filter(F.zip_with(part(2), part(1), lambda t, d: F.struct(t.alias("title"), d.alias("text"))), lambda x: (x["title"] != "") & (x["text"] != ""))


def _block(part: Column) -> Column:
    """The block of consecutive segments, of which none but the first is a heading."""
    first = F.get(part, F.lit(0))
    title = F.when(first["kind"] == "heading", first["text"])
    text = F.array_join(F.transform(F.filter(part, lambda s: (s["kind"] == "text") & ~s["text"].eqNullSafe(title)), lambda s: s["text"]), "\n")
    links = F.transform(F.filter(part, lambda s: s["kind"] == "link"), lambda s: F.struct(s["text"].alias("text"), s["url"].alias("url")))
    once = _let(links, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: y["url"] == x["url"])))
    return F.struct(title.alias("title"), F.when(text.eqNullSafe(title), "").otherwise(text).alias("text"), once.alias("links"))


def _merge_short(blocks: Column) -> Column:
    """Blocks of few characters go into the one before them, whose title stays: an ordered fold."""

    def step(done: Column, b: Column) -> Column:
        short = F.char_length(F.trim(F.concat_ws("\n", b["title"], b["text"]))) < SHORT
        before = F.element_at(done, -1)
        said = F.array_join(F.filter(F.array(before["text"], b["title"], b["text"]), lambda s: s != ""), "\n")
        joined = F.struct(before["title"].alias("title"), said.alias("text"), F.concat(before["links"], b["links"]).alias("links"))
        return F.when(short & (F.size(done) > 0), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(blocks, F.slice(blocks, 1, 0), step)


def content_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, title, text, links) of each page's content in order; links are (text, url), each once in a block.

    A heading, or a short line in capitals or bold that stands for one, begins a block. Blocks without text take that of
    the gallery item with their title. A null page has none. The tree is read page by page; blocks are made by array
    functions of the same row.
    """
    read = page_segments(pages)
    resolved = F.transform("segments", lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.when(s["kind"] == "link", resolve_url(s["href"], F.col("url"))).alias("url")))
    kept = read.select("page_id", F.filter(resolved, lambda s: (s["kind"] != "link") | s["url"].isNotNull()).alias("s"), _gallery(F.col("html")).alias("g"))
    heads = F.filter(F.transform("s", lambda s, i: F.when(s["kind"] == "heading", i)), lambda i: i.isNotNull())
    starts = kept.select("page_id", "s", "g", F.array_distinct(F.concat(F.array(F.lit(0)), heads)).alias("a"))
    ends = F.concat(F.slice("a", 2, F.size("a")), F.array(F.size("s")))
    made = F.zip_with("a", ends, lambda a, b: F.slice(F.col("s"), a + 1, F.greatest(b - a, F.lit(0))))
    blocks = F.filter(F.transform(F.filter(made, lambda p: F.size(p) > 0), lambda p: _let(p, _block)), lambda b: b["title"].isNotNull() | (b["text"] != "") | (F.size(b["links"]) > 0))
    other = lambda b: F.get(F.filter(F.col("g"), lambda x: x["title"] == b["title"]), F.lit(0))["text"]
    filled = F.transform(blocks, lambda b: F.struct(b["title"].alias("title"), F.when(b["text"] == "", F.coalesce(other(b), F.lit(""))).otherwise(b["text"]).alias("text"), b["links"].alias("links")))
    return starts.select("page_id", F.posexplode(_let(filled, _merge_short)).alias("block", "b")).select("page_id", "block", "b.*")
