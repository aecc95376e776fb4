"""Lines that come again on most pages of a document (headers, footers, menus), and texts without them.

Lines are rows with their place. Pages are counted by document and line form, after each task has counted its own; the
forms that come too often take their rows away by an anti join, and texts are put together again from rows that Spark
has sorted by document, page and place: a row for each page leaves as soon as the next one begins, so no page's lines are
gathered by a shuffle into one array and no document is one group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, fold, squeeze
from ..session import ship_package

#: Fixed: pages that a document must have, the share of them that a line must be on, and its length.
LEAST_PAGES, SHARE, SHORTEST, LONGEST = 3, 0.60, 3, 120


def line_form(line: Column) -> Column:
    """What lines are compared by: folded letters and digits."""
    return squeeze(F.regexp_replace(fold(line), "[^a-z0-9]+", " "))


def lines(pages: DataFrame) -> DataFrame:
    """document, page, place, line, form of every line. pages: document, page, text."""
    # Line ends are those of text files: a last, empty line is none.
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?:\r\n?|\n)$", ""), "\r\n|\r|\n")
    rows = pages.select("document", "page", F.posexplode(cut).alias("place", "line"))
    return rows.withColumn("form", line_form(F.col("line")))


def repeated(pages: DataFrame) -> DataFrame:
    """document, form, pages, of: lines on at least 60 % of a document's pages, and on three."""
    n = pages.groupBy("document").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") >= LEAST_PAGES)
    counts = lines(pages).filter(F.length("form").between(SHORTEST, LONGEST) & ~F.col("form").rlike("^[0-9]{1,4}$"))
    # A page counts once: distinct rows first, in each task.
    on = counts.select("document", "page", "form").distinct().groupBy("document", "form").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("of") * SHARE).cast("int"))
    return on.join(n, "document").filter(F.col("pages") >= enough)


def _joined(rows: DataFrame) -> DataFrame:
    """document, page, text from lines sorted by document, page and place."""
    ship_package(rows.sparkSession)
    schema = "document {}, page {}, text string".format(*(dict(rows.dtypes)[c] for c in ("document", "page")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            done: list[tuple] = []
            for document, page, line in zip(*(batch[c].to_pylist() for c in ("document", "page", "line")), strict=True):
                if (document, page) != key:
                    if key is not None:
                        done.append((*key, "\n".join(held)))
                    key, held = (document, page), []
                if line is not None:
                    held.append(line)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], batch.schema.field(c).type if i < 2 else pa.string()) for i, c in enumerate(("document", "page", "text"))], ["document", "page", "text"])
        if key is not None:
            last = [*key, "\n".join(held)]
            yield pa.RecordBatch.from_arrays([pa.array([v], batch.schema.field(c).type if i < 2 else pa.string()) for i, (c, v) in enumerate(zip(("document", "page", "text"), last, strict=True))], ["document", "page", "text"])

    return rows.select("document", "page", "line").mapInArrow(run, schema)


def without_repeated(pages: DataFrame) -> DataFrame:
    """document, page, text: texts without the lines that come again, cleaned where the document has pages enough. Pages
    must differ within a document."""
    rows = lines(pages)
    often = repeated(pages).select("document", "form")
    left = rows.join(often, ["document", "form"], "left_anti").select("document", "page", "place", "line")
    # A page whose lines all go stays, as an empty text.
    every = pages.select("document", "page", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("line"))
    # By page, so that a document of many pages is split over tasks.
    ordered = left.unionByName(every).repartition("document", "page").sortWithinPartitions("document", "page", "place")
    n = pages.groupBy("document").agg(F.count(F.lit(1)).alias("of"))
    whole = _joined(ordered).join(n, "document")
    return whole.select("document", "page", F.when(F.col("of") >= LEAST_PAGES, clean_text(F.col("text"))).otherwise(F.col("text")).alias("text"))
