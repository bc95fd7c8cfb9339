"""What can be told of a PDF once its lines are rows: headings by size, and OCR text merged by page.

Lines come from a reader that is plugged in: ``doc_id, page, pos, size, text, in_margin``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def body_sizes(lines: DataFrame) -> DataFrame:
    """``doc_id, body``: the size that most characters are set in."""
    weight = lines.where("size > 0").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return weight.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("body"))


def heading_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, page, size, text`` of lines set as headings.

    At least 1.15 times the body's size, not in a margin, not on three of ten pages (two
    at least), and shaped like a heading: up to 12 words and 90 characters, mostly letters.
    """
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("pages"))
    seen = lines.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("seen"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    shaped = (
        F.length("text").between(1, 90)
        & F.size(F.split(F.trim("text"), r"\s+")).between(1, 12)
        & ~F.col("text").rlike("[.,;]$")
        & (letters >= 4)
        & (letters >= 0.45 * F.length("text"))
    )
    rows = lines.join(body_sizes(lines), "doc_id").join(pages, "doc_id").join(seen, ["doc_id", "text"])
    repeated = F.greatest(F.lit(2), F.floor(F.col("pages") * 0.3))
    return rows.where(~F.col("in_margin") & (F.col("size") >= F.col("body") * 1.15) & (F.col("seen") < repeated) & shaped).select(
        "doc_id", "page", "size", "text"
    ).distinct()


def page_headings(lines: DataFrame) -> DataFrame:
    """``doc_id, page, heading``: the path of sections that a page is in; pages before the first have no row.

    Headings are few, so a document's are one group; a larger size closes smaller ones.
    """
    last = lines.groupBy("doc_id").agg(F.max("page").alias("pages"))

    def path(frame: pd.DataFrame) -> pd.DataFrame:
        open_: list[tuple[float, str]] = []
        out = []
        by_page = {p: g.sort_values(["size", "text"], ascending=[False, True]) for p, g in frame.groupby("page")}
        for page in range(1, int(frame["pages"].iloc[0]) + 1):
            for size, text in by_page[page][["size", "text"]].itertuples(index=False) if page in by_page else ():
                open_ = [(s, t) for s, t in open_ if s > size] + [(size, text)]
            if open_:
                out.append((frame["doc_id"].iloc[0], page, " > ".join(t for _, t in open_)))
        return pd.DataFrame(out, columns=["doc_id", "page", "heading"])

    return heading_lines(lines).join(last, "doc_id").groupBy("doc_id").applyInPandas(path, "doc_id long, page int, heading string")


def merged_pages(typed: DataFrame, scanned: DataFrame) -> DataFrame:
    """``doc_id, page, text, origin``: OCR text where there is some, else the text layer's."""
    a = typed.select("doc_id", "page", F.col("text").alias("typed"))
    b = scanned.select("doc_id", "page", F.col("text").alias("ocr"))
    both = a.join(b, ["doc_id", "page"], "full_outer")
    return both.select(
        "doc_id", "page", F.coalesce("ocr", "typed").alias("text"), F.when(F.col("ocr").isNotNull(), "ocr").otherwise("text").alias("origin")
    )


def pages_phrase(pages: str):
    """``1, 2 and 7`` of an array column."""
    p = F.transform(F.col(pages), lambda n: n.cast("string"))
    return F.when(F.size(p) <= 1, F.array_join(p, "")).otherwise(
        F.concat(F.array_join(F.slice(p, 1, F.size(p) - 1), ", "), F.lit(" and "), F.element_at(p, -1))
    )
