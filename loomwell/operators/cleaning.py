"""From texts to positioned lines, cleaned lines, regions and page audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import text as t

# Why a line is removed, in the order in which the rules are tried.
REASONS = ("running_header", "printed_page_number", "copyright")
HEADER_BOTTOM = 40.0


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, top: float = 20.0, pitch: float = 12.0, height: float = 10.0, split: str = "\n") -> DataFrame:
    """Lines of each text with their index and a regular geometry (line i at ``top + pitch * i``)."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(F.split(F.col(text), split, -1)).alias("line_index", "line"))
    y0 = F.lit(top) + F.lit(pitch) * F.col("line_index")
    return rows.withColumn("y0", y0).withColumn("y1", y0 + height)


def structural_reason(line: Column, y1: Column, *, is_last: Column, expected_label: Column, copyright_line: str | None, header_bottom: float = HEADER_BOTTOM) -> Column:
    """First rule that matches, or null for a line that stays."""
    rules = F.when(y1 <= header_bottom, REASONS[0]).when(is_last & (t.edge_trim(line) == expected_label), REASONS[1])
    return rules if copyright_line is None else rules.when(t.edge_trim(line).rlike(copyright_line), REASONS[2])


def zone(y0: Column, *, top: float, bottom: float) -> Column:
    return F.when(y0 < top, "top").when(y0 >= bottom, "bottom").otherwise("body")


def heading_class(heading: Column, page: Column, y0: Column, *, targets: list[str], contents_pages: tuple[int, int], header_bottom: float = HEADER_BOTTOM) -> Column:
    """contents, running_header or body for the exact headings in ``targets``; null for other lines."""
    return F.when(t.collapse(heading).isin(*targets), heading_place(page, y0, contents_pages=contents_pages, header_bottom=header_bottom))


def heading_place(page: Column, y0: Column, *, contents_pages: tuple[int, int], header_bottom: float = HEADER_BOTTOM) -> Column:
    """Where a heading stands: contents, running_header or body."""
    return F.when(page.between(*contents_pages), "contents").when(y0 < header_bottom, "running_header").otherwise("body")


def clip(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The boxes that lie within a rectangle, its edges included."""
    return boxes.filter((F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1))


def bookmarks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, level, title of the headings of HTML pages, as bookmarks of a document."""
    found = lambda group: F.regexp_extract_all(html, F.lit("<h([1-6])>([^<]*)"), F.lit(group))
    rows = pages.select(key, F.explode(F.arrays_zip(found(1).alias("level"), found(2).alias("title"))).alias("x"))
    return rows.select(key, F.col("x.level").cast("int").alias("level"), F.btrim("x.title").alias("title"))


def lookup_bookmarks(marks: DataFrame, wanted: DataFrame, length: int, key: str = "page_id") -> DataFrame:
    """prefix, key, entries, found: the one top-level bookmark that begins with each prefix of ``length`` characters; none or several are no hit."""
    tops = marks.filter("level = 1").groupBy(F.substring("title", 1, length).alias("prefix")).agg(F.count("*").alias("entries"), F.min(key).alias("_first"))
    rows = wanted.join(tops, "prefix", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    return rows.select("prefix", F.when(F.col("entries") == 1, F.col("_first")).alias(key), "entries", (F.col("entries") == 1).alias("found"))


def corpus_totals(lines: DataFrame, key: str) -> DataFrame:
    """One row of totals over classified lines: raw and kept lines, kept characters, pages with text and emptied pages, removals by reason."""
    kept = F.col("reason").isNull()
    page = lines.groupBy(key).agg(F.count("*").alias("raw"), F.count_if(kept).alias("cleaned"), F.sum(F.when(kept, F.char_length("line")).otherwise(0)).alias("characters"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    emptied = F.col("cleaned") == 0
    removed = F.lit(0)
    for r in REASONS:
        removed = removed + F.col(r)
    totals = page.agg(
        F.count("*").alias("pages"), F.sum("raw").alias("raw_lines"), F.sum("cleaned").alias("cleaned_lines"), F.sum("characters").alias("cleaned_characters"), F.count_if(~emptied).alias("pages_with_text"), F.count_if(emptied).alias("emptied_pages"),
        F.min(F.when(emptied, F.col(key))).alias("first_emptied"), *[F.sum(r).alias(r) for r in REASONS])
    return totals.withColumn("accounted", F.col("raw_lines") == F.col("cleaned_lines") + removed)


def zero_filled(counts: DataFrame, key: str, values, n: str = "n") -> DataFrame:
    """Counts of a closed set of values; those that are absent count 0."""
    spark = counts.sparkSession
    domain = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {key} string")
    return F.broadcast(domain).join(counts, key, "left").select("ord", key, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def regions(lines: DataFrame, key: str, *, keep: Column) -> DataFrame:
    """Consecutive kept lines of a key as one region each, joined by line feeds."""
    w = Window.partitionBy(key).orderBy("line_index")
    kept = lines.filter(keep).withColumn("_island", F.col("line_index") - F.row_number().over(w))
    grouped = kept.groupBy(key, "_island").agg(F.array_sort(F.collect_list(F.struct("line_index", "line"))).alias("ls"), F.count("*").alias("line_count"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    number = F.row_number().over(Window.partitionBy(key).orderBy("_island"))
    return grouped.select(key, number.alias("region_index"), "line_count", F.char_length(text).alias("character_count"), F.col("ls")[0]["line_index"].alias("first_line"), "y0", "y1", text.alias("text"))


def characters(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Inventory of the characters that match ``pattern``, by code point."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))).alias("c"))
    return found.groupBy(F.ascii("c").alias("code_point")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("texts"))


def html_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Lines of a page's visible text: scripts, styles and tags go, a few entities are resolved, blanks are dropped."""
    c = F.col(html)
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "\n")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    lines = F.filter(F.transform(F.split(c, "\n", -1), t.edge_trim), lambda x: x != "")
    return pages.select(key, F.posexplode(lines).alias("line_index", "line"))
