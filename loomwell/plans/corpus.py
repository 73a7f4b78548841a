"""Lines, regions, intervals and chunks from ``documents``, ``pages``, ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import text as t
from loomwell.operators import audit, chunking, cleaning, integrity, intervals, ordering, selection, staging
from loomwell.plans.catalog import query, table

LICENSE = r"(?i)^.*(copyright|licen[sc]e|all rights reserved).*$"
HEIGHT = 60.0

_LINES = """l AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents),
c AS (SELECT *, 20.0::DOUBLE + 12.0 * i AS y0, 30.0::DOUBLE + 12.0 * i AS y1,
CASE WHEN 30 + 12 * i <= 40 THEN 'running_header' WHEN i = n - 1 AND trim(line, ' ' || chr(9) || chr(13) || chr(10)) = (doc_id - 24)::VARCHAR THEN 'printed_page_number'
WHEN regexp_matches(trim(line, ' ' || chr(9) || chr(13) || chr(10)), '(?i)^.*(copyright|licen[sc]e|all rights reserved).*$') THEN 'copyright' END AS reason FROM l)"""


def classified(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = cleaning.explode_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1))), "doc_id")
    label = t.expected_page_label(F.col("doc_id"), 24)
    return lines.withColumn("reason", cleaning.structural_reason(F.col("line"), F.col("y1"), is_last=F.col("line_index") == F.col("n_lines") - 1, expected_label=label, copyright_line=LICENSE))


@query(f"WITH {_LINES} SELECT doc_id, i::INTEGER AS line_index, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS line FROM c WHERE reason IS NULL")
def line_cleaning(spark, sf_dir):
    return classified(spark, sf_dir).filter("reason IS NULL").select("doc_id", "line_index", t.edge_trim(F.col("line")).alias("line"))


@query(f"WITH {_LINES} SELECT r.ord::INTEGER AS ord, r.reason, count(c.reason) AS n FROM (VALUES (0, 'running_header'), (1, 'printed_page_number'), (2, 'copyright')) r(ord, reason) LEFT JOIN c ON c.reason = r.reason GROUP BY ALL")
def structural_removal_counts(spark, sf_dir):
    counts = classified(spark, sf_dir).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return cleaning.zero_filled(counts, "reason", cleaning.REASONS)


@query(f"WITH {_LINES} SELECT lang, CASE WHEN y0 < 40 THEN 'top' WHEN y0 >= 200 THEN 'bottom' ELSE 'body' END AS zone, count(*) AS n, sum(length(line))::BIGINT AS characters FROM c GROUP BY ALL")
def line_zone_counts(spark, sf_dir):
    rows = classified(spark, sf_dir).withColumn("zone", cleaning.zone(F.col("y0"), top=40.0, bottom=200.0))
    return rows.groupBy("lang", "zone").agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("characters"))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^A-Za-z0-9 ]')) AS ch FROM documents) SELECT ord(ch)::INTEGER AS code_point, count(*) AS n, count(DISTINCT doc_id) AS texts FROM c GROUP BY ALL""")
def control_char_inventory(spark, sf_dir):
    return cleaning.characters(table(spark, sf_dir, "documents"), "doc_id", "text", "[^A-Za-z0-9 ]")


@query("""SELECT source, sum(len(regexp_extract_all(text, chr(65533))))::BIGINT AS replacement_characters, sum(len(regexp_extract_all(text, '\\(cid:[0-9]+\\)')))::BIGINT AS cid_codes, sum(len(regexp_extract_all(text, '/H[0-9]+')))::BIGINT AS glyph_names,
sum(len(regexp_extract_all(text, '\\x0c')))::BIGINT AS form_feeds, sum(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{9f}]')))::BIGINT AS control_characters FROM documents GROUP BY source""")
def anomaly_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(*[F.sum(c).alias(n) for n, c in t.anomalies(F.col("text")).items()])


_HTML = """h AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS body FROM pages),
x AS (SELECT page_id, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10))), lambda s: s <> '') AS ls FROM h)"""


@query(f"WITH {_HTML} SELECT page_id, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_index, unnest(ls) AS line FROM x")
def html_line_extract(spark, sf_dir):
    return cleaning.html_lines(table(spark, sf_dir, "pages"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = (SELECT min(event_type) FROM events) AS o, event_type = (SELECT max(event_type) FROM events) AS c FROM events),
m AS (SELECT *, sum(o::INT) OVER w AS i, sum(c::INT) OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, i + max(k + 1 - i) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS take FROM m WHERE o)
SELECT p.user_id, p.event_id AS opening_id, q.event_id AS closing_id FROM p LEFT JOIN m q ON q.user_id = p.user_id AND q.c AND q.k = p.take""")
def heading_pairing(spark, sf_dir):
    """Events of the first kind of a user open, those of the last kind close."""
    events = table(spark, sf_dir, "events")
    ends = F.broadcast(events.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last")))
    rows = events.crossJoin(ends)  # one row
    rows = rows.withColumn("opens", F.col("event_type") == F.col("first")).withColumn("closes", F.col("event_type") == F.col("last"))
    got = intervals.pair_forward(rows, "user_id", ["ts", "event_id"], F.col("opens"), F.col("closes"))
    return got.select("user_id", F.col("event_id").alias("opening_id"), F.col("pair.event_id").alias("closing_id"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = (SELECT min(event_type) FROM events) AS o, event_type = (SELECT max(event_type) FROM events) AS c FROM events),
m AS (SELECT *, sum(o::INT) OVER w AS i, sum(c::INT) OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, i + max(k + 1 - i) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS take FROM m WHERE o)
SELECT q.user_id, q.event_id FROM m q WHERE q.c AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = q.user_id AND p.take = q.k)""")
def leftover_closings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = F.broadcast(events.agg(F.max("event_type").alias("last")))
    closes = events.join(last, F.col("event_type") == F.col("last")).select("user_id", "event_id")
    used = heading_pairing(spark, sf_dir).select("user_id", F.col("closing_id").alias("event_id"))
    return closes.join(used, ["user_id", "event_id"], "left_anti")


_IV = "v AS (SELECT l_orderkey AS page, l_quantity AS y0, l_quantity + l_discount * 100 AS y1 FROM lineitem WHERE l_discount > 0)"
_ISLANDS = _IV + """,
m AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT page, island, min(y0) AS y0, max(y1) AS y1, count(*) AS merged FROM i GROUP BY ALL)"""
_GAPS = _ISLANDS + """,
c AS (SELECT page, greatest(y0, 0) AS y0, least(y1, 60) AS y1 FROM g WHERE least(y1, 60) > greatest(y0, 0)),
o AS (SELECT page, coalesce(lag(y1) OVER w, 0) AS a, y0 AS b FROM c WINDOW w AS (PARTITION BY page ORDER BY y0) UNION ALL SELECT page, max(y1), 60 FROM c GROUP BY page),
r AS (SELECT page, a::DOUBLE AS y0, b::DOUBLE AS y1 FROM o WHERE b - a > 1e-6)"""


def spans(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_discount > 0")
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("y1"))


def islands(spark, sf_dir) -> DataFrame:
    return intervals.merge(spans(spark, sf_dir), "page", "y0", "y1")


@query(f"WITH {_ISLANDS} SELECT page, island::BIGINT AS island, round(y0, 6) AS y0, round(y1, 6) AS y1, merged FROM g")
def interval_merge(spark, sf_dir):
    return islands(spark, sf_dir).select("page", "island", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"), "merged")


@query(f"WITH {_GAPS} SELECT page, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM r")
def interval_complement(spark, sf_dir):
    got = intervals.complement(islands(spark, sf_dir), "page", "y0", "y1", HEIGHT)
    return got.select("page", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(f"""WITH {_ISLANDS}, s AS (SELECT page, sum(least(y1, 60) - greatest(y0, 0)) AS covered FROM g WHERE least(y1, 60) > greatest(y0, 0) GROUP BY page),
p AS (SELECT o.o_orderkey, CASE WHEN coalesce(covered, 0) <= 1e-6 THEN 'fully_retained' WHEN covered >= 60 - 1e-6 THEN 'fully_excluded' ELSE 'partially_retained' END AS state FROM orders o LEFT JOIN s ON s.page = o.o_orderkey)
SELECT d.ord::INTEGER AS ord, d.state, count(p.state) AS n FROM (VALUES (0, 'fully_retained'), (1, 'partially_retained'), (2, 'fully_excluded')) d(ord, state) LEFT JOIN p USING (state) GROUP BY ALL""")
def page_state(spark, sf_dir):
    height = F.least("y1", F.lit(HEIGHT)) - F.greatest("y0", F.lit(0.0))
    covered = islands(spark, sf_dir).withColumn("h", height).filter("h > 0").groupBy("page").agg(F.sum("h").alias("covered"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).join(covered, "page", "left")
    counts = pages.groupBy(intervals.page_state(F.col("covered"), HEIGHT).alias("state")).agg(F.count("*").alias("n"))
    return cleaning.zero_filled(counts, "state", ["fully_retained", "partially_retained", "fully_excluded"])


@query(f"""WITH {_ISLANDS}, s AS (SELECT page, sum(least(y1, 60) - greatest(y0, 0)) AS covered FROM g WHERE least(y1, 60) > greatest(y0, 0) GROUP BY page)
SELECT count(*) AS pages, round(sum(coalesce(covered, 0)) / 60, 6) AS page_equivalents, round(100 * sum(coalesce(covered, 0)) / (60.0 * count(*)), 6) AS excluded_percent FROM orders o LEFT JOIN s ON s.page = o.o_orderkey""")
def excluded_area(spark, sf_dir):
    height = F.least("y1", F.lit(HEIGHT)) - F.greatest("y0", F.lit(0.0))
    covered = islands(spark, sf_dir).withColumn("h", height).filter("h > 0").groupBy("page").agg(F.sum("h").alias("covered"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).join(covered, "page", "left")
    total = F.sum(F.coalesce("covered", F.lit(0.0)))
    return pages.agg(F.count("*").alias("pages"), F.round(total / HEIGHT, 6).alias("page_equivalents"), F.round(100 * total / (HEIGHT * F.count("*")), 6).alias("excluded_percent"))


@query(f"""WITH {_GAPS} SELECT l.l_orderkey AS page, l.l_linenumber AS line_number FROM lineitem l JOIN r ON r.page = l.l_orderkey AND l.l_quantity >= r.y0 - 1e-6 AND l.l_quantity + 1 <= r.y1 + 1e-6""")
def lines_in_retained(spark, sf_dir):
    """Lines of height 1 at their quantity that lie within what is retained of their page."""
    kept = intervals.complement(islands(spark, sf_dir), "page", "y0", "y1", HEIGHT)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_number"), F.col("l_quantity").alias("q"))
    # Where a line begins, in whole units, is where one of what may hold it goes.
    kept = kept.withColumn("low", F.floor(F.col("y0") - intervals.TOLERANCE)).withColumn("high", F.floor(F.col("y1") + intervals.TOLERANCE))
    met = intervals.covering(lines.withColumn("at", F.floor("q")), kept, ["page"], "at", "low", "high")
    return met.filter(intervals.within(F.col("q"), F.col("q") + 1, F.col("y0"), F.col("y1"))).select("page", "line_number")


@query("""WITH s AS (SELECT l_orderkey AS first, l_orderkey + l_partkey % 500 AS last, l_quantity AS y0, l_tax * 100 + 1 AS y1 FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 48),
p AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey = first THEN y0 ELSE 0 END AS a, CASE WHEN o_orderkey = last THEN y1 ELSE 60 END AS b FROM orders JOIN s ON o_orderkey BETWEEN first AND last)
SELECT page, count(*) AS sections, round(min(a), 6)::DOUBLE AS page_y0, round(max(b), 6)::DOUBLE AS page_y1 FROM p GROUP BY page""")
def page_exclusions(spark, sf_dir):
    """Pages with the sections that cover them, of up to 500 pages each, joined by blocks of pages."""
    s = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_quantity >= 48")
    s = s.select(F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + F.col("l_partkey") % 500).alias("last"), F.col("l_quantity").alias("y0"), (F.col("l_tax") * 100 + 1).alias("y1"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    met = intervals.excluded(pages, s, page="page", first="first", last="last", y0="y0", y1="y1", top=0.0, bottom=HEIGHT)
    return met.groupBy("page").agg(F.count("*").alias("sections"), F.round(F.min("page_y0"), 6).alias("page_y0"), F.round(F.max("page_y1"), 6).alias("page_y1"))


@query("""WITH s AS (SELECT l_orderkey AS section, l_linenumber AS part, l_linenumber AS first, l_linenumber + (l_suppkey % 4)::INTEGER AS last, l_quantity AS y0, l_tax * 100 + 1 AS y1 FROM lineitem),
p AS (SELECT *, unnest(range(first, last + 1))::INTEGER AS page FROM s)
SELECT section, part, page, round(CASE WHEN page = first THEN y0 ELSE 0 END, 6)::DOUBLE AS page_y0, round(CASE WHEN page = last THEN y1 ELSE 60 END, 6)::DOUBLE AS page_y1 FROM p""")
def section_pages(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("part"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + (F.col("l_suppkey") % 4).cast("int")).alias("last"), F.col("l_quantity").alias("y0"), (F.col("l_tax") * 100 + 1).alias("y1"))
    got = intervals.over_pages(s, first="first", last="last", y0="y0", y1="y1", top=0.0, bottom=HEIGHT)
    return got.select("section", "part", "page", F.round("page_y0", 6).alias("page_y0"), F.round("page_y1", 6).alias("page_y1"))


_REGIONS = _LINES + """,
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c WHERE reason IS NULL),
r AS (SELECT doc_id, g, count(*) AS line_count, min(i)::INTEGER AS first_line, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY doc_id, g),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INTEGER AS region_index FROM r)"""


def regions(spark, sf_dir) -> DataFrame:
    return cleaning.regions(classified(spark, sf_dir), "doc_id", keep=F.col("reason").isNull())


@query(f"WITH {_REGIONS} SELECT format('doc:pdf-{{:04d}}:region-{{:02d}}', doc_id, region_index) AS record_id, doc_id, region_index, line_count, first_line, length(text)::INTEGER AS character_count, sha256(text) AS text_sha256 FROM n")
def region_records(spark, sf_dir):
    name = F.format_string("doc:pdf-%04d:region-%02d", "doc_id", "region_index")
    return regions(spark, sf_dir).select(name.alias("record_id"), "doc_id", "region_index", "line_count", "first_line", "character_count", t.fingerprint(F.col("text")).alias("text_sha256"))


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS raw_lines, count(*) FILTER (reason IS NULL) AS cleaned_lines, count(reason) AS removed_lines, sum(length(line))::BIGINT AS raw_characters, coalesce(sum(length(line)) FILTER (reason IS NULL), 0)::BIGINT AS cleaned_characters,
count(*) = count(*) FILTER (reason IS NULL) + count(reason) AS accounted FROM c GROUP BY doc_id""")
def page_audit(spark, sf_dir):
    kept = F.col("reason").isNull()
    got = classified(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("raw_lines"), F.count_if(kept).alias("cleaned_lines"), F.count("reason").alias("removed_lines"), F.sum(F.char_length("line")).alias("raw_characters"), F.sum(F.when(kept, F.char_length("line")).otherwise(0)).alias("cleaned_characters"))
    return got.withColumn("accounted", F.col("raw_lines") == F.col("cleaned_lines") + F.col("removed_lines"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, count(*) AS raw, count(*) FILTER (reason IS NULL) AS cleaned, coalesce(sum(length(line)) FILTER (reason IS NULL), 0) AS characters, count(*) FILTER (reason = 'running_header') AS headers, count(*) FILTER (reason = 'printed_page_number') AS numbers, count(*) FILTER (reason = 'copyright') AS copyrights FROM c GROUP BY doc_id)
SELECT count(*) AS pages, sum(raw)::BIGINT AS raw_lines, sum(cleaned)::BIGINT AS cleaned_lines, sum(characters)::BIGINT AS cleaned_characters, count(*) FILTER (cleaned > 0) AS pages_with_text, count(*) FILTER (raw > 0 AND cleaned = 0) AS emptied_pages, min(doc_id) FILTER (raw > 0 AND cleaned = 0) AS first_emptied,
sum(headers)::BIGINT AS running_header, sum(numbers)::BIGINT AS printed_page_number, sum(copyrights)::BIGINT AS copyright, sum(raw) = sum(cleaned) + sum(headers) + sum(numbers) + sum(copyrights) AS accounted FROM p""")
def corpus_totals(spark, sf_dir):
    """Totals of the whole corpus before and after cleaning, and the pages that cleaning has emptied."""
    return cleaning.corpus_totals(classified(spark, sf_dir), "doc_id")


@query(f"""WITH {_LINES}, t AS (SELECT DISTINCT regexp_replace(trim(string_split(text, chr(10))[1]), '\\s+', ' ', 'g') AS heading FROM documents SEMI JOIN labels USING (doc_id)),
k AS (SELECT regexp_replace(trim(line), '\\s+', ' ', 'g') AS heading, CASE WHEN doc_id BETWEEN 0 AND 9 THEN 'contents' WHEN y0 < 40 THEN 'running_header' ELSE 'body' END AS class FROM c),
n AS (SELECT heading, class, count(*) AS n FROM k JOIN t USING (heading) WHERE heading <> '' GROUP BY ALL), e AS (SELECT heading, 'running_header' AS class, count(*) AS expected FROM k JOIN t USING (heading) WHERE heading <> '' GROUP BY ALL)
SELECT sha256(heading) AS heading_sha256, class, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS agrees FROM n FULL JOIN e USING (heading, class)""")
def heading_counts(spark, sf_dir):
    """First lines of labelled documents wherever they stand, by class, beside the expectation that all stand at the top."""
    docs = table(spark, sf_dir, "documents")
    clean = lambda c: F.regexp_replace(F.btrim(c), r"\s+", " ")
    targets = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(clean(F.split("text", "\n", -1)[0]).alias("heading")).distinct()
    lines = classified(spark, sf_dir).withColumn("heading", clean(F.col("line"))).filter("heading <> ''").join(targets, "heading", "left_semi")
    lines = lines.select("heading", cleaning.heading_place(F.col("doc_id"), F.col("y0"), contents_pages=(0, 9)).alias("class"))
    counts = lines.groupBy("heading", "class").agg(F.count("*").alias("n"))
    expected = lines.groupBy("heading").agg(F.count("*").alias("n")).withColumn("class", F.lit("running_header"))
    return integrity.compare_counts(counts, expected, ["heading", "class"]).select(t.fingerprint(F.col("heading")).alias("heading_sha256"), "class", "n", "expected", "agrees")


@query("""WITH d AS (SELECT l_orderkey AS page, l_quantity AS y0, l_linenumber AS x0, row_number() OVER (ORDER BY l_orderkey, l_quantity, l_linenumber) - 1 AS place FROM lineitem) SELECT page, min(place) AS first, max(place) AS last, count(*) AS lines, max(place) - min(place) + 1 = count(*) AS together FROM d GROUP BY page""")
def document_order(spark, sf_dir):
    """Boxes numbered in reading order: by page, from top to bottom, from left to right."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y0"), F.col("l_linenumber").alias("x0"))
    placed = ordering.with_position(rows, [F.col(c) for c in ("page", "y0", "x0")], "place")
    return placed.groupBy("page").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("lines"), (F.max("place") - F.min("place") + 1 == F.count("*")).alias("together"))


@query("""SELECT l_orderkey AS page, l_linenumber AS line_number FROM lineitem WHERE l_quantity >= 10 AND l_quantity + 1 <= 30 AND l_discount * 100 >= 2 AND l_discount * 100 + l_tax * 100 <= 12""")
def clipped_lines(spark, sf_dir):
    """Boxes that lie within a rectangle of their page."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_number"), (F.col("l_discount") * 100).alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_discount") * 100 + F.col("l_tax") * 100).alias("x1"), (F.col("l_quantity") + 1).alias("y1"))
    return cleaning.clip(rows, 2.0, 10.0, 12.0, 30.0).select("page", "line_number")


@query("""WITH b AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])>([^<]*)', 1) AS levels, regexp_extract_all(html, '<h([1-6])>([^<]*)', 2) AS titles FROM pages), u AS (SELECT page_id, unnest(levels)::INTEGER AS level, trim(unnest(titles)) AS title FROM b),
k AS (SELECT substr(title, 1, 12) AS prefix, count(*) AS n, min(page_id) AS page_id FROM u WHERE level = 1 GROUP BY 1) SELECT prefix, CASE WHEN n = 1 THEN page_id END AS page_id, n AS entries, n = 1 AS found FROM k""")
def bookmark_lookup(spark, sf_dir):
    """Top-level headings of the pages as bookmarks, looked up by the beginnings of their titles: only a single entry is a hit."""
    marks = cleaning.bookmarks(table(spark, sf_dir, "pages"))
    wanted = marks.filter("level = 1").select(F.substring("title", 1, 12).alias("prefix")).distinct()
    return cleaning.lookup_bookmarks(marks, wanted, 12)


@query("SELECT count(*) AS texts, count(*) FILTER (array_to_string(string_split(text, chr(10)), chr(10)) IS DISTINCT FROM text) AS different FROM documents")
def line_reconstruction(spark, sf_dir):
    """Lines joined again have to be the text they came from."""
    lines = cleaning.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    again = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), "\n").alias("again"))
    both = table(spark, sf_dir, "documents").select("doc_id", "text").join(again, "doc_id", "full")
    return both.agg(F.count("*").alias("texts"), F.count_if(~F.col("text").eqNullSafe(F.col("again"))).alias("different"))


def _chunks_sql(atoms: str, joiner: str, where: str = "true") -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {atoms} AS ps FROM documents WHERE {where}),
a AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p FROM d),
o AS (SELECT doc_id, i, length(p) AS n, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(p) - 1 AS c FROM a),
q AS (SELECT *, c + n AS z FROM o),
b AS (SELECT s.doc_id, s.i, s.c, coalesce(min(t.i), max(u.m) + 1) AS stop FROM q s JOIN (SELECT doc_id, max(i) AS m FROM q GROUP BY doc_id) u ON u.doc_id = s.doc_id LEFT JOIN q t ON t.doc_id = s.doc_id AND t.i > s.i AND t.i <= s.i + 101 AND t.z - s.c > 200 GROUP BY s.doc_id, s.i, s.c),
x AS (SELECT b.doc_id, b.i, b.stop, q.z - b.c AS len, b.c AS c0, q.z AS z0, nx.z AS nz, nx.i AS ni FROM b JOIN q ON q.doc_id = b.doc_id AND q.i = b.stop - 1 LEFT JOIN q nx ON nx.doc_id = b.doc_id AND nx.i = b.stop),
y AS (SELECT x.doc_id, x.i, min(w.i) AS again FROM x JOIN q w ON w.doc_id = x.doc_id AND w.i >= x.i AND w.i < x.stop AND w.i >= x.stop - 12 AND x.z0 - w.c <= 10 AND x.nz - w.c <= 200 GROUP BY ALL),
f AS (SELECT x.doc_id, x.i, x.stop, x.len, x.c0, x.ni, CASE WHEN x.ni IS NULL THEN NULL ELSE coalesce(y.again, x.stop) END AS nxt FROM x LEFT JOIN y ON y.doc_id = x.doc_id AND y.i = x.i),
r AS (SELECT doc_id, 0 AS k, i, stop, len, c0, nxt FROM f WHERE i = 0 UNION ALL SELECT f.doc_id, r.k + 1, f.i, f.stop, f.len, f.c0, f.nxt FROM r JOIN f ON f.doc_id = r.doc_id AND f.i = r.nxt),
t AS (SELECT r.doc_id, r.k::INTEGER AS chunk_index, r.i::INTEGER AS first_atom, r.stop::INTEGER AS end_atom, r.c0::BIGINT AS start, (r.c0 + r.len)::BIGINT AS "end", r.len > 200 AS oversize, array_to_string(d.ps[r.i + 1:r.stop], {joiner}) AS chunk FROM r JOIN d ON d.doc_id = r.doc_id)"""


_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')"
_STRICT = "NOT list_bool_or(list_transform(string_split(text, chr(10)), lambda s: length(s) > 200))"


def strict_docs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(~F.exists(F.split("text", "\n", -1), lambda x: F.char_length(x) > 200))


def word_chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), size=200, overlap=10, atoms="words")


_DIGEST = 'SELECT doc_id, chunk_index, first_atom, end_atom, start, "end", oversize, sha256(chunk) AS chunk_sha256 FROM t'


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_sha256", t.fingerprint(F.col("chunk"))).drop("chunk")


@query(_chunks_sql("string_split(text, chr(10))", "chr(10)", _STRICT) + _DIGEST)
def chunk_strict(spark, sf_dir):
    return _digest(chunking.chunk(strict_docs(spark, sf_dir), size=200, overlap=10, atoms="lines"))


@query(_chunks_sql(_WORDS, "' '") + _DIGEST)
def chunk_words(spark, sf_dir):
    return _digest(word_chunks(spark, sf_dir))


@query("SELECT doc_id, n_long AS lines_too_long, longest::INTEGER AS longest FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 200)) AS n_long, list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS longest FROM documents) WHERE n_long > 0")
def chunk_quarantine(spark, sf_dir):
    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.char_length(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", lengths.alias("ls"))
    return rows.select("doc_id", F.size(F.filter("ls", lambda n: n > 200)).cast("long").alias("lines_too_long"), F.array_max("ls").alias("longest")).filter("lines_too_long > 0")


_CHECKED = _chunks_sql(_WORDS, "' '") + """, v AS (SELECT *, lag(start) OVER w AS s, lag("end") OVER w AS e, lag(chunk_index) OVER w AS i0, lag(end_atom) OVER w AS a0 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
bad AS (SELECT doc_id, unnest([CASE WHEN i0 IS NULL AND start <> 0 THEN 'first_not_at_zero' END, CASE WHEN chunk_index <> coalesce(i0 + 1, 0) THEN 'index_not_consecutive' END, CASE WHEN start <= s THEN 'start_not_increasing' END, CASE WHEN start - e > 1 THEN 'gap' END, CASE WHEN first_atom > a0 THEN 'atom_not_covered' END,
CASE WHEN e - start > {overlap} THEN 'overlap_too_long' END, CASE WHEN "end" - start <> length(chunk) THEN 'length_differs' END]) AS violation FROM v)
SELECT (SELECT count(*) FROM t) AS chunks, k.violation, count(bad.violation) AS n FROM (SELECT unnest(['first_not_at_zero', 'index_not_consecutive', 'start_not_increasing', 'gap', 'atom_not_covered', 'overlap_too_long', 'length_differs']) AS violation) k LEFT JOIN bad USING (violation) GROUP BY k.violation"""


def _checked(spark, sf_dir, overlap: int) -> DataFrame:
    chunks = staging.settle(word_chunks(spark, sf_dir), "chunks")
    found = chunking.violations(chunks, overlap=overlap).groupBy("violation").agg(F.count("*").alias("n"))
    total = chunks.agg(F.count("*").alias("chunks"))
    return cleaning.zero_filled(found, "violation", chunking.RULES).drop("ord").crossJoin(F.broadcast(total))  # one row


@query(_CHECKED.format(overlap=10))
def chunk_invariants(spark, sf_dir):
    """How often chunks break each invariant of their sequence."""
    return _checked(spark, sf_dir, 10)


@query(_CHECKED.format(overlap=4))
def chunk_invariants_strict(spark, sf_dir):
    """The same held to a shorter overlap than the chunks were made with, so that there are breaches to find."""
    return _checked(spark, sf_dir, 4)


@query(_chunks_sql(_WORDS, "' '") + """, g AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)
SELECT (SELECT count(*) FROM t) AS chunks, (SELECT sum(n - 1)::BIGINT FROM g) AS adjacent_pairs, (SELECT max("end" - start) FROM t) AS longest, (SELECT sum("end" - start)::BIGINT FROM t) AS characters, (SELECT count(*) FROM t WHERE regexp_matches(chunk, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS with_controls, max(n) AS most_in_a_parent, count(*) FILTER (n = 1) AS single_chunk_parents FROM g""")
def chunk_audit(spark, sf_dir):
    chunks = word_chunks(spark, sf_dir)
    one = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("m"), F.sum(F.col("end") - F.col("start")).alias("c"), F.count_if(t.has_control(F.col("chunk"))).alias("k"))
    return one.agg(F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("adjacent_pairs"), F.max("m").alias("longest"), F.sum("c").alias("characters"), F.sum("k").alias("with_controls"), F.max("n").alias("most_in_a_parent"), F.count_if(F.col("n") == 1).alias("single_chunk_parents"))


@query("""WITH w AS (SELECT len(regexp_extract_all(text, '\\S+')) AS n, text FROM documents) SELECT count(*) AS texts, min(n) AS least, median(n) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS most, sum(n)::BIGINT AS total,
count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (n > 2000) AS over_limit FROM w""")
def token_audit(spark, sf_dir):
    rows = staging.settle(table(spark, sf_dir, "documents").select(t.word_count(F.col("text")).cast("long").alias("n"), t.fingerprint(F.col("text")).alias("h")), "word-counts")
    ranks = selection.order_statistics(rows, [], {"median": ("n", "median"), "p95": ("n", 0.95)})
    totals = rows.agg(F.count("*").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"), (F.count("*") - F.count_distinct("h")).alias("duplicates"), F.count_if(F.col("n") > 2000).alias("over_limit"))
    return totals.crossJoin(F.broadcast(ranks)).withColumn("p95", F.col("p95").cast("long"))  # one row beside one row


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT (position // 256)::BIGINT AS batch_index, min(position) AS first, max(position) + 1 AS "end", count(*) AS n, sum(n)::BIGINT AS tokens FROM p GROUP BY 1""")
def batch_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("tokens"))
    at = ordering.with_position(rows, [F.col("doc_id")])
    return at.groupBy(F.floor(F.col("position") / 256).alias("batch_index")).agg(F.min("position").alias("first"), (F.max("position") + 1).alias("end"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(t.fingerprint(F.col("text")).alias("text_sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).filter("n > 1")


@query("SELECT row_number() OVER (ORDER BY n DESC, doc_id)::INTEGER AS place, doc_id, n AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) ORDER BY n DESC, doc_id LIMIT 10")
def longest_texts(spark, sf_dir):
    """The ten texts with most tokens: the limit is the report."""
    top = table(spark, sf_dir, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(10)
    return audit.numbered(top, [F.desc("tokens"), F.col("doc_id")], "place")
