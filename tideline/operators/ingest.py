"""Parsing of release pages and incremental, content-addressed ingestion."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tideline.functions.releases import title_month_window

ROWS = "source_url string, position int, category string, product_name string, unit string, price double, change double, change_pct double"
NUMBER = re.compile(r"^[+-]?\d+(?:\.\d+)?$")
# The marks of the publisher's challenge page, the table's header words, and how a category begins.
CHALLENGE_MARKS = ("Please enable JavaScript and refresh the page", "请开启JavaScript并刷新该页")
HEADER = (("产品名称", "本期价格", "涨跌幅"), ("product", "price", "%"))
CATEGORY = re.compile(r"^(?:[一二三四五六七八九十]+、|[IVX]+\. )")
TITLE_ROW = ("产品名称", "序号", "product")
UP, DOWN, FLAT = ("上涨", "rose", "increased", "up"), ("下降", "fell", "decreased", "down"), ("持平", "flat", "unchanged")


class Tables(HTMLParser):
    """Tables of a page as lists of rows of cell texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(" ".join("".join(self.cell).replace("\xa0", " ").split()))
        self.cell = None


def price_rows(html: str | None) -> list[tuple]:
    """(position, category, product, unit, price, change, change_pct) of the first table that has all the header words.

    A row that begins with an ordinal is a category and is carried down; a row counts if its price, change and per cent
    are all numbers. Fewer cells, title rows and rows with a dash are skipped.
    """
    reader = Tables()
    reader.feed(html or "")
    reader.close_cell()
    for table in reader.tables:
        words = " ".join(c for row in table for c in row).lower()
        if any(all(w in words for w in header) for header in HEADER):
            found, category = [], ""
            for k, row in enumerate(table):
                if row and CATEGORY.match(row[0]):
                    category = row[0]
                elif len(row) >= 5 and row[0].lower() not in TITLE_ROW and all(NUMBER.match(c) for c in row[2:5]):
                    found.append((k, category, row[0], row[1], *map(float, row[2:5])))
            return found
    return []


def extract_prices(pages: DataFrame) -> DataFrame:
    """Rows of the price tables of (source_url, html) pages; parsing is the only Python step, on Arrow batches.

    A page without such a table, or with no numeric row, gives one row with a null position, so that it can be counted.
    """

    def parse(frames):
        for frame in frames:
            rows = [(url, *r) for url, html in zip(frame["source_url"], frame["html"]) for r in price_rows(html) or [(None,) * 7]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"position": "Int32", "price": float, "change": float, "change_pct": float})

    return pages.select("source_url", "html").mapInPandas(parse, ROWS)


def is_challenge(html: Column) -> Column:
    """Whether a page is an anti-bot challenge, not a release."""
    hit = F.lit(False)
    for mark in CHALLENGE_MARKS:
        hit = hit | F.contains(html, F.lit(mark))
    return F.coalesce(hit, F.lit(False))


def headline_change(text: Column) -> Column:
    """Signed month-on-month rate of a headline: direction times magnitude; of "flat" and a direction the first counts."""
    directions = "|".join((*UP, *DOWN))
    pattern = rf"(?i)(?:month[- ]on[- ]month|环比)\D{{0,20}}?({directions}|{'|'.join(FLAT)})(?:\D{{0,8}}(\d+(?:\.\d+)?))?"
    word = F.lower(F.regexp_extract(text, pattern, 1))
    size = F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("999.99")).cast("double")
    return F.when(word.isin(*FLAT), F.lit(0.0)).when(word.isin(*UP), size).when(word.isin(*DOWN), -size)


def published_at(text: Column) -> Column:
    """Publication time stamped on a page, as UTC of +08:00."""
    stamp = F.regexp_extract(text, r"(\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2})", 1)
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(stamp, "/", "-"), F.lit("yyyy-MM-dd HH:mm")), "Asia/Shanghai")


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", n)))


def normalised_names(names: DataFrame) -> DataFrame:
    """(name, normalised) of the distinct names: NFKC, without white space. Join back; the UDF sees each name once."""
    return names.select("name").distinct().withColumn("normalised", _nfkc("name"))


def discovered_links(pages: DataFrame) -> DataFrame:
    """Distinct links of index pages with kind and month, read from their titles (the anchor's text)."""
    anchors = pages.select(F.explode(F.expr(r"""regexp_extract_all(html, '<a[^>]*href="[^"]+"[^>]*>[^<]*', 0)""")).alias("a"))
    links = anchors.select(F.regexp_extract("a", 'href="([^"]+)"', 1).alias("url"), F.trim(F.regexp_extract("a", ">([^<]*)$", 1)).alias("title")).groupBy("url").agg(F.min("title").alias("title"))
    month, window = title_month_window(F.col("title"))
    kind = F.when(window.isNotNull() & month.isNotNull(), "ten_day").when(F.col("title").rlike("(?i)producer price|工业生产者"), "ppi").otherwise("other")
    return links.withColumn("kind", kind).withColumn("month", month)


def link_range(links: DataFrame, first: str, last: str) -> DataFrame:
    """Release links of months between two, both included."""
    return links.where(F.col("month").between(first, last) & (F.col("kind") != "other"))


def ingest(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshots, errors): incoming pages with unseen addresses and content, once each; challenge pages and pages
    whose title names no release are errors with a reason, and stop nothing. pages: source_url, title, html, retrieved_at."""
    month, window = title_month_window(F.col("title"))
    judged = incoming.withColumns({"content_sha256": F.sha2("html", 256), "release_month": month, "window": window, "published_at": published_at(F.col("html"))})
    reason = F.when(is_challenge(F.col("html")), "challenge").when(F.col("release_month").isNull() | F.col("window").isNull(), "no_release_in_title").when(F.col("published_at").isNull(), "no_publication_time")
    judged = judged.withColumn("reason", reason)
    new = judged.where("reason is null").join(stored.select("source_url").distinct(), "source_url", "left_anti").join(stored.select("content_sha256").distinct(), "content_sha256", "left_anti")
    first = new.groupBy("content_sha256").agg(F.min_by(F.struct("source_url", "title", "html", "retrieved_at", "release_month", "window", "published_at"), "source_url").alias("x"))
    return first.select("content_sha256", "x.*"), judged.where("reason is not null").select("source_url", "content_sha256", "reason")
