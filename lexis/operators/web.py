"""Stored web pages: text, titles, file names, links and crawl (W1-W11, S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.functions import html as H
from lexis.session import scratch_path

# Fixed value: saved page layout.
PAGE_DOC_PREFIX = "URL: "


def scanned(pages: DataFrame) -> DataFrame:
    """``pages`` with ``nodes`` in place of their HTML.  The array comes out of a generator, so that filters
    on it stay above it and every page is scanned once."""
    rest = [c for c in pages.columns if c not in ("html", "nodes")]
    return pages.select(*rest, F.explode(F.array(H.scan("html"))).alias("nodes"))


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for pages that have a <body>."""
    return (scanned(pages).filter(H.has_body("nodes"))
                 .select("page_id", "url", H.body_text("nodes").alias("text")))


def pages_without_body(pages: DataFrame) -> DataFrame:
    return scanned(pages).filter(~H.has_body("nodes")).select("page_id", "url")


def page_titles(pages: DataFrame) -> DataFrame:
    return scanned(pages).select("page_id", H.page_title("nodes").alias("title"),
                                 H.page_filename("nodes").alias("file_name"))


def page_links(pages: DataFrame, base: str | Column | None = H.BASE_URL) -> DataFrame:
    """(page_id, pos, href, link): every body anchor in order, resolved
    against ``base`` (a fixed URL as in the reference) or, with
    ``base=None``, against the page's own URL."""
    return _links(pages, base).drop("url")


def _links(pages: DataFrame, base: str | Column | None) -> DataFrame:
    """``page_links`` with the page's URL."""
    b = F.col("url") if base is None else (F.lit(base) if isinstance(base, str) else base)
    src = scanned(pages).filter(H.has_body("nodes")).select("page_id", "url", H.anchor_hrefs("nodes").alias("_h"),
                                                            b.alias("_base"))
    return (src.select("page_id", "url", "_base", F.posexplode("_h").alias("pos", "href"))
               .select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "href",
                       H.resolve_url(F.col("_base"), F.col("href")).alias("link")))


def internal_links(pages: DataFrame, base: str | None = H.BASE_URL) -> DataFrame:
    """Links that stay inside the crawl base (the page's site when base=None)."""
    return _internal(pages, base).drop("url")


def _internal(pages: DataFrame, base: str | None) -> DataFrame:
    root = H.site_root("url") if base is None else F.lit(base)
    return _links(pages, base).filter(F.col("link").startswith(root))


def visitable_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs without a fragment (the crawler skips those)."""
    return urls.select(F.col(url_col).alias("url")).filter(~H.has_fragment("url")).distinct()


def crawl_frontier(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Internal links not yet visited (visited = stored page URLs)."""
    links = internal_links(pages, base).select(F.col("link").alias("url"))
    visited = pages.select("url")
    return visitable_urls(links).join(visited, "url", "left_anti")


def link_edges(pages: DataFrame, base: str | None = None) -> DataFrame:
    """(src, dst) internal, fragment-free edges between URLs."""
    links = _internal(pages, base).filter(~H.has_fragment("link"))
    return links.select(F.col("url").alias("src"), F.col("link").alias("dst")).distinct()


def crawl_reachable(edges: DataFrame, seeds: DataFrame, buckets: int | None = None) -> DataFrame:
    """(url, depth): closure of ``edges`` from ``seeds`` (breadth-first), until
    a round finds nothing new.

    Edges are written once, bucketed by where they begin, and every round's URLs bucketed by themselves, so
    a round shuffles what it finds, by URL, and neither the edges nor what was reached before: these are
    read bucket by bucket.  Nothing reached earlier is rewritten.
    """
    spark = edges.sparkSession
    tag, folder = uuid.uuid4().hex[:10], scratch_path(spark, "crawl")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made: set[str] = set()

    def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
        table = f"lexis_{name}_{tag}"
        (df.write.mode("append").format("parquet").bucketBy(buckets, column).sortBy(column)
           .option("path", f"{folder}/{name}").saveAsTable(table))
        made.add(table)
        return spark.table(table)

    edges = bucketed(edges.select("src", "dst").repartition(buckets, "src"), "edges", "src")
    found, depth = seeds.select("url").repartition(buckets, "url").distinct(), 0
    while True:
        fresh = bucketed(found, f"frontier_{depth}", "url")
        if not fresh.take(1):
            break
        reached = bucketed(fresh.withColumn("depth", F.lit(depth).cast("bigint")), "reached", "url")
        found, depth = crawl_round(edges, fresh, reached, buckets), depth + 1
    for table in made:  # the files stay for the result
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    schema = "url string, depth bigint"
    return spark.read.schema(schema).parquet(f"{folder}/reached") if depth else spark.createDataFrame([], schema)


def crawl_round(edges: DataFrame, fresh: DataFrame, reached: DataFrame, buckets: int) -> DataFrame:
    """The URLs one step from ``fresh`` that were not reached; only the steps' ends are shuffled."""
    found = (fresh.hint("merge").join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url"))
             .repartition(buckets, "url").distinct())
    # no anti join: that would be pushed below the step, to the side of the edges
    known = reached.select(F.col("url").alias("known")).hint("merge")
    return found.join(known, F.col("url") == F.col("known"), "left").where("known is null").select("url")


def saved_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, file_name, text) of pages the crawler saves: those it
    visits (no fragment in the URL, and each URL once, at its first page) that
    have a body and a usable title."""
    visited = pages.filter(~H.has_fragment("url"))
    first = visited.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return (scanned(visited.join(first, ["page_id", "url"], "left_semi")).filter(H.has_body("nodes"))
                 .select("page_id", "url", H.page_title("nodes").alias("title"),
                         H.page_filename("nodes").alias("file_name"), H.body_text("nodes").alias("text"))
                 .filter(F.col("title").isNotNull()).drop("title"))


def page_documents(pages: DataFrame) -> DataFrame:
    """(file_name, url, content): saved file per title; when titles collide the
    last visited page (highest page_id) wins.  max_by is a partial
    aggregate, so a hot file name is combined map-side, not in one task."""
    docs = saved_pages(pages).select(
        "page_id", "file_name", "url",
        F.concat(F.lit(PAGE_DOC_PREFIX), F.col("url"), F.lit("\n\n"), F.col("text")).alias("content"))
    win = docs.groupBy("file_name").agg(
        F.max_by(F.struct("url", "content"), F.col("page_id")).alias("_w"))
    return win.select("file_name", F.col("_w.url").alias("url"), F.col("_w.content").alias("content"))


def crawl_report(pages: DataFrame) -> DataFrame:
    """(file_name, pages_written): the saved files and how many visited pages
    wrote each; the row count is the number of files."""
    return saved_pages(pages).groupBy("file_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("pages_written"))
