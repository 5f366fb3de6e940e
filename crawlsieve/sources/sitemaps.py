"""Stored sitemap files (S5-S8): entries of each file, size limit, and one level of index expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.text import limit_text

FILE_SCHEMA = "file_seq INT, url STRING, final_url STRING, body STRING, http_status INT"
MAX_BYTES = 52_428_800  # Fixed value: the largest sitemap search engines accept, uncompressed.
TOO_LARGE = "sitemap is larger than 50 MB uncompressed"


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Stored files as whole texts; ``.gz`` files are unpacked by the reader."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS url", "value AS body")
    return files.selectExpr("CAST(NULL AS INT) AS file_seq", "url", "url AS final_url", "body", "200 AS http_status")


def _root(text: str) -> str:
    """Name of the first element, '' when there is none."""
    return rf"lower(regexp_extract({text}, r'(?s)^\x{{FEFF}}?(?:\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>))*\s*<([A-Za-z][A-Za-z0-9:_-]*)', 1))"


def _kind_and_error(root: str, large: str, status: str = "200") -> tuple[str, str]:
    kind = f"CASE WHEN {large} THEN NULL WHEN {root} = 'urlset' THEN 'urlset' WHEN {root} = 'sitemapindex' THEN 'index' END"
    error = (f"CASE WHEN {status} <> 200 THEN concat('HTTP ', {status}) WHEN {large} OR ({kind}) IS NOT NULL THEN NULL "
             f"WHEN {root} = '' THEN 'not a sitemap (root element is missing)' ELSE concat('not a sitemap (root element is <', {root}, '>)') END")
    return kind, error


def sitemap_files(files: DataFrame) -> DataFrame:
    """Kind and size of each file (S7): an oversized one lists nothing, one with another root is an error."""
    large = f"octet_length(body) > {MAX_BYTES}"
    kind, error = _kind_and_error(_root("body"), large, "http_status")
    return files.select("file_seq", "url", "final_url", col(f"coalesce({large}, false)").alias("too_large"), col(kind).alias("kind"),
                        col(error).alias("error"), col(f"CASE WHEN NOT coalesce({large}, false) THEN body END").alias("body"))


def _entry_blocks(text: str) -> str:
    """The entries of a text, by the kind of its file; comments are left out."""
    return (rf"regexp_extract_all(regexp_replace({text}, r'(?s)<!--.*?(-->|$)', ''), "
            r"CASE WHEN kind = 'urlset' THEN r'(?s)<url(?:\s[^>]*)?(?:/>|>(.*?)</url\s*>)' ELSE r'(?s)<sitemap(?:\s[^>]*)?(?:/>|>(.*?)</sitemap\s*>)' END, 0)")


def _children(entry: DataFrame) -> DataFrame:
    """loc and lastmod of rows with an ``entry``."""
    def child(name: str) -> str:
        raw = rf"regexp_extract(entry, r'(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>', 1)"
        text = rf"trim(regexp_replace({raw}, r'(?s)<!\[CDATA\[(.*?)\]\]>', '$1'))"
        plain = text
        for name_, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\\'"), ("&apos;", "\\'"), ("&amp;", "&")):
            plain = f"replace({plain}, '{name_}', '{char}')"
        return f"regexp_replace({plain}, r'^\\s+|\\s+$', '')"
    return entry.select("file_seq", "file_url", "kind", "pos", col(child("loc")).alias("loc"),
                        col(rf"CASE WHEN entry RLIKE r'<lastmod(\s[^>]*)?>' THEN {child('lastmod')} END").alias("lastmod"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(file_url, pos, loc, lastmod): one row per entry; loc is '' where the entry has none, lastmod NULL where absent.

    For files whose text is a value.  ``read_sitemap_chunks`` reads stored files piece by piece.
    """
    entry = files.filter("kind IS NOT NULL AND error IS NULL").select(
        F.col("file_seq"), F.col("url").alias("file_url"), "kind", col(f"posexplode({_entry_blocks('body')})").alias("pos", "entry"))
    return _children(entry)


# --- stored files, read in pieces -------------------------------------------------------------------------------------------

CHUNK_END = "</url>"


def read_sitemap_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored sitemap files cut after each entry: (url, at, value), ``at`` in the order of the file.

    The end of an entry is the text source's line separator, so a plain file is read in as many splits as its size asks for, and no task holds a file; a
    ``.gz`` file is one split, a row an entry.  An index, which has no such ends, is one row.
    """
    rows = spark.read.option("lineSep", CHUNK_END).text(path)
    return rows.selectExpr("_metadata.file_path AS url", "struct(_metadata.file_block_start AS block, monotonically_increasing_id() AS row) AS at", "value")


def stored_sitemap_files(chunks: DataFrame) -> DataFrame:
    """Kind and size of each stored file, as ``sitemap_files`` has them; its text stays where it is."""
    size = F.sum(F.octet_length("value") + len(CHUNK_END)) - len(CHUNK_END)
    files = chunks.groupBy("url").agg(size.alias("size"), F.min_by(F.expr("left(value, 65536)"), "at").alias("head"))
    kind, error = _kind_and_error(_root("head"), f"size > {MAX_BYTES}")
    return files.selectExpr("CAST(NULL AS INT) AS file_seq", "url", "url AS final_url", f"size > {MAX_BYTES} AS too_large", f"{kind} AS kind", f"{error} AS error")


def stored_sitemap_entries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of stored files, as ``sitemap_entries`` has them.

    A piece may lie in a comment that an earlier one opened: the last mark of the pieces before it tells.  Pieces are numbered file by file, by a window
    over a file's pieces (50 MB at most); entries are cut out piece by piece.
    """
    in_file = W.partitionBy("url").orderBy("at")
    last = lambda mark: f"instr(reverse(value), reverse('{mark}'))"  # from the end; 0 for none
    opens = f"CASE WHEN {last('<!--')} > 0 AND ({last('-->')} = 0 OR {last('<!--')} < {last('-->')}) THEN true WHEN {last('-->')} > 0 THEN false END"
    kinds = files.filter("kind IS NOT NULL AND error IS NULL").select("url", "file_seq", "kind")
    marked = chunks.join(kinds, "url").withColumn("opens", col(opens))
    placed = marked.withColumn("inside", F.last("opens", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, -1))).withColumn("is_last", F.lead("at").over(in_file).isNull())
    whole = f"concat(CASE WHEN inside THEN '<!--' ELSE '' END, value, CASE WHEN is_last THEN '' ELSE '{CHUNK_END}' END)"
    cut = placed.withColumn("entries", col(_entry_blocks(whole))).select("url", "file_seq", "kind", "at", "entries")
    before = F.coalesce(F.sum(F.size("entries")).over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("before", before).select("file_seq", F.col("url").alias("file_url"), "kind", "before", col("posexplode_outer(entries)").alias("i", "entry")).filter("entry IS NOT NULL")
    return _children(rows.withColumn("pos", (F.col("before") + F.col("i")).cast("int")))


def expand_sitemap_index(files: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URL entries of the given sitemaps and of the children of indexes, one level deep, and what was skipped.

    ``files`` holds the sitemaps that were given (``given`` true) and the files that were stored besides them.
    """
    stored = files.select(F.col("url").alias("known_as"), F.struct("url", "kind", "too_large", "error").alias("file")).unionByName(
        files.filter("final_url <> url").select(F.col("final_url").alias("known_as"), F.struct("url", "kind", "too_large", "error").alias("file")))
    stored = stored.groupBy("known_as").agg(F.min("file").alias("file"))
    given = files.filter("given")
    index = given.filter("kind = 'index'").select(F.col("url").alias("index_url"), F.col("final_url").alias("index_final"), F.col("file_seq").alias("index_seq"))
    listed = (entries.filter("kind = 'index' AND loc <> ''").withColumnRenamed("file_url", "index_url").join(index, "index_url")
              .filter("loc <> index_url AND loc <> index_final"))
    children = listed.groupBy("index_url", "index_seq", "loc").agg(F.min("pos").alias("pos"))
    matched = children.join(stored.withColumnRenamed("known_as", "loc"), "loc", "left")
    reason = (f"CASE WHEN file IS NULL THEN 'could not read sitemap: not stored' WHEN file.error IS NOT NULL THEN concat('could not read sitemap: ', file.error) "
              f"WHEN file.too_large THEN '{TOO_LARGE}' WHEN file.kind = 'index' THEN 'nested sitemap index (only one level is followed)' END")
    judged = matched.withColumn("reason", col(reason))
    skipped = judged.filter("reason IS NOT NULL").select(F.col("loc").alias("input"), col("concat('sitemap index ', index_url)").alias("source"), "reason")
    too_large = given.filter("too_large").select(F.col("url").alias("input"), F.lit("--sitemap").alias("source"), F.lit(TOO_LARGE).alias("reason"))
    # A file read before, as a given one or for an earlier index, adds its entries to each place that names it.
    urls = entries.filter("kind = 'urlset' AND loc <> ''").select(F.col("file_url"), "pos", "loc")
    own = given.filter("kind = 'urlset'").select(F.col("url").alias("file_url"), F.col("url").alias("sitemap"), F.col("file_seq").alias("a"), F.lit(0).alias("b"))
    nested = judged.filter("reason IS NULL").select(col("file.url").alias("file_url"), F.col("loc").alias("sitemap"), F.col("index_seq").alias("a"), F.col("pos").alias("b"))
    found = own.unionByName(nested).join(urls, "file_url")
    return (found.select(F.struct("a", "b", "pos").alias("ord"), F.col("loc").alias("value"), col("concat('sitemap ', sitemap)").alias("source"), "sitemap"),
            skipped.unionByName(too_large))


def first_lastmod(entries: DataFrame, page_key) -> DataFrame:
    """The first lastmod a urlset gives each page."""
    dated = entries.filter("kind = 'urlset' AND loc <> '' AND lastmod <> ''").select(
        col(page_key("loc")).alias("page_key"), F.struct("file_seq", "pos").alias("at"), col(limit_text("lastmod", 60)).alias("lastmod"))
    return dated.groupBy("page_key").agg(F.min_by("lastmod", "at").alias("sitemap_lastmod"))
