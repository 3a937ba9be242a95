"""S27. Sitemap files: urls, and the files that index files name, one level deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "array<struct<loc:string,lastmod:string>>"
_SCHEMA = f"url {_ENTRY}, sitemap {_ENTRY}, broken string"


def read_sitemaps(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(file, address, kind, urls, sitemaps) of every file below ``path``: sitemap, index or malformed.

    ``base`` is the address of the folder, so a file's address is the base and its path below the folder (without ``.gz``).
    A file that isn't well-formed XML, or has another root, is malformed and has no entries. A sitemap has 50,000 urls at
    most by its protocol, so a file is one row, read whole.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}
    root = F.regexp_extract("value", r"(?s)^﻿?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:\w+:)?(\w+)", 1)
    parsed = files.select("file", root.alias("root"), F.from_xml("value", _SCHEMA, options).alias("x"))
    broken = F.col("x").isNull() | F.col("x.broken").isNotNull()
    kind = F.when(broken, "malformed").when(F.col("root") == "urlset", "sitemap").when(F.col("root") == "sitemapindex", "index").otherwise("malformed")
    # the path below the folder, whatever scheme it was read by
    folder = path.rstrip("/").split("://")[-1].lstrip("/")
    below = F.substring_index(F.url_decode("file"), folder + "/", -1)
    address = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(below, r"\.gz$", ""))
    none = F.array().cast(_ENTRY)
    entries = lambda of, name: F.when(F.col("kind") == of, F.coalesce(F.col(f"x.{name}"), none)).otherwise(none)
    return parsed.select("file", address.alias("address"), kind.alias("kind"), "x").select("file", "address", "kind", entries("sitemap", "url").alias("urls"), entries("index", "sitemap").alias("sitemaps"))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(sitemap, from_index, loc, lastmod): the urls of all sitemaps in ``files`` (see read_sitemaps), and the index that names each sitemap, null if none does.

    Index files are opened one level: an index named by an index adds nothing. Entries without a location are left out.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"\.gz$", ""))
    named = files.filter("kind = 'index'").select(F.col("address").alias("from_index"), F.explode("sitemaps").alias("s")).groupBy(clean(F.trim("s.loc")).alias("named")).agg(F.min("from_index").alias("from_index"))
    urls = files.filter("kind = 'sitemap'").select(F.col("address").alias("sitemap"), F.explode("urls").alias("u"))
    urls = urls.select("sitemap", F.trim("u.loc").alias("loc"), F.trim("u.lastmod").alias("lastmod")).filter("loc <> ''")
    return urls.join(named, F.col("sitemap") == F.col("named"), "left").select("sitemap", "from_index", "loc", "lastmod")


def sitemap_report(files: DataFrame) -> DataFrame:
    """(kind, files, entries, missing): files and entries of each kind; missing: sitemaps that an index names and the folder lacks."""
    named = files.filter("kind = 'index'").select(F.explode("sitemaps").alias("s")).select(F.trim(F.regexp_replace(F.trim("s.loc"), r"\.gz$", "")).alias("named")).distinct()
    missing = named.join(files.select("address"), F.col("named") == F.col("address"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    kinds = files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("urls") + F.size("sitemaps")).cast("bigint").alias("entries"))
    return kinds.crossJoin(F.broadcast(missing)).select("kind", "files", "entries", F.when(F.col("kind") == "index", F.col("n")).otherwise(0).alias("missing"))
