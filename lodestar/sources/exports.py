"""Scans of tool exports: header aliases, dialects, parsers and what happens to bad values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"

# --- parsers: text to typed column, null where the text can't be read ----------------------


def text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def whole(c: Column) -> Column:
    """Plain whole number; separators make it bad."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def whole_with_commas(c: Column) -> Column:
    return whole(F.regexp_replace(c, ",", ""))


def truncated(c: Column) -> Column:
    """Number without commas, cut toward zero."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double").try_cast("bigint")


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def percent(c: Column) -> Column:
    """Click rate: a percent sign or a value above 1 means percent; exactly 1 stays 1."""
    t = F.trim(c)
    n = F.regexp_replace(F.regexp_replace(t, "%", ""), ",", ".").try_cast("double")
    return F.when(t.endswith("%") | (n > 1), n / 100).otherwise(n)


def percent_always(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "%", ""), ",", ".").try_cast("double") / 100


def percent_plain(c: Column) -> Column:
    """Percentage as a number; bad ones are 0."""
    return F.coalesce(F.regexp_replace(F.trim(c), "%", "").try_cast("double"), F.lit(0.0))


def money(c: Column) -> Column:
    """Amount of any locale: of two separators the right one is decimal; a lone comma is decimal."""
    t = F.regexp_replace(F.trim(c), r"[^\d.,\-]", "")
    comma, dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    both = F.when(comma < dot, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(t, ",", ""))
    return F.when((comma > 0) & (dot > 0), both).when(comma > 0, F.regexp_replace(t, ",", ".")).otherwise(t).try_cast("double")


def count_without_marks(c: Column) -> Column:
    """Transactions: both separators are dropped, so 12.5 reads as 125."""
    return F.regexp_replace(F.trim(c), "[.,]", "").try_cast("bigint")


def month(c: Column) -> Column:
    """yyyy-MM of a month, an ISO day, a day with slashes (US unless the first part is above 12) or an English month name."""
    t = F.trim(c)
    a, b, y = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (1, 2, 3))
    m = F.when(a.try_cast("int") > 12, b).otherwise(a)
    named = F.coalesce(*[F.date_format(F.try_to_timestamp(F.initcap(t), F.lit(p)), "yyyy-MM") for p in ("MMM yyyy", "MMMM yyyy")])
    return F.when(t.rlike(r"^\d{4}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(t, 1, 7)).when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))).otherwise(named)


def vector(c: Column) -> Column:
    """JSON array of numbers; null if empty or bad."""
    v = F.from_json(c, "array<float>")
    return F.when(F.size(v) > 0, v)


# --- tables ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableSpec:
    """Columns of an export: aliases in lower case, a parser for each, and the rules of the scan.

    priority: ``header`` takes the first header with any alias, ``alias`` the first alias with
    a header. on_error: ``drop`` rows with an unreadable value, or put ``zero``.
    """

    name: str
    aliases: dict[str, list[str]]
    required: list[str]
    parsers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    priority: str = "header"
    on_error: str = "drop"
    keep: str = "true"


_CTR = {"ctr": ["ctr", "click through rate"], "position": ["position", "avg. position", "average position"], "clicks": ["clicks"], "impressions": ["impressions"]}
_PAGE = ["top pages", "page", "pages", "url", "landing page", "address"]
_QUERY = ["top queries", "query", "queries", "search query", "keyword"]
_KEYWORD = ["keyword", "query", "search_term", "term"]
_LINK = ["url", "link", "result_url", "landing_page", "result"]

# Header aliases of the exports.
SPECS = {
    s.name: s
    for s in (
        TableSpec("search_query_page", {"query": _QUERY, "page": _PAGE, **_CTR}, ["query", "page", "clicks", "impressions", "position"], {"clicks": whole, "impressions": whole_with_commas, "ctr": percent, "position": decimal_comma}),
        TableSpec("search_page_date", {"page": _PAGE, "date": ["date", "month", "period"], **_CTR}, ["page", "date", "clicks"], {"date": month, "clicks": truncated, "impressions": truncated, "ctr": percent, "position": decimal_comma}),
        TableSpec("search_generic", {"query": _QUERY, "page": _PAGE, **_CTR}, ["query"], {"clicks": whole_with_commas, "impressions": whole_with_commas, "ctr": percent_always, "position": decimal_comma}, on_error="zero", keep="query <> ''"),
        TableSpec("crawl_text", {"url": ["address", "url", "page", "top pages"], "title": ["title 1", "title", "page title"], "h1": ["h1-1", "h1", "heading 1"], "meta_description": ["meta description 1", "meta description", "description"]}, ["url"], keep="url <> ''"),
        TableSpec(
            "crawl_health",
            {"address": ["address", "url", "dirección"], "status_code": ["status code", "status_code", "código de estado"], "indexability": ["indexability", "indexabilidad"], "word_count": ["word count", "word_count", "palabras"], "title": ["title 1", "title_1", "title", "título 1"], "h1": ["h1-1", "h1_1", "h1"], "h2": ["h2-1", "h2_1", "h2"], "meta_desc": ["meta description 1", "meta_description_1", "meta description", "descripción meta 1"], "canonical": ["canonical link element 1", "canonical_link_element_1", "canonical", "enlace canónico 1"], "inlinks": ["inlinks", "enlaces entrantes"], "outlinks": ["outlinks", "enlaces salientes"], "content_type": ["content type", "content_type", "tipo de contenido"], "crawl_depth": ["crawl depth", "crawl_depth", "profundidad de rastreo"]},
            ["address"], {"word_count": truncated, "inlinks": truncated, "outlinks": truncated, "crawl_depth": truncated}, priority="alias", on_error="zero",
        ),
        TableSpec("rankings", {"keyword": _KEYWORD, "volume": ["volume", "search_volume", "sv", "avg_monthly_searches"], "domain": ["domain", "url", "site", "landing_page", "result_url"], "position": ["position", "rank", "pos"]}, ["keyword", "domain", "position"], {"volume": lambda c: F.coalesce(truncated(c), F.lit(0)), "position": truncated}, keep="position >= 1"),
        TableSpec("traffic", {"domain": ["domain", "url", "site", "landing_page", "result_url"], "traffic": ["traffic", "organic_traffic", "estimated_traffic", "est_traffic"], "keywords": ["keywords", "keyword_count", "kw_count", "organic_keywords"]}, ["domain", "traffic"], {"traffic": truncated, "keywords": lambda c: F.coalesce(truncated(c), F.lit(0))}),
        TableSpec("serp", {"keyword": _KEYWORD, "rank": ["rank", "position", "pos"], "url": _LINK}, ["keyword", "url"], {"rank": lambda c: F.coalesce(truncated(c), F.lit(999))}, keep="keyword <> '' AND url <> ''"),
        TableSpec("inlinks", {"source": ["source", "from", "source url", "source address", "bron", "van"], "destination": ["destination", "target", "to", "destination url", "target url", "dest", "bestemming", "naar", "address"], "type": ["type", "link type", "type of link"], "anchor": ["anchor", "anchor text", "link text", "ankertekst", "alt text"], "follow": ["follow", "nofollow", "rel", "status code"]}, ["source", "destination"], priority="alias"),
        TableSpec("transactions", {"page": ["page", "landing page", "page path", "url", "address", "page path + query string", "pagina"], "transactions": ["transactions", "conversions", "purchases", "ecommerce purchases", "transacties", "aankopen"], "revenue": ["revenue", "purchase revenue", "total revenue", "omzet", "opbrengst", "transaction revenue", "item revenue"]}, ["page"], {"transactions": count_without_marks, "revenue": money}, priority="alias", on_error="zero"),
        TableSpec("redirect_spec", {"old_url": ["old_url", "source", "from", "old url", "source url", "from url", "address"], "new_url": ["new_url", "destination", "to", "new url", "target", "target url", "destination url"], "type": ["type", "status", "status code", "redirect type", "code"]}, ["old_url", "new_url"], {"type": lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("301"))}, priority="alias", keep="old_url <> '' AND new_url <> ''"),
        TableSpec("crawl_migration", {"url": ["address", "url", "source url", "page url"], "status_code": ["status code", "status", "http status", "response code"], "redirect_url": ["redirect url", "redirect uri", "redirect destination", "redirect to", "location"], "title": ["title 1", "title", "page title"], "h1": ["h1-1", "h1", "heading 1"], "word_count": ["word count", "wordcount", "words"], "meta_description": ["meta description 1", "meta description", "description"], "indexability": ["indexability", "indexable"], "canonical": ["canonical link element 1", "canonical", "canonical url"]}, ["url"], {"word_count": whole_with_commas}, priority="alias", on_error="zero", keep="url <> ''"),
        TableSpec("near_duplicates", {"url": ["address", "url"], "closest_match": ["closest similarity match", "closest near duplicate match", "closest match"], "similarity_pct": ["closest similarity", "similarity", "closest similarity score"], "hash": ["hash"]}, ["url"], {"similarity_pct": percent_plain}),
        TableSpec("semantic_similar", {"url": ["address", "url"], "closest_semantic_match": ["closest semantically similar address", "closest semantic match"], "semantic_score": ["semantic similarity score", "semantic score"], "count_similar": ["no. semantically similar", "count similar"]}, ["url"], {"semantic_score": percent_plain, "count_similar": lambda c: F.coalesce(truncated(c), F.lit(0))}),
        TableSpec("embeddings", {"url": ["address", "url"], "embedding": ["embeddings", "embedding", "(custom) embeddings"]}, ["url", "embedding"], {"embedding": vector}),
        TableSpec("products", {"title": ["title", "product title", "product name", "naam", "titel", "name", "product_name", "product_title", "item name", "title 1", "page title"], "mpn": ["mpn", "manufacturer part number", "part number", "partnumber", "manufacturer_part_number", "mfr part", "artikelnummer"], "sku": ["sku", "product sku", "item sku", "product_sku", "sku_id", "item number", "itemnumber"], "gtin": ["gtin", "ean", "upc", "barcode", "ean13", "upc-a", "gtin13", "gtin-13", "product_ean"], "category": ["category", "categorie", "department", "afdeling", "product category", "product_category", "cat", "type"], "brand": ["brand", "merk", "manufacturer", "fabrikant", "brand name"], "url": ["url", "address", "page", "link", "product url", "product_url", "canonical"]}, ["title"], priority="alias"),
        TableSpec("serp_titles", {"title": ["title", "serp title", "result title", "page title", "title tag", "title 1", "naam"], "position": ["position", "rank", "ranking", "pos", "avg. position", "average position"], "keyword": ["keyword", "query", "search query", "zoekwoord", "search term", "top queries"], "category": ["category", "categorie", "group", "cluster"], "url": ["url", "address", "page", "result url", "link"]}, ["title"], {"position": decimal_comma}, priority="alias", on_error="zero"),
    )
}


def column_map(headers: list[str], spec: TableSpec) -> dict[str, str]:
    """Header of each canonical column that the export has; an error names the required ones it lacks."""
    clean = {h: h.replace(BOM, "").strip().lower() for h in headers}
    found: dict[str, str] = {}
    for canonical, aliases in spec.aliases.items():
        if spec.priority == "header":
            hits = [h for h in headers if clean[h] in aliases]
        else:
            hits = [h for a in aliases for h in headers if clean[h] == a]
        if hits:
            found[canonical] = hits[0]
    if lacking := [c for c in spec.required if c not in found]:
        raise ValueError(f"{spec.name}: no column for {', '.join(lacking)} among {headers}")
    return found


def normalize(df: DataFrame, spec: TableSpec | str) -> DataFrame:
    """Canonical, typed columns of an export of text columns.

    Columns that the export lacks are empty, or 0 where numbers are read with on_error zero
    (null otherwise). Rows with an unreadable value are dropped or get 0 there, as the spec says.
    """
    spec = SPECS[spec] if isinstance(spec, str) else spec
    found = column_map(df.columns, spec)
    columns, bad = [], F.lit(False)
    for c in spec.aliases:
        parse = spec.parsers.get(c, text)
        if c not in found:
            v = parse(F.lit("0" if spec.on_error == "zero" else None).cast("string")) if c in spec.parsers else F.lit("")
        else:
            v = parse(F.col(f"`{found[c]}`").cast("string"))
            if c in spec.parsers:
                if spec.on_error == "zero":
                    v = F.coalesce(v, F.lit(0))
                elif c in spec.required or spec.name.startswith("search"):
                    bad |= v.isNull()
        columns.append(v.alias(c))
    return df.filter(~bad).select(*columns).filter(spec.keep)


def sniff(head: str) -> str:
    """S21. Delimiter of the first lines: of , ; tab | the one that splits most lines into the same number of parts."""
    lines = [x for x in head.splitlines()[:20] if x]

    def score(sep: str) -> tuple[int, int]:
        counts = [x.count(sep) for x in lines]
        return (sum(c == counts[0] for c in counts) if counts and counts[0] else 0, counts[0] if counts else 0)

    return max(",;\t|", key=score)


def read_export(spark: SparkSession, path: str, spec: TableSpec | str, sep: str | None = None, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """S1-S20. A CSV export by its spec; the delimiter is found from the first 4 KB, read through Spark.

    An export with line ends inside quotes is read by one task a file; any other is split. Which
    it is is found in one pass, by lines with an odd number of quotes, if not given.
    """
    if sep is None:
        first = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
        sep = sniff(first[:4096])
    if multi_line is None:
        lines = spark.read.option("wholetext", False).text(path)
        multi_line = not lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=multi_line, escape='"')
    return normalize(raw, spec)


def crawl_pages(df: DataFrame) -> DataFrame:
    """S6. Crawled pages for the health check: HTML with status 200; a column that the export lacks passes, an empty cell fails."""
    spec = SPECS["crawl_health"]
    found = column_map(df.columns, spec)
    out = normalize(df, spec)
    if "content_type" in found:
        out = out.filter(F.lower("content_type").contains("text/html"))
    return out.filter(F.col("status_code") == "200") if "status_code" in found else out


def page_clicks(search: DataFrame) -> DataFrame:
    """S4. Clicks by page key (lower case, no trailing slash)."""
    return search.groupBy(F.regexp_replace(F.lower("page"), "/+$", "").alias("url")).agg(F.sum("clicks").alias("clicks"))


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """S5. The last row of each key by an order column."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def serp_urls(serp: DataFrame, top_n: int = 10) -> DataFrame:
    """S20. Best rank of each (keyword, url), cut to the first n of a keyword."""
    best = serp.groupBy("keyword", "url").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("keyword").orderBy("rank", "url")
    return best.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top_n).drop("__n")


def candidate_pages(crawl: DataFrame, most: int = 1000) -> DataFrame:
    """S14. Indexable pages of 50 words or more, those with most inlinks."""
    kept = crawl.filter((F.col("status_code") == "200") & (F.lower("indexability") == "indexable") & (F.col("word_count") >= 50))
    return kept.orderBy(F.desc("inlinks"), "address").limit(most)


def distinct_keywords(df: DataFrame, column: str = "keyword") -> DataFrame:
    """S11. Distinct non-empty keywords."""
    return df.select(F.trim(column).alias("keyword")).filter("keyword <> ''").distinct()


def ordered_queries(df: DataFrame, column: str = "query", order: str = "row_id") -> DataFrame:
    """S12. Distinct non-empty queries with the place of their first row, in that order."""
    kept = df.select(F.trim(column).alias("query"), F.col(order).alias("first_seen")).filter("query <> ''")
    return kept.groupBy("query").agg(F.min("first_seen").alias("first_seen")).orderBy("first_seen", "query")


def seeds(df: DataFrame) -> DataFrame:
    """S15. Seeds of a table in row order: of keyword, Keyword, query, Query and seed the first that a row fills, else its first column."""
    named = [c for c in ("keyword", "Keyword", "query", "Query", "seed") if c in df.columns]
    cells = [F.trim(F.col(f"`{c}`").cast("string")) for c in [*named, df.columns[0]]]
    seed = F.coalesce(*[F.when(c != "", c) for c in cells])
    return df.select(seed.alias("seed")).filter("seed IS NOT NULL")


def ranked_keywords(df: DataFrame, column: str = "json", order: str = "file_order") -> DataFrame:
    """S13. (kw, sv, actual_url, actual_rank) of ranked-keyword envelopes; the first of a keyword wins over files, then by place.

    Without a volume it is 0, without a result the url is empty and the rank 99. Only the first
    task and the first result of an envelope count.
    """
    item = "struct<keyword_data:struct<keyword:string,keyword_info:struct<search_volume:bigint>>,ranked_serp_element:struct<serp_item:struct<url:string,rank_group:int>>>"
    parsed = df.select(F.col(order).alias("f"), F.from_json(column, f"tasks array<struct<result:array<struct<items:array<{item}>>>>>").alias("j"))
    items = parsed.select("f", F.posexplode(F.get(F.get("j.tasks", F.lit(0))["result"], F.lit(0))["items"]).alias("p", "i"))
    hit = F.col("i.ranked_serp_element.serp_item")
    rows = items.select(
        F.trim("i.keyword_data.keyword").alias("kw"), "f", "p", F.coalesce("i.keyword_data.keyword_info.search_volume", F.lit(0)).alias("sv"),
        F.coalesce(hit["url"], F.lit("")).alias("actual_url"), F.coalesce(hit["rank_group"], F.lit(99)).alias("actual_rank"),
    ).filter("kw <> ''")
    first = rows.groupBy("kw").agg(F.min_by(F.struct("sv", "actual_url", "actual_rank"), F.struct("f", "p")).alias("r"))
    return first.select("kw", "r.*")


def text_folder(spark: SparkSession, path: str, min_words: int = 50) -> DataFrame:
    """S22. (url, text, word_count) of the text files in a folder; the url is the decoded stem of the name (which Spark encodes once more)."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    words = F.size(F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != ""))
    return raw.select(F.url_decode(F.url_decode(F.regexp_replace("name", r"\.[^.]*$", ""))).alias("url"), F.col("value").alias("text"), words.alias("word_count")).filter(F.col("word_count") >= min_words)


_SERP = "tasks array<struct<result:array<struct<keyword:string,items:array<struct<type:string,rank_group:int,url:string,domain:string,title:string,description:string>>>>>>"


def serp_envelope(df: DataFrame, column: str = "json") -> DataFrame:
    """S29. Items of result-page envelopes: keyword, type, rank_group, url, domain, title, description."""
    results = df.select(F.from_json(column, _SERP).alias("j")).select(F.explode("j.tasks").alias("t")).select(F.explode("t.result").alias("r"))
    return results.select("r.keyword", F.inline("r.items"))


def keyword_envelope(df: DataFrame, column: str = "json") -> DataFrame:
    """S30, S13. Keywords of envelopes: keyword, volume, cpc, competition, difficulty; unknown volumes last."""
    schema = "tasks array<struct<result:array<struct<items:array<struct<keyword_data:struct<keyword:string,keyword_info:struct<search_volume:bigint,cpc:double,competition:double>,keyword_properties:struct<keyword_difficulty:int>>>>>>>>"
    items = df.select(F.from_json(column, schema).alias("j")).select(F.explode("j.tasks").alias("t")).select(F.explode("t.result").alias("r")).select(F.explode("r.items").alias("i")).select("i.keyword_data.*")
    return items.select("keyword", F.col("keyword_info.search_volume").alias("volume"), "keyword_info.cpc", "keyword_info.competition", F.col("keyword_properties.keyword_difficulty").alias("difficulty")).orderBy(F.desc_nulls_last("volume"), "keyword")


def snapshots(df: DataFrame, column: str = "json") -> DataFrame:
    """S33. Archive rows of arrays of arrays whose first row is the header: timestamp, original, statuscode, mimetype, digest."""
    rows = df.select(F.from_json(column, "array<array<string>>").alias("r"))
    each = rows.select(F.col("r")[0].alias("h"), F.explode(F.slice("r", 2, 1_000_000_000)).alias("v")).select(F.map_from_arrays("h", "v").alias("m"))
    return each.select(*[F.col("m")[c].alias(c) for c in ("timestamp", "original", "statuscode", "mimetype", "digest")])


def prospects(spark: SparkSession, path: str) -> DataFrame:
    """S34. Client records of a JSON array."""
    return spark.read.json(path, multiLine=True)


def check_dimensions(df: DataFrame, column: str = "embedding") -> DataFrame:
    """S37. ``df``, or an error if its vectors differ in length."""
    lo, hi = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} to {hi} components")
    return df
