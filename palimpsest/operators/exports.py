"""Exports: chosen pages at a cutoff, their files with provenance, index and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import escape_markdown, slug, source_url

#: Bounds of one export.
MOST_ARTICLES, MOST_BYTES = 10_000, 512 << 20
HASH_NAME = "palimpsest/sha256"
#: Order of the fields in front matter (fixed values).
FRONT = ("wiki", "wiki_id", "page_id", "title", "revision_id", "revision_time", "source_url", "source_api_endpoint", "capture_time_unix", "content_hash", "content_hash_algorithm", "transformer_version")
NOTICE = "The source site's license and attribution requirements apply; license metadata is not available in this export.\n"


def selected_pages(members: DataFrame, collections: DataFrame, collection: str, keys: list[str]) -> DataFrame:
    """Distinct pages of the chosen collections' active members."""
    return members.where("active").join(collections.select(collection), collection, "left_semi").select(*keys).distinct()


def with_paths(pages: DataFrame, wiki: str, page: str, title: str, extension: str) -> DataFrame:
    """Pages with ``relative_path``; of pages with one id and slug the first wiki's has the plain path, others name their wiki."""
    stem = F.concat(F.lit("articles/"), F.col(page).cast("string"), F.lit("-"), slug(F.col(title)))
    nth = F.row_number().over(Window.partitionBy("_stem").orderBy(wiki))
    path = F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-wiki-"), F.col(wiki).cast("string")))
    return pages.withColumn("_stem", stem).withColumn("_n", nth).withColumn("relative_path", F.concat(path, F.lit(f".{extension}"))).drop("_stem", "_n")


def metadata(article_format: str, transformer: str) -> Column:
    """The provenance record of an article: 15 fields in alphabetical order, nulls kept."""
    return F.struct(
        F.col("author"), F.col("captured_at").alias("capture_time_unix"), F.col("content_hash"), F.lit(HASH_NAME).alias("content_hash_algorithm"), F.lit(article_format).alias("format"),
        F.col("page_id"), F.col("relative_path"), F.col("revision_id"), F.col("revision_time"), F.col("endpoint").alias("source_api_endpoint"),
        source_url(F.col("endpoint"), F.col("title"), F.col("revision_id")).alias("source_url"), F.col("title"), F.lit(transformer).alias("transformer_version"), F.col("wiki"), F.col("wiki_id"),
    )


def index_line(record: Column) -> Column:
    """A provenance record as a line of the index."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def _closed(body: Column) -> Column:
    return F.when((body == "") | body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))


def markdown_file(record: Column, body: Column) -> Column:
    """Front matter in a fixed order, the body, and where it comes from."""
    def shown(k: str) -> Column:
        json = F.to_json(F.array(record[k]))
        return F.concat(F.lit(f"{k}: "), json.substr(F.lit(2), F.length(json) - 2))

    lines = [shown(k) for k in FRONT]
    author = F.coalesce(record["author"], F.lit("not available"))
    source = F.concat(F.lit("Source: ["), escape_markdown(record["title"]), F.lit("]("), record["source_url"], F.lit("), revision "), record["revision_id"].cast("string"), F.lit(" ("), record["revision_time"], F.lit(").\n\n"))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), _closed(body), F.lit("\n## Source and attribution\n\n"), source, F.lit("Revision author: "), escape_markdown(author), F.lit(".\n\n" + NOTICE))


def text_file(record: Column, body: Column) -> Column:
    """A plain head of labelled lines, the body, and where it comes from."""
    labels = (("Page ID", "page_id"), ("Revision ID", "revision_id"), ("Revision time", "revision_time"), ("Source URL", "source_url"), ("Source API endpoint", "source_api_endpoint"), ("Capture time (Unix)", "capture_time_unix"), ("Content hash", "content_hash"), ("Content hash algorithm", "content_hash_algorithm"), ("Transformer", "transformer_version"))
    head = [F.concat(F.lit("Title: "), record["title"]), F.concat(F.lit("Wiki: "), record["wiki"], F.lit(" (local ID "), record["wiki_id"].cast("string"), F.lit(")"))]
    head += [F.concat(F.lit(f"{name}: "), record[k].cast("string")) for name, k in labels]
    author = F.coalesce(record["author"], F.lit("not available"))
    source = F.concat(F.lit("Source: "), record["title"], F.lit(" (revision "), record["revision_id"].cast("string"), F.lit(", "), record["revision_time"], F.lit(").\nRevision author: "), author, F.lit(".\nPermanent source URL: "), record["source_url"], F.lit("\n"))
    return F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), _closed(body), F.lit("\nSOURCE AND ATTRIBUTION\n"), source, F.lit(NOTICE))


def summary(pages: DataFrame, revision: str, size: str, captured: str) -> DataFrame:
    """One row: articles, pages without a revision, source bytes, newest capture, and which bound is exceeded."""
    sums = pages.agg(F.count(revision).alias("article_count"), F.count_if(F.col(revision).isNull()).alias("uncaptured_page_count"), F.coalesce(F.sum(F.when(F.col(revision).isNotNull(), F.col(size))), F.lit(0)).alias("canonical_source_bytes"), F.max(F.when(F.col(revision).isNotNull(), F.col(captured))).alias("maximum_capture_time_unix"))
    total = F.col("article_count") + F.col("uncaptured_page_count")
    return sums.withColumn("problem", F.when(total > MOST_ARTICLES, "too many pages").when(F.col("canonical_source_bytes") > MOST_BYTES, "too many bytes"))


def write_export(articles: DataFrame, path: str, made: DataFrame) -> None:
    """Writes files (relative_path, content), index lines and the one-row summary under ``path``; raises before writing where a bound is exceeded.

    Each part's folder appears as a whole by Spark's commit; the summary comes last and says that the export is complete.
    """
    if (row := made.first())["problem"]:
        raise ValueError(row["problem"])
    articles.select("relative_path", "content").write.mode("overwrite").parquet(f"{path}/articles")
    articles.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/index")
    made.write.mode("overwrite").json(f"{path}/manifest")
