"""Documents to numbered pages."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docfields.functions.text import clean_text

PAGE_BREAK = "\f"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def page_name(stem: Column, page_no: Column) -> Column:
    return F.concat(stem, F.lit("_page_"), page_no.cast("string"), F.lit(".png"))


def page_path(folder: Column | str, page_id: Column) -> Column:
    return F.concat_ws("/", F.lit(folder) if isinstance(folder, str) else folder, page_id)


def split_pages(text: Column, delimiter: str = PAGE_BREAK) -> Column:
    """Pages as an array. A break at the very end closes the last page and starts no new one."""
    parts = F.split(text, re.escape(delimiter))
    closed = (F.size(parts) > 1) & text.endswith(delimiter)
    return F.when(closed, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def no_text(text: Column, delimiter: str = PAGE_BREAK) -> Column:
    """Whether a document has no text layer: its first page is blank. NULL text counts as none."""
    return clean_text(F.get(split_pages(text, delimiter), F.lit(0))) == ""


def with_text_layer(docs: DataFrame, text: str = "text", delimiter: str = PAGE_BREAK) -> DataFrame:
    """`docs` with `no_text`, to be added before the split into pages: every page then carries it, and no join is needed."""
    return docs.withColumn("no_text", no_text(F.col(text), delimiter))


def explode_pages(df: DataFrame, text: str = "text", stem: str = "stem",
                  delimiter: str = PAGE_BREAK) -> DataFrame:
    """One row per page with `page_id` (`{stem}_page_{n}.png`), `page_no` from 1 and `text`.

    Documents with NULL text have no pages. The other columns are kept.
    """
    rest = [c for c in df.columns if c not in (text, stem)]
    return (
        df.select(*rest, stem, F.posexplode(split_pages(F.col(text), delimiter)).alias("_pos", "text"))
        .select(*rest, page_name(F.col(stem), F.col("_pos") + 1).alias("page_id"),
                (F.col("_pos") + 1).alias("page_no"), "text")
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page name: the least by the other columns, in their order."""
    rest = [c for c in pages.columns if c != "page_id"]
    if not rest:
        return pages.distinct()
    least = pages.groupBy("page_id").agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select("page_id", "_least.*").select(*pages.columns)


def pages_from_files(files: DataFrame) -> DataFrame:
    """`page_id, doc_id, page_no, text, no_text` from `files(path, text)`, text cleaned.

    A PDF has one page per page break and none if its text is NULL. Any other file is one page under
    its own name, empty if its text is NULL.
    """
    name = file_name(F.col("path"))
    parts = F.when(is_pdf(name), split_pages(F.col("text"))).otherwise(
        F.array(F.coalesce("text", F.lit("")))
    )
    exploded = files.select(name.alias("doc_id"), F.coalesce(is_pdf(name) & no_text(F.col("text")), F.lit(False)).alias("no_text"),
                            F.posexplode(parts).alias("_pos", "_raw"))
    numbered = page_name(file_stem(F.col("doc_id")), F.col("_pos") + 1)
    return exploded.select(
        F.when(is_pdf(F.col("doc_id")), numbered).otherwise(F.col("doc_id")).alias("page_id"),
        "doc_id", (F.col("_pos") + 1).alias("page_no"), clean_text(F.col("_raw")).alias("text"), "no_text",
    )


def pages_of_large_files(spark: SparkSession, path: str, delimiter: str = PAGE_BREAK) -> DataFrame:
    """`page_id, doc_id, page_no, text, no_text`, as `pages_from_files` gives them, of text files too large for a row.

    For files whose text has page breaks and whose names end like a PDF's. A row is a page from the start: the page break is the
    reader's line separator, so one file is read by as many tasks as it has splits and no task holds more than a page. Pages are
    numbered by their place in their split and the pages of the splits before it. Only counts are shuffled, one row a split;
    they are joined to the pages by size, so text moves only if the splits are too many to send to all.
    A file that is not valid UTF-8 has no pages; an empty one has an empty page.
    """
    names = spark.read.format("binaryFile").load(path).select("path", "length").where(is_pdf(file_name(F.col("path"))))
    read = spark.read.option("lineSep", delimiter).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    ).where(is_pdf(file_name(F.col("path"))))
    splits = read.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.is_valid_utf8("raw")).alias("valid"),
        F.min(F.when(F.col("block") == 0, F.struct("at", (clean_text(F.col("raw")) == "").alias("blank"))))["blank"].alias("blank"))
    file = Window.partitionBy("path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.select(
        F.col("path").alias("s_path"), F.col("block").alias("s_block"), "first", F.min("valid").over(file).alias("valid"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.max("blank").over(file).alias("no_text"))
    pages = read.join(numbered, (F.col("path") == F.col("s_path")) & (F.col("block") == F.col("s_block"))).where("valid").select(
        "path", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("page_no"), "raw", "no_text")
    empty = names.where("length = 0").select("path", F.lit(1).alias("page_no"), F.lit("").alias("raw"), F.lit(True).alias("no_text"))
    doc = file_name(F.col("path"))
    return pages.unionByName(empty).select(
        page_name(file_stem(doc), F.col("page_no")).alias("page_id"), doc.alias("doc_id"), "page_no",
        clean_text(F.col("raw")).alias("text"), "no_text")


def names_may_clash(files: DataFrame) -> bool:
    """Whether two files could give the same page name; looks at names only.

    That takes an image named like a PDF page, PDFs whose names differ in the ending only, or one name in several folders.
    """
    names = files.select(file_name(F.col("path")).alias("name"))
    images = names.where(~is_pdf(F.col("name")) & F.col("name").rlike(r"_page_\d+\.png$"))
    document = F.when(is_pdf(F.col("name")), file_stem(F.col("name"))).otherwise(F.col("name"))
    documents = names.groupBy(is_pdf(F.col("name")), document).count()
    return not (images.isEmpty() and documents.where("count > 1").isEmpty())


def without_text(pages: DataFrame) -> DataFrame:
    """Documents whose first page has no text: `doc_id`."""
    return pages.where((F.col("page_no") == 1) & (clean_text(F.col("text")) == "")).select("doc_id")
