"""Document files and their text."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfields.fixed import EXTENSIONS

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _name_glob(extensions: Sequence[str]) -> str:
    """A glob for the endings in upper and lower case; the option itself heeds case."""
    def either_case(ending: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)

    return "*?{" + ",".join(either_case(e) for e in extensions) + "}"


def scan_folder(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """The document files of one folder: `path, modificationTime, length, content`.

    Other files are left out when the folder is listed, so their content is never read. A folder that
    cannot be listed gives no rows.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _name_glob(extensions))
    try:
        return reader.load(path).select("path", "modificationTime", "length", "content")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILE_SCHEMA)


def require_files(files: DataFrame, path: str) -> DataFrame:
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no documents in {path}")
    return files


ATTEMPT = "path string, text string, error struct<kind:string,message:string>"
# Bytes of text that a task puts by before it hands them on; Spark bounds the batches that come in by bytes as well.
HANDED_ON = 4 << 20


def try_files(files: DataFrame, fn: Callable[[bytes], str | None]) -> DataFrame:
    """Apply `fn` to the content of each file in parallel: `path, text, error`.

    An error in `fn` stops neither the job nor the batch: the file's text is NULL and `error` tells its kind and message. Without
    an error, text is what `fn` returns, which may be NULL. A task holds one batch of files and a few megabytes of text,
    however many files there are.
    """
    def attempt(content: bytes | None) -> tuple[str | None, dict[str, str] | None]:
        try:
            text = fn(content if content is not None else b"")
            if text is not None and not isinstance(text, str):
                raise TypeError(f"text expected, not {type(text).__name__}")
            # What isn't valid text fails here and not where the batch is put together.
            if text is not None:
                text.encode("utf-8")
            return text, None
        except Exception as exc:
            return None, {"kind": type(exc).__name__, "message": str(exc).encode("utf-8", "replace").decode("utf-8")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.string(), pa.struct([("kind", pa.string()), ("message", pa.string())])
        paths, texts, errors, held = [], [], [], 0

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((paths, texts, errors), kinds)], ["path", "text", "error"])

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                text, error = attempt(content.as_py())
                paths.append(path.as_py())
                texts.append(text)
                errors.append(error)
                held += len(text or "")
                if held >= HANDED_ON:
                    yield handed_on()
                    paths, texts, errors, held = [], [], [], 0
        yield handed_on()

    return files.select("path", "content").mapInArrow(apply, ATTEMPT)


def map_files(files: DataFrame, fn: Callable[[bytes], str | None]) -> DataFrame:
    """`path, text` of `try_files`: NULL for a file that `fn` fails on."""
    return try_files(files, fn).select("path", "text")


def failures(attempts: DataFrame) -> DataFrame:
    """`path, kind, message` of the files that failed."""
    return attempts.where(F.col("error").isNotNull()).select("path", "error.kind", "error.message")


def utf8_text(content: Column) -> Column:
    """Content as text, NULL if it is not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def attempt_text(files: DataFrame, fn: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """`path, text, error` of `files`: by `fn` (a text recogniser, say), else by reading UTF-8.

    Text is as recognised; page breaks in it are form feeds. A file whose text cannot be read has NULL text and an error.
    """
    if fn is not None:
        return try_files(files, fn)
    error = F.struct(F.lit("UnicodeDecodeError").alias("kind"), F.lit("not valid UTF-8").alias("message"))
    read = files.select("path", "content", utf8_text(F.col("content")).alias("text"))
    return read.select("path", "text", F.when(F.col("text").isNull() & F.col("content").isNotNull(), error).alias("error"))


def extract_text(files: DataFrame, fn: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """`path, text` of `attempt_text`; NULL marks a failure."""
    return attempt_text(files, fn).select("path", "text")
