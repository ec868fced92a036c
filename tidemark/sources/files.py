"""Readers and writers of the file formats in use."""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import PLACE, Folder

MENU = "name string, price_vnd int, category string, size string, ingredients string, description string"
FAQ = "question string, answer string, category string"
ROUTER = "text string, label int, intent string, is_noise boolean, language string, is_hard boolean"
REVIEW = "index int, text string, original_label string, judged_label string, confidence string, is_hard boolean, language string"
INTENT = "text string, subject string, action string, context string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quotes are doubled inside quoted fields, which may span lines."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped, bad ones skipped or, if
    not ``tolerant``, fatal. Of a folder with a log, what it names is read and
    plain files."""
    folder = None if set(path) & set("*?[{") else Folder(spark, path)
    paths = [p for _, ps in folder.sources() for p in ps] if folder and folder.commits() else path
    return spark.read.schema(schema).json(paths, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def read_latest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON-lines file or folder that was appended to: the last record of each
    key. Appends of ``write_jsonl`` come in the order of their commits, rows of
    one append in the order in which they were given. What was written by others
    comes before them, in order of the files' modification times, then names; rows
    of a file in the order of its lines. Bad lines and null keys are skipped. Only
    the last record of a key and task is shuffled, so a key may have any number."""
    folder = Folder(spark, path)
    paths = [p for _, ps in folder.sources() for p in ps]
    if not paths:
        return spark.createDataFrame([], schema)
    meta = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_modification_time", "file_block_start")]
    lines = spark.read.text(paths).select("value", *meta, F.monotonically_increasing_id().alias("_line"))
    rows = folder.numbered(lines, "_file_path").withColumn("r", F.from_json("value", f"{schema}, {PLACE} long"))
    own = F.col("_seq") > 0
    plain = [F.when(~own, F.col(c)).alias(c) for c in ("_file_modification_time", "_file_path", "_file_block_start", "_line")]
    last = F.max_by("r", F.struct("_seq", *plain, F.col(f"r.{PLACE}")))
    return rows.where(F.col(f"r.{key}").isNotNull()).groupBy(F.col(f"r.{key}").alias("_key")).agg(last.alias("r")).select("r.*").drop(PLACE)


def _pdf(raw: bytes) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf on the executors") from e
    return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages)


def _docx(raw: bytes) -> str:
    """Paragraphs of a DOCX file: its document part is XML in a zip archive."""
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p"))


#: What a document of a bundle begins with, at the start of a line; its name and a line end follow. A record
#: separator (U+001E) of the document itself is doubled, so no line of it looks like that.
_MARK = "\x1edocument "
#: Bytes that a bundle has on the average.
BUNDLE_BYTES = 4 << 20
_TEXT_BYTES = 4 << 20


def write_documents(rows: DataFrame, path: str) -> None:
    """(name, text) as text files of many documents each, so that there are as many
    files as the bytes need, not as there are documents. A line end is put
    after each document, null texts are empty; read back by ``read_documents``."""
    text = F.coalesce("text", F.lit(""))
    total = rows.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    record = F.concat(F.lit(_MARK), F.url_encode(F.coalesce("name", F.lit(""))), F.lit("\n"), F.replace(text, F.lit("\x1e"), F.lit("\x1e\x1e")))
    rows.select(record.alias("value")).repartition(max(1, -(-int(total) // BUNDLE_BYTES))).write.text(path)


def _texts_of(path: str, raw: bytes) -> Iterator[tuple[str, str]]:
    """(path, text) of a file, or of each document of a bundle as path#name."""
    kind = path.rsplit(".", 1)[-1].lower()
    mark = _MARK.encode()
    if kind in ("pdf", "docx"):
        yield path, (_pdf if kind == "pdf" else _docx)(raw)
    elif raw.startswith(mark):
        at = len(mark)
        while at >= len(mark):
            stop = raw.find(b"\n" + mark, at)
            name, _, body = raw[at : stop + 1 or None].partition(b"\n")
            yield f"{path}#{unquote_plus(name.decode())}", body.replace(b"\x1e\x1e", b"\x1e").decode("utf-8", "replace")
            at = stop + 1 + len(mark) if stop >= 0 else 0
    else:
        yield path, raw.decode("utf-8", "replace")


def document_texts(files: DataFrame) -> DataFrame:
    """(path, text) from (path, content): by what follows the path's last dot,
    pdf and docx are unpacked, anything else is UTF-8 text. A text file that
    begins like a bundle of ``write_documents`` gives a row a document, whose path
    ends in # and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "text"])
        for b in batches:
            out, size = [], 0
            for path, raw in zip(b.column(0), b.column(1), strict=True):
                for row in _texts_of(path.as_py(), raw.as_py() or b""):
                    out.append(row)
                    size += len(row[1])
                    if size >= _TEXT_BYTES:
                        yield made(out)
                        out, size = [], 0
            if out:
                yield made(out)

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document_texts`` of all files below ``path``."""
    return document_texts(spark.read.format("binaryFile").load(path))


def write_jsonl(rows: DataFrame, path: str, append: bool = False, batch: str | None = None) -> int | None:
    """One JSON object a row, as a commit of the folder's log; without ``append``
    the folder is emptied first. The commit's number, or None where ``batch`` is
    in the log already."""
    folder = Folder(rows.sparkSession, path)
    if not append:
        folder.clear()
    return folder.append(rows, lambda df, at: df.write.json(at), batch)


def append_parquet(rows: DataFrame, path: str, batch: str | None = None) -> int | None:
    """As ``write_jsonl`` with ``append``, in Parquet."""
    return Folder(rows.sparkSession, path).append(rows, lambda df, at: df.write.parquet(at), batch)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``append_parquet`` has committed."""
    return spark.read.parquet(*(p for _, ps in Folder(spark, path).sources() for p in ps)).drop(PLACE)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document a row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
