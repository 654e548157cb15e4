"""Binary documents to paragraphs: a DOCX reader for ``binaryFile`` rows and a registry by file type.

Many small files go in ZIP archives of bounded size, so that what is listed and opened grows with the bytes, not with the files.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, file_type string, status string, error_code string, paragraphs array<struct<idx:int,block_type:string,text:string>>"

#: As ``SCHEMA``, for the batches that tasks give.
_BLOCK = pa.struct([("idx", pa.int32()), ("block_type", pa.string()), ("text", pa.string())])
_NAMES = ("path", "file_type", "status", "error_code")

Blocks = list[tuple[str, str]]
_T, _P, _TABLE, _ROW, _CELL = (_W + x for x in ("t", "p", "tbl", "tr", "tc"))
_GAPS = frozenset(_W + x for x in ("br", "cr", "tab"))


def normalise(text: str) -> str:
    return " ".join(text.split())


def _text(node: ElementTree.Element) -> str:
    if len(node) == 1 and len(run := node[0]) == 1 and (only := run[0]).tag == _T and not len(only):  # one run of text
        return normalise(only.text or "")
    out = []
    for x in node.iter():
        if x.tag == _T:
            out.append(x.text or "")
        elif x.tag in _GAPS:
            out.append(" ")
    return normalise("".join(out))


def docx_blocks(content: bytes) -> Blocks:
    """Paragraphs and table rows in document order; the cells of a row are joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: Blocks = []
    for node in body if body is not None else []:
        if node.tag == _P:
            out.append(("PARAGRAPH", _text(node)))
        elif node.tag == _TABLE:
            out += [("TABLE_ROW", "\t".join(_text(c) for c in row.findall(_CELL))) for row in node.findall(_ROW)]
    return out


#: Parsers by file type (upper case); add to it to read more types.
PARSERS: dict[str, Callable[[bytes], Blocks]] = {"DOCX": docx_blocks}


Parsed = tuple[str, str, str, str | None, Blocks]


def _kind(path: str) -> str:
    return path.rpartition(".")[2].upper()


def _failed(path: str, code: str) -> Parsed:
    return path, _kind(path), "FAILED", code, []


def _parsed(path: str, content: Callable[[], bytes]) -> Parsed:
    parser = PARSERS.get(_kind(path))
    if parser is None:
        return _failed(path, "PARSE_UNSUPPORTED_TYPE")
    try:
        blocks = parser(content())
    except Exception:  # whatever a broken file raises is a result of parsing it
        return _failed(path, "PARSE_FAILED")
    return path, _kind(path), "PARSED" if any(t.strip() for _, t in blocks) else "EMPTY", None, blocks


#: Paragraphs of a batch that a task gives, roughly.
_BATCH = 20_000


def _batches(files: Iterator[Parsed]) -> Iterator[pa.RecordBatch]:
    held: list[Parsed] = []
    size = 0

    def batch() -> pa.RecordBatch:
        ends, idx, kinds, texts = [0], [], [], []
        for *_, blocks in held:
            idx += range(len(blocks))
            kinds += [k for k, _ in blocks]
            texts += [t for _, t in blocks]
            ends.append(len(idx))
        rows = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], fields=list(_BLOCK))
        columns = [pa.array([x[i] for x in held], pa.string()) for i in range(len(_NAMES))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=[*_NAMES, "paragraphs"])

    for one in files:
        held.append(one)
        size += 1 + len(one[-1])
        if size >= _BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in it:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            yield path, content.as_py()


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to one row a file: PARSED, EMPTY (no text) or FAILED with an error code."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_parsed(path, lambda x=content: x) for path, content in _rows(it))

    return files.select("path", "content").mapInArrow(task, SCHEMA)


def read_files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` as ``parse_files`` has them; those of more than ``most_bytes`` aren't opened (the scan leaves them out) and are FAILED with FILE_TOO_LARGE."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if most_bytes is None:
        return parse_files(files)
    kind = F.upper(F.substring_index("path", ".", -1))
    large = files.where(F.col("length") > most_bytes).select("path", kind.alias("file_type"), F.lit("FAILED").alias("status"), F.lit("FILE_TOO_LARGE").alias("error_code"), F.array().cast("array<struct<idx:int,block_type:string,text:string>>").alias("paragraphs"))
    return parse_files(files.where(F.col("length") <= most_bytes)).unionByName(large)


_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(blocks: Blocks) -> bytes:
    """A document of these paragraphs and table rows (cells divided by tabs), as small as the format allows."""

    def paragraph(t: str) -> str:
        kept = ' xml:space="preserve"' if t != t.strip() else ""
        return f"<w:p><w:r><w:t{kept}>{escape(t)}</w:t></w:r></w:p>"

    row = lambda t: "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in t.split("\t")) + "</w:tr>"
    body, table = [], []
    for kind, text in [*blocks, ("", "")]:
        if kind != "TABLE_ROW" and table:
            body.append(f"<w:tbl>{''.join(table)}</w:tbl>")
            table = []
        if kind == "TABLE_ROW":
            table.append(row(text))
        elif kind:
            body.append(paragraph(text))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def write_files(docs: DataFrame, path: str) -> int:
    """Write a file ``name`` for each row of (name, blocks) below ``path``, a folder that all executors share; how many there are."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        for pdf in it:
            for name, blocks in zip(pdf["name"], pdf["blocks"]):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(docx_bytes([(b["block_type"], b["text"]) for b in blocks]))
            yield pd.DataFrame({"n": [len(pdf)]})

    return docs.select("name", "blocks").mapInPandas(task, "n long").agg(F.sum("n")).first()[0] or 0


#: Files and bytes of an archive; one file may have more.
ARCHIVE_FILES, ARCHIVE_BYTES = 1000, 4 << 20


def write_archives(docs: DataFrame, path: str) -> list[str]:
    """As ``write_files``, in ZIP archives of ``ARCHIVE_FILES`` files and ``ARCHIVE_BYTES`` at most; their paths.

    What an aborted attempt of a task left behind isn't among the paths, and the names are never used again.
    """
    most_files, most_bytes = ARCHIVE_FILES, ARCHIVE_BYTES
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a file's blocks are one row
    if not 0 < int(docs.sparkSession.conf.get(rows)) <= most_files:
        docs.sparkSession.conf.set(rows, most_files)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        held: list[tuple[str, bytes]] = []
        size = 0

        def archive() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{root}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
                for file, data in held:
                    z.writestr(file, data)
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"]})

        for batch in it:
            names, blocks = batch.column("name").to_pylist(), batch.column("blocks")
            every = blocks.flatten()
            both, at = list(zip(*(every.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("block_type", "text")))), 0
            for name, n in zip(names, blocks.value_lengths().fill_null(0).to_pylist()):
                data = docx_bytes(both[at : at + n])
                at += n
                if held and (len(held) >= most_files or size + len(data) > most_bytes):
                    yield archive()
                    held, size = [], 0
                held.append((name, data))
                size += len(data)
        if held:
            yield archive()

    return sorted(r.path for r in docs.select("name", "blocks").mapInArrow(task, "path string").collect())  # a path an archive


def read_archives(spark: SparkSession, paths: list[str], most_bytes: int | None = None) -> DataFrame:
    """The files in ZIP archives as ``read_files`` has them, each by the archive's path and its name; an archive that can't be opened is a FAILED row of its own."""

    def files(it: Iterator[pa.RecordBatch]) -> Iterator[Parsed]:
        for path, content in _rows(it):
            try:
                z = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                yield _failed(path, "PARSE_FAILED")
                continue
            with z:
                for file in z.infolist():
                    name = f"{path}/{file.filename}"
                    if most_bytes is not None and file.file_size > most_bytes:
                        yield _failed(name, "FILE_TOO_LARGE")
                    else:
                        yield _parsed(name, lambda z=z, file=file: z.read(file))

    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(lambda it: _batches(files(it)), SCHEMA)
