"""Sinks: pair and household tables in their report layouts, as CSV, Parquet or a folder of sheets."""

from __future__ import annotations

import csv
import io
import math
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kinloom.operators import matching
from kinloom.operators.linked import Linked
from kinloom.plans.algorithms import HOUSEHOLD, Algorithm
from kinloom.storage import staged

_TITLES = {"id": "ID", "uuid": "UUID", "first_name": "FirstName", "middle_name": "MiddleName", "last_name": "LastName", "birthdate": "Birthdate"}
_FLAGS = {Algorithm.FIRST_LAST_DOB: "is_matched_Infnbd", Algorithm.FIRST_MID_LAST_DOB: "is_matched_Infnmnbd", Algorithm.FUZZY: "is_matched_Fuzzy", Algorithm.FUZZY_NO_MIDDLE: "is_matched_Fuzzy"}


def _shown_names(algorithm: Algorithm) -> list[str]:
    return [n for n in _TITLES if n != "middle_name" or algorithm != Algorithm.FIRST_LAST_DOB]


def _rendered(i: int, prefix: str, algorithm: Algorithm) -> list[Column]:
    """A side's columns of a report, as strings."""
    return [F.coalesce(F.col(f"{prefix}_{n}").cast("string"), F.lit("")).alias(f"Table{i}_{_TITLES[n]}") for n in _shown_names(algorithm)]


def pair_report(pairs: DataFrame, algorithm: Algorithm | int, *, min_confidence: float = 0.0, separator: str = ",") -> DataFrame:
    """The report's columns: both persons, the flag, Confidence and MatchedFields; nulls are empty strings.

    Fuzzy pairs below min_confidence (compared as floats) are left out.  A7 has no report.
    """
    algorithm = Algorithm(algorithm)
    if algorithm not in _FLAGS:
        raise ValueError(f"{algorithm.name} has no pair report")
    columns = [*_rendered(1, "a", algorithm), *_rendered(2, "b", algorithm)]
    fuzzy = algorithm in (Algorithm.FUZZY, Algorithm.FUZZY_NO_MIDDLE)
    flag = F.lit(True) if fuzzy else F.col("is_matched_infnbd" if algorithm == Algorithm.FIRST_LAST_DOB else "is_matched_infnmnbd")
    kept = pairs.filter(F.col("confidence") >= F.lit(min_confidence).cast("float")) if fuzzy else pairs
    return kept.select(*columns, flag.alias(_FLAGS[algorithm]), F.col("confidence").alias("Confidence"), F.array_join("matched_fields", separator).alias("MatchedFields"))


def linked_report(linked: Linked, algorithm: Algorithm | int, *, min_confidence: float = 0.0, separator: str = ",") -> Linked:
    """pair_report of linked persons (match_classes): either side's columns are rendered once for each person.

    Its pairs, by report_pairs, are the report.
    """
    algorithm = Algorithm(algorithm)
    if algorithm not in _FLAGS:
        raise ValueError(f"{algorithm.name} has no pair report")
    told = []
    if linked.links is not None:
        linked = matching.confident(linked, min_confidence)
        told = [(F.col("score") / 100).cast("float").alias("Confidence"), F.concat_ws(separator, F.lit("fuzzy"), F.col("label"), F.lit("birthdate")).alias("MatchedFields")]
    return linked.shown(*[_rendered(i, p, algorithm) for i, p in ((1, "a"), (2, "b"))], told)


def report_pairs(linked: Linked, algorithm: Algorithm | int, *, separator: str = ",") -> DataFrame:
    """The rows of a linked_report; person columns are joined as they are."""
    algorithm = Algorithm(algorithm)
    pairs = linked.pairs()
    if linked.links is None:
        fields = matching.FIELDS_2 if algorithm == Algorithm.FIRST_MID_LAST_DOB else matching.FIELDS_1
        pairs = pairs.withColumns({"Confidence": F.lit(1.0).cast("float"), "MatchedFields": F.lit(separator.join(fields))})
    shown = [f"Table{i}_{_TITLES[n]}" for i in (1, 2) for n in _shown_names(algorithm)]
    return pairs.select(*shown, F.lit(True).alias(_FLAGS[algorithm]), "Confidence", "MatchedFields")


def household_report(rows: DataFrame) -> DataFrame:
    """Household rows with the percentage to two places and empty strings for nulls."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(F.col("row_id").alias("id"), "uuid", "hh_id", F.format_string("%.2f", F.col("match_percentage").cast("double")).alias("match_percentage"), empty("region_code"), empty("poor_hat_0"), empty("poor_hat_10"))


def report(rows: DataFrame, algorithm: Algorithm | int, **options) -> DataFrame:
    return household_report(rows) if Algorithm(algorithm) in HOUSEHOLD else pair_report(rows, algorithm, **options)


def write_csv(df: DataFrame, path: str, *, one_file: bool = False, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers; one_file is for results that are known to be small."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_csv_classes(linked: Linked, path: str, *, mode: str = "overwrite") -> None:
    """A linked_report as folders of CSV files: first and second, the persons with the class they are in, and links of classes.

    Every pair of the report is there, by its class or link, and files grow with the persons instead of with their pairs.  class
    is the MD5 of the compared columns.  Of persons who match no one there is no row.
    """
    def told(p: str) -> Column:
        return F.md5(F.to_json(F.struct(*[F.col(f"{p}_{c}").alias(c) for c in linked.by])))

    def put(t: DataFrame, p: str, name: str, matched: DataFrame) -> DataFrame:
        own = t.withColumn("class", told(p)).join(matched, "class", "left_semi")
        write_csv(own.select(*[c for c in own.columns if c not in ("class", *(f"{p}_{c}" for c in linked.by))], "class"), f"{path}/{name}", mode=mode)
        return back(name)

    def back(name: str) -> DataFrame:
        return linked.one.sparkSession.read.option("header", True).csv(f"{path}/{name}")

    if linked.links is None:
        second = put(linked.two, "b", "second", linked.one.select(told("a").alias("class")))
        put(linked.one, "a", "first", second.select("class"))
        return
    links = linked.links.withColumns({"class_a": told("a"), "class_b": told("b")})
    write_csv(links.drop(*[f"{p}_{c}" for p in ("a", "b") for c in linked.by]), f"{path}/links", mode=mode)
    for t, p, name in ((linked.one, "a", "first"), (linked.two, "b", "second")):
        put(t, p, name, back("links").select(F.col(f"class_{p}").alias("class")))


def read_csv_classes(linked: Linked, path: str) -> Linked:
    """What write_csv_classes wrote of such a report, whose columns tell the schema; empty strings come back as such."""
    spark = linked.one.sparkSession

    def back(table: DataFrame, own: list[str], name: str, classes: str) -> DataFrame:
        schema = ", ".join([f"`{n}` {t}" for n, t in table.dtypes if n not in own])
        rows = spark.read.schema(f"{schema}, {classes}" if schema else classes).option("header", True).option("enforceSchema", False).csv(f"{path}/{name}")
        return rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes])

    one, two = (back(t, [f"{p}_{c}" for c in linked.by], name, "class string").withColumnRenamed("class", f"{p}_class") for t, p, name in ((linked.one, "a", "first"), (linked.two, "b", "second")))
    links = None
    if linked.links is not None:
        links = back(linked.links, [f"{p}_{c}" for p in ("a", "b") for c in linked.by], "links", "class_a string, class_b string").withColumnsRenamed({"class_a": "a_class", "class_b": "b_class"})
    return Linked(one, two, links, ("class",))


def write_sheet_classes(linked: Linked, path: str) -> Linked:
    """A linked_report of exact rules as a Parquet sheet: folders first and second, the persons by class; returns it as it is read back.

    Every pair of the sheet is there by its class, and files grow with the persons.  Of persons who match no one there is no row.
    """
    if linked.links is not None:
        raise ValueError("sheets of classes are of A1 and A2")
    sides = []
    for t, p, other, q, name in ((linked.one, "a", linked.two, "b", "first"), (linked.two, "b", linked.one, "a", "second")):
        matched = other.select(*[F.col(f"{q}_{c}").alias(f"{p}_{c}") for c in linked.by]).distinct()
        own = t.join(matched, [f"{p}_{c}" for c in linked.by], "left_semi")
        own.write.mode("overwrite").parquet(f"{path}/{name}")
        sides.append(t.sparkSession.read.schema(own.schema).parquet(f"{path}/{name}"))
    return Linked(*sides, None, linked.by)


def write_sheets(sheets: dict[str, DataFrame], path: str, *, format: str = "csv") -> None:
    """A workbook as a folder: one folder for each sheet, written by the executors."""
    for name, df in sheets.items():
        if format == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            write_csv(df, f"{path}/{name}")


def pair_sheets(algo1: DataFrame, algo2: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The workbook of both exact results and the summary; matched fields are joined by semicolons."""
    return {
        "Algorithm_1_Results": pair_report(algo1, Algorithm.FIRST_LAST_DOB, separator=";"),
        "Algorithm_2_Results": pair_report(algo2, Algorithm.FIRST_MID_LAST_DOB, separator=";"),
        "Summary": summary,
    }


def household_sheets(rows: DataFrame) -> dict[str, DataFrame]:
    return {"Household_Matches": household_report(rows)}


BLOCK_ROWS = 10_000  # rows of a block
_BLOCK = "task int, block int, rows long, size long, crc long, packed binary"


def _packed(data: bytes) -> bytes:
    """Deflate blocks without an end, which other blocks may follow and precede."""
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)


def row_blocks(report: DataFrame, text: Callable[[Iterable[tuple]], bytes], *, most: int = BLOCK_ROWS) -> DataFrame:
    """A report's rows as packed blocks of at most ``most`` rows, rendered and compressed by the tasks and staged as Parquet.

    Spark commits the blocks of the attempt that succeeds, so that a lost executor neither loses nor repeats any.  task and
    block give the report's order; size and crc are those of the unpacked text.  Timestamps become strings.
    """
    plain = report.select(*[(F.col(f"`{n}`").cast("string") if t.startswith("timestamp") else F.col(f"`{n}`")).alias(f"c{i}") for i, (n, t) in enumerate(report.dtypes)])
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                data = text(zip(*(c.to_pylist() for c in some.columns), strict=True))
                made = (pa.int32(), task), (pa.int32(), block), (pa.int64(), some.num_rows), (pa.int64(), len(data)), (pa.int64(), zlib.crc32(data)), (pa.binary(), _packed(data))
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for t, v in made], names=names)
                block += 1

    return staged(plain.mapInArrow(run, _BLOCK), "blocks")


def _in_order(blocks: DataFrame) -> Iterator[Row]:
    """Blocks in the report's order; the driver holds those of one partition, compressed."""
    return blocks.orderBy("task", "block").toLocalIterator()


def _cell_text(v: object) -> object:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else v


def _csv_rows(rows: Iterable[Iterable[object]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows([_cell_text(v) for v in row] for row in rows)
    return out.getvalue().encode()


class CsvWriter:
    """One CSV file on the driver that grows by rows or by whole reports, whose text the executors make."""

    def __init__(self, path: str, header: list[str], *, flush_every: int = 5_000):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.file = open(path, "wb")  # noqa: SIM115
        self.rows, self.flush_every = 0, flush_every
        self.file.write(_csv_rows([header]))

    def write(self, row: Iterable[object]) -> None:
        self.file.write(_csv_rows([row]))
        self.rows += 1
        if self.rows % self.flush_every == 0:
            self.file.flush()

    def append(self, report: DataFrame) -> int:
        """Write a report's rows; returns how many this file has now."""
        for block in _in_order(row_blocks(report, _csv_rows)):
            self.file.write(zlib.decompressobj(wbits=-15).decompress(bytes(block["packed"])))
            self.rows += block["rows"]
        self.file.flush()
        return self.rows

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> CsvWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_SHEET_ROWS = 1_048_576  # what a sheet holds (fixed by the format)
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _cell(v: object) -> str:
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and math.isfinite(v):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", "" if v is None else str(v)))}</t></is></c>'


def _sheet_rows(rows: Iterable[Iterable[object]]) -> bytes:
    return "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in rows).encode()


_CRC = 0xEDB88320  # the polynomial of CRC-32, lowest power in the highest bit (fixed)


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo that of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts one after the other, from their own and the second's size: the first's is moved on by 8 * size powers of x."""
    power = 1 << 23  # x ** 8
    while size:
        if size & 1:
            first = _times(first, power)
        power, size = _times(power, power), size >> 1
    return first ^ second


class _Entry:
    """An entry of a zip file that takes text and packed blocks in turn.  Its header is written again when its sizes are known."""

    def __init__(self, book: zipfile.ZipFile, name: str):
        self.book, self.packer = book, zlib.compressobj(wbits=-15)
        self.info = zipfile.ZipInfo(name, time.localtime()[:6])
        self.info.compress_type, self.info.header_offset, self.info.CRC = zipfile.ZIP_DEFLATED, book.fp.tell(), 0
        book.fp.write(self.info.FileHeader(zip64=True))

    def _out(self, packed: bytes, crc: int = 0, size: int = 0) -> None:
        self.book.fp.write(packed)
        self.info.CRC = joined_crc(self.info.CRC, crc, size)
        self.info.file_size += size
        self.info.compress_size += len(packed)

    def write(self, data: bytes) -> None:
        self._out(self.packer.compress(data), zlib.crc32(data), len(data))

    def block(self, packed: bytes, crc: int, size: int) -> None:
        self._out(self.packer.flush(zlib.Z_FULL_FLUSH))
        self._out(packed, crc, size)

    def close(self) -> None:
        self._out(self.packer.flush())
        out, end = self.book.fp, self.book.fp.tell()
        out.seek(self.info.header_offset)
        out.write(self.info.FileHeader(zip64=True))
        out.seek(end)
        self.book.filelist.append(self.info)
        self.book.NameToInfo[self.info.filename] = self.info
        self.book.start_dir = end


class WorkbookWriter:
    """An .xlsx file on the driver, written sheet after sheet, by rows or by whole reports.

    Reports are rendered and compressed by the executors; the driver puts their blocks one behind the other.  Rows beyond what a
    sheet holds go on in a further sheet (name, name_2, ...), which may begin at a block's end, before the last sheet is full.
    """

    def __init__(self, path: str):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.zip, self.names, self.sheet = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), [], None
        self.title, self.header, self.part, self.rows = "", [], 0, 0

    def begin(self, title: str, header: list[str]) -> None:
        """Start a sheet; the one before is complete."""
        self._end()
        self.title, self.header, self.part = title, header, 1
        self._open(title)

    def _open(self, name: str) -> None:
        self.names.append(name[:31])
        self.sheet, self.rows = _Entry(self.zip, f"xl/worksheets/sheet{len(self.names)}.xml"), 1
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode() + _sheet_rows([self.header]))

    def _room(self, rows: int) -> None:
        if self.sheet is None:
            raise ValueError("begin a sheet first")
        if self.rows + rows > _SHEET_ROWS:
            self._end()
            self.part += 1
            self._open(f"{self.title}_{self.part}")
        self.rows += rows

    def write(self, row: Iterable[object]) -> None:
        self._room(1)
        self.sheet.write(_sheet_rows([row]))

    def append(self, report: DataFrame) -> None:
        for block in _in_order(row_blocks(report, _sheet_rows, most=min(BLOCK_ROWS, _SHEET_ROWS - 1))):
            self._room(block["rows"])
            self.sheet.block(bytes(block["packed"]), block["crc"], block["size"])

    def _end(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        """Finish the last sheet and write the parts that list the sheets."""
        self._end()
        if not self.names:
            self.begin("Sheet", [])
            self._end()
        parts = range(1, len(self.names) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in parts)
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in parts)
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(parts, self.names, strict=True))
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        for name, body in {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{sheets}</sheets></workbook>',
        }.items():
            self.zip.writestr(name, head + body)
        self.zip.close()

    def __enter__(self) -> WorkbookWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """All sheets as one .xlsx file on the driver, which only joins what the executors have compressed; for results of many sheets' rows use write_sheets."""
    with WorkbookWriter(path) as book:
        for name, df in sheets.items():
            book.begin(name, df.columns)
            book.append(df)
