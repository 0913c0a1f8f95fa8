"""Workbooks written in tasks: each task deflates the rows it holds, the commit joins their bytes into one archive.

Rows become the markup of a worksheet by SQL functions. Each task compresses runs of consecutive rows as pieces of one
deflate stream beside the target; the commit puts pieces of a sheet one after the other, between its head and its foot,
and works out their checksum from the pieces' checksums. The driver sees names, sizes and checksums, and streams bytes
that are compressed already; no row reaches it.
"""

from __future__ import annotations

import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tabularium.durable import written
from tabularium.functions.names import col, fresh

#: Rows of a worksheet and characters of a cell that spreadsheets can open, letters of a sheet's name.
SHEET_ROWS, CELL_CHARS, NAME_CHARS = 1_048_576, 32_767, 31
# Formats of cells in the order of their styles, and fills of marked cells.
FORMATS = ("text", "whole", "decimal", "date", "moment", "header")
PLAIN, CHANGED, REVIEW = 0, 1, 2
_FILLS = {CHANGED: "FFFFF2CC", REVIEW: "FFF8CBAD"}
_NUMBER_FORMATS = {"text": 49, "whole": 3, "decimal": 4, "date": 164, "moment": 165, "header": 49}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE, _DOCUMENT = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@dataclass(frozen=True)
class Sheet:
    """A frame as a worksheet. ``row`` orders it; marks (row, column, mark) colour cells CHANGED or REVIEW by that row.

    kinds says of text columns that they hold numbers ("numero") or days ("fecha"): cells that read as such, in plain
    digits or as yyyy-mm-dd, are written typed, all others stay text.
    """

    frame: DataFrame
    row: str | None = None
    marks: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)


def letters(n: int) -> str:
    """The name of column n (from 0)."""
    out = ""
    while True:
        out = chr(65 + n % 26) + out
        n = n // 26 - 1
        if n < 0:
            return out


_CONTROLS = [chr(c) for c in range(32) if c not in (9, 10)] + ["\ufffe", "\uffff"]


def _text(value: Column) -> Column:
    """Text as markup: what markup cannot hold is written as _xHHHH_, and so is text that looks like that."""
    safe = F.regexp_replace(value, r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    held = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"_x{ord(x):04X}_")), _CONTROLS, safe)
    safe = F.when(safe.rlike(r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"), held).otherwise(safe)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    too_long = F.raise_error(F.concat(F.lit(f"a cell has more than {CELL_CHARS} characters: "), F.left(value, F.lit(40)))).cast("string")
    return F.when(F.length(value) > CELL_CHARS, too_long).otherwise(safe)


def _cell(value: Column, kind: T.DataType, place: Column, mark: Column, said: str | None = None) -> Column:
    """The markup of a cell; null cells are left out. Values that a spreadsheet has no number for are text."""
    style = lambda name: (F.lit(FORMATS.index(name)) + mark * len(FORMATS)).cast("string")
    opened = lambda name, more="": F.concat(F.lit('<c r="'), place, F.lit('" s="'), style(name), F.lit(f'"{more}>'))
    text = F.concat(opened("text", ' t="inlineStr"'), F.lit('<is><t xml:space="preserve">'), _text(value.cast("string")), F.lit("</t></is></c>"))
    number = lambda name, x: F.concat(opened(name), F.lit("<v>"), x.cast("string"), F.lit("</v></c>"))
    if said == "numero" and isinstance(kind, T.StringType):
        whole = F.when(value.rlike(r"^(?:0|-?[1-9]\d{0,14})$"), number("whole", value))
        made = whole.when(value.rlike(r"^-?(?:0|[1-9]\d{0,12})\.\d{1,2}$"), number("decimal", value)).otherwise(text)
    elif said == "fecha" and isinstance(kind, T.StringType):
        day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
        made = F.when(day >= "1900-03-01", number("date", F.datediff(day, F.lit("1899-12-30").cast("date")))).otherwise(text)
    elif isinstance(kind, T.BooleanType):
        made = F.concat(opened("text", ' t="b"'), F.lit("<v>"), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        made = number("whole", value)
    elif isinstance(kind, T.LongType):
        made = F.when(F.abs(value) < 10**15, number("whole", value)).otherwise(text)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        made = F.when(F.isnan(value) | (F.abs(value) == float("inf")), text).otherwise(number("decimal", value))
    elif isinstance(kind, T.DecimalType):
        made = number("decimal", value) if kind.precision <= 15 else text
    elif isinstance(kind, T.DateType):
        made = F.when(value >= "1900-03-01", number("date", F.datediff(value, F.lit("1899-12-30").cast("date")))).otherwise(text)
    else:
        made = text
    return F.coalesce(made, F.lit(""))


def _rows(sheet: Sheet, place: int, split: bool) -> tuple[DataFrame, list[int]]:
    """(sheet, line, xml) of a sheet's rows, and how many rows each of its worksheets has."""
    frame, names = sheet.frame, sheet.frame.columns
    part, n, marked, at = fresh([*names, *(sheet.marks.columns if sheet.marks is not None else [])], "_part", "_n", "_marks", "_at")
    rows = frame
    if sheet.marks is not None:
        marks = sheet.marks.toDF("r", "c", "m").where("c IS NOT NULL").groupBy("r", "c").agg(F.max("m").alias("m"))
        marks = marks.groupBy(F.col("r").alias(at)).agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias(marked))
        rows = rows.join(marks, col(sheet.row).cast("string") == col(at).cast("string"), "left").drop(at)
    if sheet.row:
        rows = rows.orderBy(col(sheet.row))
    rows = written(rows.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(n)))
    sizes = sorted((r[part], r["c"]) for r in rows.groupBy(part).agg((F.max(n) + 1).alias("c")).collect())
    starts, total = [], 0
    for p, size in sizes:
        starts += [F.lit(p), F.lit(total)]
        total += size
    if total >= SHEET_ROWS and not split:
        raise ValueError("a sheet has more rows than spreadsheets open; write it as CSV, or split it")
    line = (F.element_at(F.create_map(*starts), col(part)) if starts else F.lit(0)) + col(n)
    whole = rows.withColumn(at, line.cast("long"))
    body = SHEET_ROWS - 1
    own, number = F.floor(col(at) / body).cast("int"), (F.pmod(col(at), F.lit(body)) + 2).cast("string")
    mark = lambda c: F.coalesce(F.try_element_at(col(marked), F.lit(c)).cast("int"), F.lit(PLAIN)) if sheet.marks is not None else F.lit(PLAIN)
    cells = [_cell(col(f.name), f.dataType, F.concat(F.lit(letters(i)), number), mark(f.name), sheet.kinds.get(f.name)) for i, f in enumerate(frame.schema.fields)]
    xml = F.concat(F.lit('<row r="'), number, F.lit('">'), *cells, F.lit("</row>"))
    parts = max(1, -(-total // body))
    return whole.select((own + place).alias("sheet"), F.pmod(col(at), F.lit(body)).alias("line"), xml.alias("xml")), [min(body, total - i * body) for i in range(parts)]


def write_book(sheets: dict[str, DataFrame | Sheet], path: str, split: bool = False) -> None:
    """A workbook of typed, styled worksheets with frozen headers and filters, written in tasks.

    path lies where driver and executors can write. Longer sheets than spreadsheets open are refused before anything is
    written or, with split, go on in further worksheets. Texts longer than a cell holds are refused, never cut.
    Null cells are empty; numbers that lose digits as doubles, and dates before March 1900, are written as text.
    """
    made, frames, taken = [], [], set()
    for name, sheet in sheets.items():
        sheet = sheet if isinstance(sheet, Sheet) else Sheet(sheet)
        rows, sizes = _rows(sheet, len(made), split)
        frames.append(rows)
        for i, size in enumerate(sizes):
            end = f" ({i + 1})" if i else ""
            shown = name[: NAME_CHARS - len(end)] + end
            while shown.lower() in taken:
                shown = shown[: NAME_CHARS - 1] + "_" if len(shown) == NAME_CHARS else shown + "_"
            taken.add(shown.lower())
            made.append({"name": shown, "columns": sheet.frame.columns, "rows": size})
    if not made:
        raise ValueError("a workbook has a sheet")
    spark = frames[0].sparkSession
    spark.dataSource.register(BookSink)
    rows = reduce(DataFrame.union, frames)
    rows.write.format("book").mode("append").options(path=path, sheets=json.dumps(made)).save()


@dataclass
class Pieces(WriterCommitMessage):
    found: list[tuple[int, int, str, int, int, int]]  # sheet, first line, file, bytes unpacked, bytes packed, checksum


def files_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _deflated(data: bytes, last: bool = False) -> bytes:
    """A piece of a raw deflate stream that ends at a whole byte, so that pieces can follow each other."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the second's size: size zero bytes are a
    linear map of the first's register, found by squaring."""
    power = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    bits = size * 8
    while bits:
        if bits & 1:
            first = _times(power, first)
        power = [_times(power, row) for row in power]
        bits >>= 1
    return first ^ second


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sheets: list[dict]):
        self.path, self.sheets, self.folder = path, sheets, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Pieces:
        files, folder = files_of(self.folder)
        files.create_dir(folder, recursive=True)
        found, now, held, size = [], None, [], 0

        def done() -> None:
            if held:
                data = b"".join(held)
                packed, name = _deflated(data), f"{folder}/{uuid.uuid4().hex}"
                with files.open_output_stream(name, compression=None) as out:
                    out.write(packed)
                found.append((now[0], now[1], name, len(data), len(packed), zlib.crc32(data)))

        expected = None
        for batch in batches:
            for sheet, line, xml in zip(*(batch.column(n).to_pylist() for n in ("sheet", "line", "xml"))):
                if (sheet, line) != expected or size > 8_000_000:
                    done()
                    now, held, size = (sheet, line), [], 0
                held.append(xml.encode())
                size += len(held[-1])
                expected = (sheet, line + 1)
        done()
        return Pieces(found)

    def commit(self, messages: list[Pieces | None]) -> None:
        files, _ = files_of(self.path)
        _, target = files_of(self.path)
        pieces = sorted(p for m in messages if m is not None for p in m.found)
        with files.open_output_stream(target, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _parts(self.sheets).items():
                book.writestr(name, text)
            for i, sheet in enumerate(self.sheets):
                self._add(book, files, f"xl/worksheets/sheet{i + 1}.xml", sheet, [p for p in pieces if p[0] == i])
        self._forget()

    def _add(self, book: zipfile.ZipFile, files: pa.fs.FileSystem, name: str, sheet: dict, pieces: list[tuple]) -> None:
        head, foot = (text.encode() for text in _ends(sheet))
        ends = [(head, _deflated(head)), (foot, _deflated(foot, last=True))]
        entry = zipfile.ZipInfo(name)
        entry.compress_type, entry.CRC = zipfile.ZIP_DEFLATED, zlib.crc32(head)
        for _, _, _, size, _, crc in pieces:
            entry.CRC = joined_crc(entry.CRC, crc, size)
        entry.CRC = joined_crc(entry.CRC, zlib.crc32(foot), len(foot))
        entry.file_size = sum(len(data) for data, _ in ends) + sum(p[3] for p in pieces)
        entry.compress_size = sum(len(packed) for _, packed in ends) + sum(p[4] for p in pieces)
        entry.header_offset = book.fp.tell()
        book.fp.write(entry.FileHeader())
        book.fp.write(ends[0][1])
        for piece in pieces:
            with files.open_input_stream(piece[2], compression=None) as data:
                while block := data.read(1 << 20):
                    book.fp.write(block)
        book.fp.write(ends[1][1])
        book.filelist.append(entry)
        book.NameToInfo[name] = entry
        book.start_dir, book._didModify = book.fp.tell(), True

    def abort(self, messages: list[Pieces | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        files, folder = files_of(self.folder)
        if files.get_file_info(folder).type == pa.fs.FileType.Directory:
            files.delete_dir(folder)


def _ends(sheet: dict) -> tuple[str, str]:
    """What stands before and after a worksheet's rows: a frozen header with names, and a filter over all columns."""
    header, last = FORMATS.index("header"), letters(max(len(sheet["columns"]) - 1, 0))
    escaped = [escape("".join(f"_x{ord(c):04X}_" if c in _CONTROLS else c for c in name)) for name in sheet["columns"]]
    cells = "".join(f'<c r="{letters(i)}1" s="{header}" t="inlineStr"><is><t xml:space="preserve">{name}</t></is></c>' for i, name in enumerate(escaped))
    widths = "".join(f'<col min="{i}" max="{i}" width="{min(max(len(name) + 4, 12), 40)}" customWidth="1"/>' for i, name in enumerate(sheet["columns"], 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    reach = f"A1:{last}{sheet['rows'] + 1}"
    return (
        f'{_HEAD}<worksheet xmlns="{_MAIN}"><dimension ref="{reach}"/>{view}{f"<cols>{widths}</cols>" if widths else ""}<sheetData><row r="1">{cells}</row>',
        f'</sheetData>{f"""<autoFilter ref="{reach}"/>""" if widths else ""}</worksheet>',
    )


def _styles() -> str:
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    fills += "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in ("FFD9E1F2", *_FILLS.values()))
    made = []
    for mark in (PLAIN, CHANGED, REVIEW):
        for name in FORMATS:
            fill = {PLAIN: 2 if name == "header" else 0, CHANGED: 3, REVIEW: 4}[mark]
            made.append(f'<xf numFmtId="{_NUMBER_FORMATS[name]}" fontId="{int(name == "header")}" fillId="{fill}" borderId="0" xfId="0" applyNumberFormat="1" applyFill="1"/>')
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts>'
        f'<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="5">{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(made)}">{"".join(made)}</cellXfs></styleSheet>'
    )


def _parts(sheets: list[dict]) -> dict[str, str]:
    """The archive's parts besides the worksheets."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
    named = "".join(f'<sheet name={quoteattr(s["name"])} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    links += f'<Relationship Id="rId{len(sheets) + 1}" Type="{_DOCUMENT}/styles" Target="styles.xml"/>'
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets>{named}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
        "xl/styles.xml": _styles(),
    }


class BookSink(DataSource):
    """format("book"): (sheet, line, xml) rows of worksheets into one workbook."""

    @classmethod
    def name(cls) -> str:
        return "book"

    def schema(self) -> str:
        return "sheet int, line long, xml string"

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], json.loads(self.options["sheets"]))
