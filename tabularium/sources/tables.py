"""Text-first readers: every cell of CSV files and workbooks stays as it was written."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabularium.functions.names import col, quoted
from tabularium.functions.roles import is_identifier
from tabularium.operators.reshape import summary_rows
from tabularium.sources.books import files_of

SEPARATORS = (";", ",", "\t", "|")
ROW, SHEET = "_src_row", "_src_sheet"
#: Zip guard of workbooks: unpacked bytes and their ratio to the packed ones.
LARGEST_UNPACKED, LARGEST_RATIO = 250_000_000, 120
# Words that headers of business tables are made of.
HEADER_WORDS = ("fecha", "monto", "venta", "costo", "cantidad", "producto", "categoria", "cliente", "canal", "sucursal", "vendedor", "total", "precio", "codigo", "id", "nombre", "estado", "sku", "date", "amount")


def bare(text: object) -> str:
    found = unicodedata.normalize("NFKD", str(text))
    return "".join(c for c in found if not unicodedata.combining(c)).lower().strip()


def outside_quotes(line: str, mark: str) -> int:
    """How often mark stands in the line outside of quoted text."""
    return re.sub(r'"(?:[^"]|"")*"?', "", line).count(mark)


def sniff_separator(lines: list[str]) -> str:
    """The separator that stands in all lines equally often; the more frequent one of several."""
    lines = [x for x in lines if x.strip()][:8]
    best, score = ",", 0
    for mark in SEPARATORS:
        counts = [outside_quotes(line, mark) for line in lines]
        if counts and counts[0]:
            now = counts[0] * (100 if min(counts) == max(counts) else 1)
            if now > score:
                best, score = mark, now
    return best


def unique_headers(names: list[object]) -> list[str]:
    """Trimmed, single spaces, columna_n where empty, _2 for names equal but for accents and case."""
    out, seen = [], {}
    for i, name in enumerate(names):
        text = re.sub(r"\s+", " ", str(name if name is not None else "")).strip() or f"columna_{i + 1}"
        key = bare(text)
        seen[key] = seen.get(key, 0) + 1
        out.append(text if seen[key] == 1 else f"{text}_{seen[key]}")
    return out


# The share of filled cells that a header has, and the weights of its score.
HEADER_FILLED, HEADER_UNIQUE, HEADER_WORD, HEADER_DATA = 0.6, 3, 2, 3
DATA_CELL = re.compile(r"\s*[()$]?\s*-?(?:\d[\d.,]*|(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+)\s*%?\s*\)?|\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[T ].*)?")


def header_row(rows: list[list[str]]) -> int:
    """The header among the first ten rows: mostly filled, different texts, business words, no data.

    Rows with fewer than two texts, or less than 60 % of the cells filled, are titles and no headers. Two candidates
    one below the other settle a header of two levels; the earlier row wins a tie. Without a candidate it is row 0.
    """
    width = max((len(r) for r in rows), default=0)
    found: list[tuple[float, int]] = []
    for i, row in enumerate(rows[:10] if width > 1 else []):
        cells = [c.strip() for c in row if c and c.strip()]
        if len(cells) < 2 or len(cells) < HEADER_FILLED * width:
            continue
        unique = len({c.casefold() for c in cells}) / len(cells)
        words = sum(any(re.search(rf"\b{w}", bare(c).replace("_", " ")) for w in HEADER_WORDS) for c in cells) / len(cells)
        data = sum(bool(DATA_CELL.fullmatch(c)) for c in cells) / len(cells)
        found.append((HEADER_UNIQUE * unique + HEADER_WORD * words - HEADER_DATA * data, i))
        if len(found) >= 2 and found[-2][1] == i - 1:
            break
    return max(found, key=lambda x: (x[0], -x[1]))[1] if found else 0


def csv_dialect(spark: SparkSession, path: str) -> dict[str, str | bool]:
    """separator, encoding (UTF-8, UTF-16 by its byte-order mark, else latin-1) and whether records span lines; one scan."""
    lines = spark.read.text(path)
    head = [r for r in lines.select("value", F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("mark")).limit(8).collect()]
    if head and head[0]["mark"] in ("FFFE", "FEFF"):
        text = "\n".join(r[0] for r in spark.read.option("encoding", "UTF-16").option("multiLine", True).option("sep", "\x00").csv(path).limit(8).fillna("").collect())
        return {"separator": sniff_separator(text.split("\n")), "encoding": "UTF-16", "spans_lines": True}
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = lines.agg(F.max((~F.is_valid_utf8("value")).cast("int")).alias("broken"), F.max((quotes % 2 == 1).cast("int")).alias("open")).first()
    encoding = "ISO-8859-1" if seen["broken"] else "UTF-8"
    return {"separator": sniff_separator([r["value"] for r in head]), "encoding": encoding, "spans_lines": bool(seen["open"])}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, first byte, lines) of consecutive lines of one split of a file."""
    for batch in batches:
        edge = [True, *pc.or_(*(pc.not_equal(batch.column(n).slice(1), batch.column(n).slice(0, batch.num_rows - 1)) for n in ("file", "at"))).to_pylist()] if batch.num_rows else []
        starts = [i for i, new in enumerate(edge) if new]
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.column("file")[start].as_py(), batch.column("at")[start].as_py(), batch.slice(start, stop - start)


def _opened(odd: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For lines with an odd number of quotes or not: whether each starts inside quoted text, and its record's first line.

    A record that began before these lines has -1.
    """
    before = (np.cumsum(odd) - odd + inside) % 2 == 1
    return before, np.maximum.accumulate(np.where(before, -1, np.arange(len(odd))))


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split says: its lines, their parity of quotes, and for both ways to start the line of a record left open."""
    found: dict[tuple[str, int], list] = {}
    for file, at, lines in _chunks(batches):
        odd = lines.column("quotes").to_numpy() % 2
        held = found.setdefault((file, at), [0, 0, -1, -1])
        for way in (0, 1):
            inside = (way + held[1]) % 2 == 1
            before, first = _opened(odd, inside)
            still = (inside + odd.sum()) % 2 == 1
            if not still:
                held[2 + way] = -1
            elif first[-1] >= 0:
                held[2 + way] = held[0] + int(first[-1])
        held[0], held[1] = held[0] + len(odd), int((held[1] + odd.sum()) % 2)
    rows = [(*key, *values) for key, values in found.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "at", "n", "odd", "even_open", "odd_open"), r)) for r in rows], SURVEY)


SURVEY = pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("odd", pa.int64()), ("even_open", pa.int64()), ("odd_open", pa.int64())])


def _folded(surveys: list) -> dict[tuple[str, int], tuple[int, bool, int]]:
    """(file, first byte of a split) -> (its first line in the file, whether it starts inside quotes, that record's line)."""
    out, file, line, inside, record = {}, None, 0, False, -1
    for r in sorted(surveys, key=lambda r: (r["file"], r["at"])):
        if r["file"] != file:
            file, line, inside, record = r["file"], 0, False, -1
        out[r["file"], r["at"]] = (line, inside, record)
        opened = r["odd_open"] if inside else r["even_open"]
        inside ^= bool(r["odd"])
        record = (line + opened if opened >= 0 else record) if inside else -1
        line += r["n"]
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the records of CSV files, with the line of its file (from 0) on which each starts.

    Quoted cells may hold line ends. Each split counts its lines and quotes; the driver adds up one row a split, which
    tells every split whether it starts inside quotes and in which record. Lines of records that take several meet in a
    group by record; all others stay where they are.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", quotes.cast("long").alias("quotes"))
    starts = _folded(lines.select("file", "at", "quotes").mapInArrow(_surveyed, "file string, at long, n long, odd long, even_open long, odd_open long").collect())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = dict(starts)
        for file, at, rows in _chunks(batches):
            line, inside, record = now[file, at]
            odd = rows.column("quotes").to_numpy() % 2
            before, first = _opened(odd, inside)
            first = np.where(first < 0, record, first + line)
            closed = (before + odd) % 2 == 0
            now[file, at] = (line + len(odd), not closed[-1], int(first[-1]))
            several = (first != np.arange(len(odd)) + line) | ~closed
            yield pa.RecordBatch.from_pydict({"file": rows.column("file"), "line": pa.array(np.arange(len(odd)) + line), "record": pa.array(first), "several": pa.array(several), "value": rows.column("value")})

    placed = lines.mapInArrow(numbered, "file string, line long, record long, several boolean, value string")
    alone = placed.where("NOT several").select("file", "line", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))
    joined = placed.where("several").groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    return alone.unionByName(joined.withColumnRenamed("record", "line"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _line, their place from 0 in the order they are read; only one count a partition reaches the driver."""
    place = rows.withColumns({"_p": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = {r["_p"]: r["n"] for r in place.groupBy("_p").agg((F.max("_n") + 1).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.try_element_at(F.create_map(*starts), F.col("_p")) if starts else F.lit(0)
    return place.withColumn("_line", start + F.col("_n")).drop("_p", "_n")


def _decoded(text: Column, encoding: str) -> Column:
    return text if encoding.upper() in ("UTF-8", "UTF8") else F.decode(text.cast("binary"), encoding)


def read_csv(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV files as text columns with _src_row, the line of its file on which a record starts; blanks are null, words like None stay text.

    Separator and encoding are found out unless given. The header line is read as it is written, so names that repeat
    or are empty get their numbers here. All files of a folder must have one header, which is no row of any. Records
    may span lines; every file is read in parallel but UTF-16 ones, a task each. ``columns`` keeps only those.
    """
    said = csv_dialect(spark, path)
    separator, encoding = separator or said["separator"], encoding or said["encoding"]
    how = {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "nullValue": ""}
    if encoding.upper().startswith("UTF-16"):
        whole = spark.read.options(**how, encoding=encoding, multiLine=True, header=False).csv(path).withColumn("_at", F.monotonically_increasing_id())
        first = whole.limit(1).collect()
        names = [v for v in first[0][:-1]] if first else []
        headers = unique_headers([str(n or "").lstrip("\ufeff") for n in names])
        frame = whole.where("_at > 0").select(*[F.col(f"_c{i}").alias(h) for i, h in enumerate(headers)], (F.col("_at") + 1).cast("long").alias(ROW))
    else:
        files = spark.read.text(path).select("_metadata.file_path").distinct().limit(2).count()
        if said["spans_lines"] or files > 1:
            lines = records(spark, path)
        else:
            lines = _numbered(spark.read.text(path)).select(F.lit("").alias("file"), F.col("_line").alias("line"), F.col("value").alias("text"))
        lines = lines.withColumn("text", _decoded(F.col("text"), encoding))
        tops = {r["text"].lstrip("\ufeff") for r in lines.where("line = 0").select("text").distinct().limit(2).collect()}
        if len(tops) > 1:
            raise ValueError("the files of the folder have different headers")
        headers = unique_headers(next(csv.reader(io.StringIO(tops.pop(), newline=""), delimiter=separator), []) if tops else [])
        schema = ", ".join(f"{quoted(h)} STRING" for h in headers) or "_none STRING"
        parsed = F.from_csv("text", schema, {k: str(v) for k, v in how.items()})
        frame = lines.where("line > 0").select(parsed.alias("x"), (F.col("line") + 1).cast("long").alias(ROW)).select("x.*", ROW)
    if not headers:
        return spark.createDataFrame([], f"{ROW} long")
    filled = F.coalesce(*[col(c) for c in headers])
    kept = [h for h in headers if columns is None or h in columns]
    return frame.where(filled.isNotNull()).select(*[col(h) for h in kept], ROW)


@dataclass(frozen=True)
class Loaded:
    frame: DataFrame
    report: dict  # separator, encoding, sheet, sheets, title rows and total rows left out, warnings


def load_table(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None) -> Loaded:
    """A CSV file, or a sheet of a workbook (the fullest unless named), without the totals at its end, and what was done."""
    report: dict = {"sheet": None, "sheets": [], "title_rows": 0, "total_rows": 0, "warnings": []}
    if path.lower().endswith(".csv"):
        report |= csv_dialect(spark, path)
        frame = read_csv(spark, path, report["separator"], report["encoding"])
    else:
        found = read_workbook(spark, path)
        if not found or sheet is not None and sheet not in found:
            raise ValueError(f"no sheet {sheet!r} with data")
        size = {n: df.count() * len(df.columns) for n, df in found.items()} if sheet is None else {sheet: 1}
        chosen = max(size, key=lambda n: (size[n], n))
        frame = found[chosen]
        report |= {"sheet": chosen, "sheets": list(found)}
        first = frame.agg(F.min(ROW)).first()[0]
        report["title_rows"] = max(0, (first or 2) - 2)
    body = summary_rows(frame.select(*[c for c in frame.columns if c != SHEET]), ROW)
    kept = frame.join(body.select(ROW), ROW, "left_semi") if SHEET in frame.columns else body
    report["total_rows"] = frame.count() - kept.count()
    if report["total_rows"]:
        report["warnings"].append(f"{report['total_rows']} rows of totals at the end were left out")
    own = [c for c in frame.columns if c in (ROW, SHEET) or columns is None or c in columns]
    return Loaded(kept.select(*[col(c) for c in own]), report)


# ---- workbooks

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def open_workbook(path: str) -> zipfile.ZipFile:
    """The workbook's archive, in whatever store it lies; refused if it would unpack to far more than it is."""
    files, place = files_of(path)
    book = zipfile.ZipFile(files.open_input_file(place))
    unpacked, packed = sum(i.file_size for i in book.infolist()), sum(i.compress_size for i in book.infolist())
    if unpacked > LARGEST_UNPACKED or unpacked > LARGEST_RATIO * max(packed, 1) and unpacked > 1_000_000:
        raise ValueError("the workbook unpacks to more than is allowed")
    return book


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> part of the archive, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{_LINKS}id")]
        found[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_ROW = re.compile(rb"<(?:\w+:)?row[\s>/]")
#: Bytes of a worksheet's markup that a task reads.
RANGE_BYTES = 8_000_000
# Built-in formats of dates and times.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}
DAY_ZERO = datetime(1899, 12, 30)


def _said(text: str | None) -> str:
    """Text of the archive, with what markup cannot hold put back."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text or "")


@lru_cache(maxsize=2)
def _shared(path: str, size: int) -> list[str]:
    """The strings that a book's cells share; read once a worker, and only if a cell needs one."""
    found: list[str] = []
    with open_workbook(path) as book:
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for _, item in ElementTree.iterparse(stream):
                    if item.tag == f"{_MAIN}si":
                        runs = [t for child in item if child.tag != f"{_MAIN}rPh" for t in child.iter(f"{_MAIN}t")]
                        found.append(_said("".join(t.text or "" for t in runs)))
                        item.clear()
    return found


@lru_cache(maxsize=8)
def _date_styles(path: str, size: int) -> frozenset[int]:
    """Numbers of the cell styles that show dates."""
    with open_workbook(path) as book:
        if "xl/styles.xml" not in book.namelist():
            return frozenset()
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
    dated = {n for n, code in own.items() if re.search(r"[dy]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower())} | DATE_FORMATS
    formats = styles.find(f"{_MAIN}cellXfs")
    return frozenset(i for i, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId", 0)) in dated)


def _day(text: str) -> str:
    """The date, or date and time, that a spreadsheet's number of days stands for."""
    try:
        when = DAY_ZERO + timedelta(seconds=round(float(text) * 86_400))
    except (ValueError, OverflowError):
        return text
    return when.date().isoformat() if (when.hour, when.minute, when.second) == (0, 0, 0) else when.isoformat(sep=" ")


def _markup(book: zipfile.ZipFile, part: str, low: int, high: int) -> bytes:
    """The rows of a worksheet whose markup starts between two bytes, as one element of their own."""
    with book.open(part) as stream:
        head = stream.read(min(4096, book.getinfo(part).file_size))
        opened = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", head)
        if opened is None:
            return b""
        stream.seek(low)
        held, block = bytearray(), b" "
        while len(held) < high - low and (block := stream.read(1 << 20)):
            held += block
        first = _ROW.search(held)
        if first is None or low + first.start() >= high:
            return b""
        while (last := _ROW.search(held, max(high - low, first.end()))) is None and (block := stream.read(1 << 18)):
            held += block
    end = last.start() if last else re.search(rb"</(?:\w+:)?sheetData>|\Z", held[first.start() :]).start() + first.start()
    name = re.match(rb"<([\w:]+)", opened[0])[1]
    return opened[0].rstrip(b"/>").rstrip() + b">" + bytes(held[first.start() : end]) + b"</" + name + b">"


def cells_of(path: str, part: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(row, column, text, formula) of each written cell of the rows whose markup starts between two bytes."""
    with open_workbook(path) as book:
        size, whole = sum(i.file_size for i in book.infolist()), book.getinfo(part).file_size
        data = _markup(book, part, low, whole if high is None else high)
    dated, place = _date_styles(path, size), 0
    for _, row in ElementTree.iterparse(io.BytesIO(data)) if data else ():
        if row.tag != f"{_MAIN}row":
            continue
        place, at = int(row.get("r") or place + 1), -1
        for c in row.iter(f"{_MAIN}c"):
            kind, value, formula = c.get("t"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
            at = _column_number(c.get("r")) if c.get("r") else at + 1
            text = value.text if value is not None else None
            if kind == "s" and text is not None:
                text = _shared(path, size)[int(text)]
            elif kind == "inlineStr":
                text = _said("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
            elif kind == "str" and text is not None:
                text = _said(text)
            elif kind == "b" and text is not None:
                text = "TRUE" if text == "1" else "FALSE"
            elif text is not None and kind in (None, "n") and int(c.get("s") or 0) in dated:
                text = _day(text)
            yield place, at, text, formula.text if formula is not None else None
        row.clear()


def _ranges(path: str, sheet: str | None, range_bytes: int) -> list[_Sheet]:
    """The parts of the archive that tasks read; a worksheet whose rows have no numbers is one."""
    found = []
    with open_workbook(path) as book:
        for name, part in sheets_of(book).items():
            if sheet in (None, name):
                size = book.getinfo(part).file_size
                with book.open(part) as stream:
                    first = re.search(rb"<(?:\w+:)?row\b[^>]*>", stream.read(65_536))
                n = -(-size // range_bytes) if first and re.search(rb"\br=", first[0]) else 1
                found += [_Sheet(name, part, i * size // n, (i + 1) * size // n) for i in range(max(n, 1))]
    if not found:
        raise ValueError(f"no sheet {sheet!r}")
    return found


class _Sheet(InputPartition):
    def __init__(self, name: str, part: str, low: int, high: int):
        self.name, self.part, self.low, self.high = name, part, low, high


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, range_bytes: int):
        self.path, self.sheet, self.range_bytes = path, sheet, range_bytes

    def partitions(self) -> list[_Sheet]:
        return _ranges(self.path, self.sheet, self.range_bytes)

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        for row, column, text, formula in cells_of(self.path, partition.part, partition.low, partition.high):
            yield partition.name, row, column, text, formula


class Workbook(DataSource):
    """format("workbook"): (sheet, row, column, text, formula) of every cell, a range of a sheet's rows a partition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row int, column int, text string, formula string"

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), int(self.options.get("range_bytes", RANGE_BYTES)))


class SheetReader(DataSourceReader):
    """Rows of one sheet; cells outside the columns asked for and rows that fail an equality are not sent."""

    def __init__(self, path: str, sheet: str, places: dict[str, int], equal: dict[int, str], below: int, range_bytes: int):
        self.path, self.sheet, self.places, self.equal, self.below, self.range_bytes = path, sheet, places, equal, below, range_bytes

    def partitions(self) -> list[_Sheet]:
        return _ranges(self.path, self.sheet, self.range_bytes)

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        order = {place: i for i, place in enumerate(self.places.values())}
        wanted = list(self.equal.items())
        now, cells = None, {}
        for row, column, text, _ in cells_of(self.path, partition.part, partition.low, partition.high):
            if row != now:
                if cells and all(cells.get(place) == value for place, value in wanted):
                    yield self._row(now, cells, order)
                now, cells = row, {}
            if row > self.below and text is not None and text.strip():
                cells[column] = text
        if cells and all(cells.get(place) == value for place, value in wanted):
            yield self._row(now, cells, order)

    def _row(self, row: int, cells: dict[int, str], order: dict[int, int]) -> tuple:
        return (*(cells.get(place) for place in order), row, self.sheet)


class SheetSource(DataSource):
    """format("sheet"): the rows of one worksheet below its header, as text."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        names = json.loads(self.options["places"])
        return T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(ROW, T.IntegerType()), T.StructField(SHEET, T.StringType())])

    def reader(self, schema: T.StructType) -> SheetReader:
        o = self.options
        equal = {int(place): value for place, value in json.loads(o.get("equal", "{}")).items()}
        return SheetReader(o["path"], o["sheet"], json.loads(o["places"]), equal, int(o["below"]), int(o.get("range_bytes", RANGE_BYTES)))


@dataclass(frozen=True)
class SheetShape:
    headers: list[str]
    row: int  # the header's, 0 without any cell
    dimension: str | None
    merged: list[str]
    titles: list[str] = field(default_factory=list)  # texts above the header


def sheet_shape(path: str, name: str) -> SheetShape:
    """A sheet's headers, the row they stand on, its stated dimension and merged ranges; its first rows and its end are read."""
    with open_workbook(path) as book:
        part = sheets_of(book)[name]
        size = book.getinfo(part).file_size
        with book.open(part) as stream:
            head = stream.read(65_536)
        tail = b""
        with book.open(part) as stream:
            stream.seek(max(0, size - 262_144))
            tail = stream.read()
    stated = re.search(rb'<(?:\w+:)?dimension\b[^>]*\bref="([^"]+)"', head)
    merged = [m.decode() for m in re.findall(rb'<(?:\w+:)?mergeCell\b[^>]*\bref="([^"]+)"', tail)]
    lines: dict[int, dict[int, str]] = {}
    for low in range(0, size, 262_144):
        for row, column, text, _ in cells_of(path, part, low, min(low + 262_144, size)):
            if text is not None and text.strip():
                lines.setdefault(row, {})[column] = text
        if len(lines) > 10:
            break
    top = sorted(lines)[:10]
    if not top:
        return SheetShape([], 0, stated[1].decode() if stated else None, merged)
    last = re.fullmatch(r"[A-Z]+\d+:([A-Z]+)\d+", stated[1].decode()) if stated else None
    width = 1 + max(*(max(lines[r]) for r in lines), _column_number(last[1]) if last else 0)
    table = [[lines[r].get(i, "") for i in range(width)] for r in top]
    at = header_row(table)
    titles = [lines[r][c] for r in top[:at] for c in sorted(lines[r])]
    return SheetShape(unique_headers(table[at]), top[at], stated[1].decode() if stated else None, merged, titles)


def workbook_headers(path: str) -> dict[str, list[str]]:
    """Sheet name -> headers, without reading the rows."""
    with open_workbook(path) as book:
        names = list(sheets_of(book))
    return {name: shape.headers for name in names if (shape := sheet_shape(path, name)).headers}


def read_workbook(
    spark: SparkSession, path: str, sheets: list[str] | None = None, columns: list[str] | None = None, equal: dict[str, str] | None = None, range_bytes: int = RANGE_BYTES
) -> dict[str, DataFrame]:
    """Sheet name -> text table with _src_row and _src_sheet; the header is found, dates read as dates.

    A sheet is read by as many tasks as it has ranges of ``range_bytes`` of markup. ``columns`` keeps only those, and
    ``equal`` only the rows with these texts; both are decided in the reader, so other cells and rows are never sent.
    They are arguments because a filter pushed by the planner would stay with the frame for its later uses. A sheet
    without one of equal's columns has no such rows. Sheets without any cell are left out. Headers named like the two
    added columns get a number.
    """
    spark.dataSource.register(Workbook)
    spark.dataSource.register(SheetSource)
    with open_workbook(path) as book:
        names = [n for n in sheets_of(book) if sheets is None or n in sheets]
    found = {}
    for name in names:
        shape = sheet_shape(path, name)
        if not shape.row:
            continue
        headers = unique_headers([ROW, SHEET, *shape.headers])[2:]
        places = {h: i for i, h in enumerate(headers) if columns is None or h in columns}
        wanted = {headers.index(c) if c in headers else -1: value for c, value in (equal or {}).items()}
        how = {"path": path, "sheet": name, "places": json.dumps(places), "equal": json.dumps(wanted), "below": shape.row, "range_bytes": range_bytes}
        found[name] = spark.read.format("sheet").options(**how).load()
    return found


def formulas(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, column, formulas, volatile): how many cells of each column are formulas, and such that change by themselves."""
    spark.dataSource.register(Workbook)
    cells = spark.read.format("workbook").option("path", path).load().where("formula IS NOT NULL")
    volatile = F.col("formula").rlike(VOLATILE)
    return cells.groupBy("sheet", "column").agg(F.count("*").alias("formulas"), F.count(F.when(volatile, 1)).alias("volatile"))


#: Functions whose result changes by itself.
VOLATILE = r"(?i)\b(?:now|today|rand|randbetween|offset|indirect)\("


def formula_notes(spark: SparkSession, path: str, sheet: str, examples: int = 5) -> tuple[DataFrame, list[str]]:
    """(column, formulas, volatile, fixed, identifier, examples) of a sheet's columns with formulas, and warnings.

    Only rows below the header and columns with a header count. fixed are filled cells without a formula; a column
    that has both may change when the book is opened again, and so may one of formulas alone. Volatile formulas in a
    column of identifiers make ids that are not stable. Cells are counted in one aggregate by column.
    """
    spark.dataSource.register(Workbook)
    shape = sheet_shape(path, sheet)
    schema = "column string, formulas long, volatile long, fixed long, identifier boolean, examples array<string>"
    if not shape.row:
        return spark.createDataFrame([], schema), []
    cells = spark.read.format("workbook").options(path=path, sheet=sheet).load().where((F.col("row") > shape.row) & (F.col("column") < len(shape.headers)))
    is_formula = F.col("formula").isNotNull()
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.when(is_formula, F.struct("row", F.left("formula", F.lit(300)).alias("f"))))), 1, examples), lambda x: F.concat(F.lit("="), x["f"]))
    counted = cells.groupBy("column").agg(
        F.count(F.when(is_formula, 1)).alias("formulas"), F.count(F.when(is_formula & F.col("formula").rlike(VOLATILE), 1)).alias("volatile"),
        F.count(F.when(~is_formula & (F.coalesce(F.col("text"), F.lit("")) != ""), 1)).alias("fixed"), listed.alias("examples"),
    ).where("formulas > 0")
    rows = [(shape.headers[r["column"]], r["formulas"], r["volatile"], r["fixed"], is_identifier(shape.headers[r["column"]]), r["examples"]) for r in counted.orderBy("column").collect()]
    said = []
    for name, n, volatile, fixed, identifier, _ in rows:
        said.append(f"{name}: {n} cells are formulas{' among fixed values' if fixed else ''}; they may change when the book is opened again")
        if identifier and volatile:
            said.append(f"{name}: {volatile} volatile formulas in a column of identifiers; its ids are not stable")
    return spark.createDataFrame(rows, schema), said


def sheet_profile(frame: DataFrame, name: str, sample: int = 60) -> tuple[str, list[str]]:
    """(datos, auxiliar or ambigua, reasons) from the name and the density of the first rows."""
    columns = [c for c in frame.columns if c not in (ROW, SHEET)]
    rows = frame.orderBy(ROW).limit(sample).select(*[col(c) for c in columns]).collect()
    density = sum(v is not None and str(v).strip() != "" for r in rows for v in r) / max(1, len(rows) * len(columns))
    if re.search(r"\b(leeme|readme|instrucc|portada|resumen|dashboard|grafico|parametro|indice)", bare(name)):
        return "auxiliar", ["its name says so"]
    reasons = [text for bad, text in ((density < 0.35, "few cells are filled"), (len(columns) < 2, "it has one column"), (len(rows) < 5, "it has few rows")) if bad]
    return ("datos" if not reasons else "auxiliar" if len(reasons) > 1 else "ambigua"), reasons
