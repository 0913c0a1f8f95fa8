"""CSV files in parallel: quoted line ends at every cut, folders, headers as written, byte-order marks."""

import csv
import io

import pytest

from tabularium.sources import tables

TEXT = 'id;Nota;Nota;\n1;"dos\nlíneas; ""sí""";x;\n2;plain;y;z\n3;"a\n\nb\n";"c\nd";\n\n4;;"";"q"\n5;"only ""quotes""";e;f\n'


@pytest.fixture
def split_at(spark):
    """Sets how many bytes a split of a file has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size)), spark.conf.set(names[1], "1"), spark.conf.set(names[2], "1")

    yield set_to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain(text):
    """{line: cells} by Python's reader; blank cells are None, rows of them go."""
    reader, rows, start = csv.reader(io.StringIO(text, newline=""), delimiter=";"), {}, 1
    for n, row in enumerate(reader):
        cells = [c.strip() or None for c in row]
        if n and any(cells):
            rows[start] = cells
        start = reader.line_num + 1
    return rows


@pytest.mark.parametrize("size", [3, 7, 16, 41, 1000])
def test_records_that_span_lines_at_any_cut(spark, tmp_path, split_at, size):
    path = tmp_path / "notas.csv"
    path.write_text(TEXT, encoding="utf-8")
    split_at(size)
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["id", "Nota", "Nota_2", "columna_4", tables.ROW]
    found = {r[tables.ROW]: [v if v is None else v.strip() for v in r[:4]] for r in df.collect()}
    assert found == {n: (cells + [None] * 4)[:4] for n, cells in plain(TEXT).items()}
    assert size > 100 or df.rdd.getNumPartitions() > 1


def test_folders_and_headers(spark, tmp_path):
    for name, rows in (("a", "1;2"), ("b", "3;4\na;b"), ("c", '"5\n5";6')):
        (tmp_path / f"{name}.csv").write_text(f"a;b\n{rows}\n")
    found = sorted((r["a"], r["b"], r[tables.ROW]) for r in tables.read_csv(spark, str(tmp_path)).collect())
    assert found == [("1", "2", 2), ("3", "4", 2), ("5\n5", "6", 2), ("a", "b", 3)]
    (tmp_path / "d.csv").write_text("a;c\n1;2\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "latin-1"])
def test_byte_order_marks(spark, tmp_path, encoding):
    path = tmp_path / "x.csv"
    path.write_bytes("Año;Monto;Monto\n2025;ñ;3\n".encode(encoding))
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["Año", "Monto", "Monto_2", tables.ROW] and tuple(df.first()) == ("2025", "ñ", "3", 2)


def test_empty_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("")
    assert tables.read_csv(spark, str(path)).count() == 0
    path.write_text("a;b\n")
    assert tables.read_csv(spark, str(path)).columns == ["a", "b", tables.ROW]
