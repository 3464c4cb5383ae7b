"""Workbooks and series matrices written by hand and read by tasks."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from ostinato.sources import readers, sheets


def letters(i):
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, tables, dimension=True):
    """Sheets of rows; texts go to the shared table, but those that begin with = stay in their cells."""
    shared, parts = [], []
    for rows in tables.values():
        out = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = f"{letters(c)}{r}"
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif v.startswith("="):
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v[1:]}</t></is></c>')
                else:
                    if v not in shared:
                        shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>')
            if cells:
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
        size = f'<dimension ref="A1:{letters(max(map(len, rows)) - 1)}{len(rows)}"/>' if dimension else ""
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{size}<sheetData>{"".join(out)}</sheetData></worksheet>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        for i, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", p)


@pytest.mark.parametrize(("rows", "dimension"), [(50_000, True), (7, True), (7, False)])
def test_sheet(spark, tmp_path, rows, dimension):
    body = [[f"g{i}", i / 4, None if i % 5 == 0 else "=x & y".replace("&", "and"), i % 2 == 0] for i in range(40)]
    path = str(tmp_path / "a.xlsx")
    workbook(path, {"first": [["gene", "value", "note", "flag", "value"], *body, [None] * 4, ["last", "no number", None, None, 7]], "other": [["a"], [1]]}, dimension)
    sheets.register(spark)
    df = spark.read.format("sheet").option("rows", rows).load(path)
    assert dict(df.dtypes) == {"gene": "string", "value": "double", "note": "string", "flag": "string", "value_4": "double"} or dict(df.dtypes)["value"] == "string"
    got = {r.gene: r for r in df.collect()}
    assert len(got) == 41 and got["g5"].note is None and got["g6"].note == "x and y" and got["g6"].flag == "true"
    assert df.rdd.getNumPartitions() == (7 if rows == 7 and dimension else 1) and got["last"].value_4 == 7.0
    assert [r.a for r in spark.read.format("sheet").option("sheet", "other").load(path).collect()] == [1.0]
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("sheet").option("sheet", "none").load(path).count()


def test_condition_pair_of_workbooks(spark, tmp_path):
    hours, names = (0, 6, 12), ["a", "b", "c", "d"]
    head = ["gene", *[f"CT{h}_{r}.{k}" for k in ("raw", "normalized") for h in hours for r in "AB"]]
    wt = [head] + [[g, *[1000.0] * 6, *[10.0 * i + h + (r == "B") for h in hours for r in "AB"]] for i, g in enumerate(names)]
    ko = [head] + [[g, *[5.0 * i + h for h in hours for r in "AB"], *[-1.0] * 6] for i, g in enumerate(names[1:])]
    workbook(tmp_path / "wt.xlsx", {"s": wt})
    workbook(tmp_path / "ko.xlsx", {"s": ko})
    first, second = (readers.workbook(spark, str(tmp_path / f"{k}.xlsx")) for k in ("wt", "ko"))
    got = {r.series_id: r for r in readers.condition_pair(first, second, readers.NORMALISED, floor_percentile=0.0, second_pattern=readers.RAW).collect()}
    assert set(got) == {"b", "c", "d"} and got["c"].t_wt == [0.0, 6.0, 12.0] and got["c"].y_wt == [20.5, 26.5, 32.5] and got["c"].y_ko == [5.0, 11.0, 17.0]


MATRIX = '!Series_title\t"x"\n!Sample_title\t"liver CT18"\t"liver CT22"\n!Sample_organism\t"m"\t"m"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n' + "".join(f'"p{i}"\t{i}.5\t{"null" if i % 7 == 0 else i}\n' for i in range(300)) + '"short"\t1\n!series_matrix_table_end\n'


@pytest.mark.parametrize("packed", [False, True])
def test_series_matrix_source(spark, tmp_path, packed):
    path = tmp_path / ("m.txt.gz" if packed else "m.txt")
    (gzip.open if packed else open)(path, "wt").write(MATRIX)
    sheets.register(spark)
    df = spark.read.format("series_matrix").option("bytes", 100).load(str(path))
    assert df.columns == ["probe", "S1", "S2"] and df.rdd.getNumPartitions() == (1 if packed else -(-len(MATRIX) // 100))
    got = {r.probe: (r.S1, r.S2) for r in df.collect()}
    assert df.count() == 301 and got == {**{f"p{i}": (i + 0.5, None if i % 7 == 0 else float(i)) for i in range(300)}, "short": (1.0, None)}
    about = spark.read.format("series_matrix").option("part", "samples").load(str(path))
    titles = {r.sample: r.value for r in about.where("attribute = 'title'").collect()}
    assert titles == {"S1": "liver CT18", "S2": "liver CT22"}
    notes = spark.createDataFrame([(f"p{i}", f"g{i}") for i in range(300)], "probe string, symbol string")
    study = readers.array_study(df.where(F.col("S2").isNotNull()), titles, notes, floor_percentile=None, least=0.0)
    assert {r.series_id: (r.t, r.y) for r in study.collect()}["g8"] == ([18.0, 22.0], [8.5, 8.0])
