"""The workbook reader holds a bounded number of rows and elements."""

import io
import tracemalloc
import zipfile

import pyarrow as pa

from tabulon.sources import workbooks as W

_BOOK = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _book(rows):
    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="C{i}" t="inlineStr"><is><t>t{i}</t></is></c></row>' for i in range(1, rows + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**_BOOK, "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"}.items():
            z.writestr(name, text)
    return out.getvalue()


def test_rows_of_a_large_sheet_are_not_held():
    files = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [_book(60_000), _book(3)]})
    tracemalloc.start()
    sizes, last = [], None
    for batch in W._cells_of_batches(iter([files])):
        sizes.append(len(batch))
        last = batch
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * 60_003 and max(sizes) <= 4_000
    assert last.to_pylist()[-1] == {"path": "b", "sheet": "Data", "row": 3, "col": 3, "raw": "s", "value": "t3", "formula": None, "num_fmt": None, "rows": 1, "cols": 1}
    assert peak < 12e6
