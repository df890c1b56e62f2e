import random
import struct

import pytest
from pyspark.sql import functions as F

from textreuse.sources import files, office

TEXT = "First paragraph, “quoted” – with é.\n\n日本語の段落 🙂 と text.\n\tLast\x01 one\x07."
WANTED = "First paragraph, “quoted” – with é.\n\n日本語の段落 🙂 と text.\n\n\tLast one."


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_pieces_and_scattered_sectors(seed, piece):
    """Pieces of both widths, also through the middle of a sign of two units; sectors in any order; long and short streams."""
    mixed = random.Random(seed).shuffle if seed else None
    assert office.doc_text(office.doc_file(TEXT, piece, "\rnotes and headers", mixed)) == WANTED
    long = "\n".join(f"{i} {TEXT}" for i in range(300))
    assert office.doc_text(office.doc_file(long, piece * 50, placed=mixed)) == files.docx_text(office.docx_file(long))


def test_a_table_beyond_the_header():
    """More than 109 sectors of the allocation table (7 MB): the rest is listed in a chain."""
    text = "é" * 9_000_000
    content = office.doc_file(text)
    assert struct.unpack_from("<I", content, 72)[0] >= 1
    assert office.doc_text(content) == text


def test_fields_cells_and_odd_files():
    assert office.visible("a\x13 HYPERLINK \x13 x \x14y\x15 \x14shown\x15 b\x07cell\r\r\x0cnext\x0bline\x1ehyphen\x1f") == "ashown b\n\ncell\n\nnext\nline-hyphen"
    assert office.visible("\r \r") is None and office.visible("\x15a\x14") == "a"
    assert office.doc_text(office.docx_file("one\n\ntwo")) == "one\n\ntwo"
    assert office.doc_text(office.doc_file("")) is None
    good = office.doc_file("Some text. " * 1000)
    locked = bytearray(good)
    locked[locked.index(b"\xec\xa5\xc1\0") + office.AT_FLAGS + 1] |= 1
    for broken, why in ((b"", "compound"), (b"plain", "compound"), (good[:3000], "beyond|cut off|chain"), (bytes(locked), "encrypted"), (office.compound_file({"Other": b"x"}), "Word")):
        with pytest.raises(ValueError, match=why):
            office.doc_text(broken)
    circle = bytearray(good)
    fat = struct.unpack_from("<I", good, 76)[0]
    struct.pack_into("<128I", circle, 512 * (fat + 1), *([0] * 128))
    with pytest.raises(ValueError):
        office.doc_text(bytes(circle))


def test_broken_files_fail_alone(spark):
    good = office.doc_file(TEXT)
    rows = [("a.doc", good), ("b.doc", good[:700]), ("c.doc", b""), ("d.doc", office.docx_file(TEXT)), ("e.docx", office.docx_file(TEXT))]
    f = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.filename: r for r in files.parse_files(f, "p").select("filename", "status", "text", F.col("error_message").alias("why")).collect()}
    assert got["a.doc"].text == got["d.doc"].text == got["e.docx"].text == WANTED.strip()
    assert got["b.doc"].status == got["c.doc"].status == "failed" and "ValueError" in got["c.doc"].why
