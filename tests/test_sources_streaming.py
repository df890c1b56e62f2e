import io
import zipfile

from pyspark.sql import functions as F

from textreuse.plans.compare import compare_projects
from textreuse.sources import files
from textreuse.sources.catalog import Catalog
from textreuse.streaming.ingest import Store, dedup_scores, stream_compare, stream_files

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def make(tmp_path):
    (tmp_path / "a.txt").write_bytes("hello  \n\n\n\n\nwörld\n\n".encode() + b"\xff")
    (tmp_path / "b.docx").write_bytes(docx("one", "", "two"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.xyzzy").write_bytes(b"?")
    (tmp_path / "README").write_bytes(b"plain name")
    return str(tmp_path)


def test_read_documents(spark, tmp_path):
    got = {r.filename: r for r in files.read_documents(spark, make(tmp_path), "p").collect()}
    assert got["a.txt"].text == "hello\n\n\nwörld" and got["a.txt"].status == "completed" and got["a.txt"].title == "a"
    assert got["b.docx"].text == "one\n\ntwo" and got["README"].text == "plain name"
    assert got["c.docx"].status == got["d.xyzzy"].status == "failed" and "BadZipFile" in got["c.docx"].error_message
    f = files.read_files(spark, str(tmp_path))
    ok, bad = files.upload_filter(f, 20)
    assert {r.reason for r in bad.collect()} == {"unsupported type", "too large"}
    assert ok.count() == 1
    assert files.document_info(f).where("supported").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    para = "This is a paragraph that is long enough to be compared with others, number {}."
    rows = [(i, "\n".join(para.format(n) for n in ((i % 3), 7, i)), "en", "p") for i in range(6)]
    src = tmp_path / "in"
    schema = "doc_id long, text string, lang string, source string"
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    stream_compare(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ["left_document_id", "right_document_id", "group_count", "top_score"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    want = sorted(tuple(r) for r in compare_projects(spark.createDataFrame(rows, schema)).select(*cols).collect())
    assert got == want and len(got) == 15 and any(r[2] for r in got)
    # a text is cut with its document and signed with the first batch that has it, whatever is stored by then
    chunked, signed = (spark.read.parquet(str(tmp_path / "store" / n)) for n in ("chunks", "signatures"))
    assert chunked.count() == 18 and signed.count() == signed.select("text_hash").distinct().count() == chunked.select("text_hash").distinct().count()
    before = {n: sorted(map(str, spark.read.parquet(str(tmp_path / "store" / n)).collect())) for n in ("documents", "chunks", "signatures", "bands")}
    Store(spark, str(tmp_path / "store")).ingest(spark.createDataFrame(rows[2:4], schema), 1)  # once more
    assert before == {n: sorted(map(str, spark.read.parquet(str(tmp_path / "store" / n)).collect())) for n in before}


def test_ingest_of_odd_batches(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    store = Store(spark, str(tmp_path))
    store.ingest(spark.createDataFrame([], schema), 0)
    store.ingest(spark.createDataFrame([(1, None, "en", "p"), (2, "", "en", "p"), (3, "One paragraph that is long enough.", "en", "p"), (4, "One paragraph that is long enough.", "en", "q")], schema), 1)
    store.ingest(spark.createDataFrame([(5, "One paragraph that is long enough.", "en", "p")], schema), 2)
    assert [store.upto(n, 2).count() for n in ("documents", "chunks", "signatures", "bands")] == [5, 3, 2, 80]
    assert store.upto("chunks", 1).count() == 2 and store.upto("nothing", 2) is None


def test_stream_files_and_scores(spark, tmp_path):
    make(tmp_path)
    q = stream_files(spark, str(tmp_path), "p").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").where("status = 'completed'").count() == 3
    rows = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "c", 3)], "left_hash string, right_hash string, s int").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "scores"))
    q = dedup_scores(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "scores"))).writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scores").count() == 2


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "p", "completed"), (2, "p", "pending"), (3, "q", "completed")], "doc_id long, project_id string, status string")
    c.write("document", docs)
    assert c.read("document", project_id="p", status="completed").count() == 1
    c.write("document", docs.where("project_id = 'q'").withColumn("status", F.lit("failed")), mode="overwrite")
    assert sorted((r.doc_id, r.status) for r in c.read("document").collect()) == [(1, "completed"), (2, "pending"), (3, "failed")]
    c.replace("document", c.read("document").where("doc_id <> 1"))
    assert c.read("document").count() == 2


def test_a_replacement_that_stops_half_way(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, "p", "completed") for i in ids], "doc_id long, project_id string, status string")
    ids = lambda: sorted(r.doc_id for r in c.read("document").collect())
    c.replace("document", rows(1))  # a first write
    assert ids() == [1]
    (tmp_path / "document").rename(tmp_path / "_old_document")  # stopped before anything new was complete
    assert ids() == [1]
    c.write("document", rows(2, 3))
    (tmp_path / "document").rename(tmp_path / "_new_document")  # stopped between the two renames
    c.replace("document", c.read("document").where("doc_id <> 2"))
    assert ids() == [1, 3] and not (tmp_path / "_old_document").exists() and not (tmp_path / "_new_document").exists()


def test_few_parsed_files_are_held_at_once(spark):
    """A parser that says how many of its results are still held."""
    state = {}

    def counting(content):
        import weakref

        if not state:
            state["kind"], state["alive"] = type("Held", (str,), {}), weakref.WeakSet()
        made = state["kind"](f"{len(state['alive'])} held")
        state["alive"].add(made)
        return made

    rows = spark.range(1000).coalesce(1).selectExpr("concat(id, '.txt') path", "encode('x', 'UTF-8') content")
    held = files.parse_files(rows, "p", parsers={"text": counting}).select("text").collect()
    assert len(held) == 1000 and max(int(r.text.split()[0]) for r in held) <= 200
