import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.config import Settings
from quire.operators import advice, chunks, paging, retrieval, units
from quire.plans import catalog, ingest
from quire.sources import files, sinks
from quire.streaming import ingest as streaming

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(parts):
    def p(text, style=None):
        s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"

    body = ""
    for kind, value in parts:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in value) + "</w:tbl>" if kind == "table" else p(value, "H1" if kind == "heading" else None)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<?xml version="1.0"?><w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    d = tmp_path / "in"
    d.joinpath("a.docx").write_bytes(docx([("heading", "Introduction"), ("p", "First paragraph of the text."), ("table", [["x ", "y"], ["1", "2"]]), ("p", "1.2 Second part"), ("p", "The last one.")]))
    d.joinpath("empty.docx").write_bytes(docx([]))
    d.joinpath("broken.docx").write_bytes(b"no archive")
    d.joinpath("b.TXT").write_bytes("# Größe der Dinge\r\nMore text.\r\n\r\nLast paragraph.".encode())
    d.joinpath("c.md").write_bytes("caf\xe9 latin".encode("latin-1"))
    return d


def test_formats(spark, folder):
    found = files.read_files(spark, str(folder))
    pages = {(r.doc, r.page_number): r for r in files.pages(found).collect()}
    assert len(pages) == 5
    a = pages["a.docx", 1]
    assert a.content == "Introduction\n\nFirst paragraph of the text.\n\nx | y\n1 | 2\n\n1.2 Second part\n\nThe last one." and a.section == "Introduction" and a.source_type == "docx"
    for name in ("empty.docx", "broken.docx"):
        assert pages[name, 1].content == "" and pages[name, 1].language == "unknown" and pages[name, 1].section == "General"
    assert pages["b.TXT", 1].section == "Größe der Dinge" and "\r" not in pages["b.TXT", 1].content and pages["c.md", 1].content == "café latin"


def test_wrong_files(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "none.txt"))
    folder.joinpath("x.exe").write_bytes(b"1")
    with pytest.raises(ValueError, match=r"x\.exe"):
        ingest.ingest(spark, str(folder))
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    pdf = files.read_files(spark, str(tmp_path / "p.pdf"))
    with pytest.raises(Exception, match="no PDF parser"):
        files.pages(pdf).collect()


def test_scanned_pages(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    own = "1.1 Methods: enough readable text on this page"
    parse = lambda _: [(1, own, True, b"i"), (2, "12", True, b"img"), (3, "", False, b""), (4, "34", False, None)]
    seen = files.pages(files.read_files(spark, str(tmp_path / "p.pdf")), parse=parse, engine=lambda image: "Text that was read" if image == b"img" else "").orderBy("page_number").collect()
    assert [(r.source_type, r.content, r.section) for r in seen] == [("pdf", own, "1.1 Methods"), ("scanned_pdf_ocr", "Text that was read", "1.1 Methods"), ("pdf", "", "1.1 Methods"), ("pdf", "34", "1.1 Methods")]
    assert [(r.metadata.needs_ocr, r.metadata.ocr_applied, r.metadata.extraction_method) for r in seen] == [(False, False, "Native"), (True, True, "OCR"), (True, False, "Native"), (True, False, "Native")]
    made = units.paragraph_units(files.pages(files.read_files(spark, str(tmp_path / "p.pdf")), parse=parse, engine=lambda _: "Text that was read"))
    assert {r.ocr_applied for r in chunks.assemble(made).collect()} == {True}


def test_whole_way(spark, folder, tmp_path):
    settings = Settings(semantic_chunking_enabled=False)
    done = ingest.ingest(spark, str(folder), settings)
    rows = {r.document_name: r for r in done.payloads.collect()}
    assert rows["a.docx"].total_chunks == 1 and rows["a.docx"].chunking_strategy == "deterministic_disabled" and rows["empty.docx"].chunking_strategy == "none" and rows["empty.docx"].average_chunk_words == 0.0
    assert rows["b.TXT"].document_type == "txt" and rows["b.TXT"].file_size_bytes == os.path.getsize(folder / "b.TXT") and rows["a.docx"].native_text_pages == 1 and not rows["a.docx"].ocr_used
    place = sinks.write_payloads(done.payloads, str(tmp_path / "out"))
    again = files.read_payload_lines(spark, place)
    assert {r.document_name for r in again.collect()} == rows.keys()
    assert files.chunks_of(again).columns[0] == "chunk_id"
    one = sinks.export_payload(again.where("document_name = 'a.docx'"), str(tmp_path / "one" / "a.json"))
    assert json.load(open(one))["chunks"][0]["chunk_id"] == "a.docx_c0" and files.read_payloads(spark, one).first().total_chunks == 1
    with pytest.raises(ValueError):
        sinks.export_payload(again, str(tmp_path / "two.json"))
    index = sinks.index_payloads(spark, place, str(tmp_path / "index"), retrieval.HashingEmbedder())
    assert index.count() == 3 and sorted(r.pos for r in index.collect()) == [0, 1, 2]
    assert ingest.search(spark, str(tmp_path / "index"), "last paragraph größe", 1).first().document_name == "b.TXT"
    assert files.latest(spark, str(tmp_path / "ind*")).endswith("/index") and files.latest(spark, str(tmp_path / "zzz*")) is None


def test_newest_index(spark, tmp_path):
    spark.conf.set("spark.quire.index_dir", str(tmp_path))
    try:
        assert ingest.search(spark, None, "x").columns == retrieval.RESULT_COLUMNS and ingest.search(spark, None, "x").count() == 0
        index = retrieval.build_index(spark.createDataFrame([(0, "some words")], "pos int, text string"), retrieval.HashingEmbedder())
        retrieval.save_index(index, str(tmp_path / "a"))
        assert ingest.search(spark, None, "words").count() == 1
    finally:
        spark.conf.unset("spark.quire.index_dir")


def test_engines():
    from quire.sources import engines

    if engines.name() == "none":
        assert engines.best(b"picture") == "" and engines.tesseract() is None and engines.rapid() is None


def test_arriving_files(spark, folder, tmp_path):
    run = lambda: streaming.ingest_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), Settings(semantic_chunking_enabled=False), "*.{TXT,md}").awaitTermination(120)
    run()
    read = lambda: {r.document_name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert read() == {"b.TXT", "c.md"}
    folder.joinpath("d.md").write_text("Later text")
    run()
    assert read() == {"b.TXT", "c.md", "d.md"}


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    out = str(tmp_path / "o.json")
    assert cli.main(["ingest", str(folder / "b.TXT"), "-o", out, "--no-semantic"]) == 0 and json.load(open(out))["document_name"] == "b.TXT"
    assert cli.main(["ingest", str(folder / "none.txt")]) == 1 and "error" in capsys.readouterr().err
    assert cli.main(["ingest", str(folder / "b.TXT"), "--chunk-size", "5"]) == 1


def test_settings(spark):
    s = Settings.from_env({"MIN_CHUNK_WORDS": "10", "SEMANTIC_CHUNKING_ENABLED": "false"})
    assert s.min_chunk_words == 10 and not s.semantic_chunking_enabled
    spark.conf.set("spark.quire.target_chunk_words", "99")
    assert Settings.from_session(spark).target_chunk_words == 99
    spark.conf.unset("spark.quire.target_chunk_words")


# Advice


class Scripted:
    name = "scripted"

    def __init__(self, reply=None, up=True):
        self.reply, self.up = reply, up

    def available(self):
        return self.up

    def decide(self, snippets, start):
        if self.reply is None or "trouble" in snippets[0]:
            raise TimeoutError("no answer")
        return advice.parse_reply(self.reply)


def paragraphs(spark, docs, words=60):
    rows = [(d, i, " ".join([t] * words), 1, "General", "txt", False, words) for d, ts in docs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc string, unit_idx int, text string, page_number int, section string, source_type string, ocr_applied boolean, word_count int")


def strategies(df):
    return {(r.document_name, r.metadata.chunking_strategy, r.chunk_index) for r in df.collect()}


def test_router(spark):
    u = paragraphs(spark, {"a": ["cats", "dogs"], "b": ["trouble", "dogs"]})
    budget = chunks.Budget(50, 100, 200, 0, compat=False)
    reply = '{"decisions": [{"paragraph_index": 0, "decision": "continue"}, {"index": 1, "decision": "BREAK"}, {"decision": "BREAK"}, {"index": 5, "decision": "x"}]}'
    assert strategies(advice.route(u, budget, Scripted(reply))) == {("a", "scripted_semantic", 0), ("a", "scripted_semantic", 1), ("b", "deterministic_fallback", 0), ("b", "deterministic_fallback", 1)}
    for advisor in (Scripted(up=False), Scripted(None), Scripted("not json"), Scripted('{"decisions": 3}'), None):
        assert {s for _, s, _ in strategies(advice.route(u, budget, advisor))} == {"deterministic_fallback"}
    assert {s for _, s, _ in strategies(advice.route(u, budget, Scripted(reply), enabled=False))} == {"deterministic_disabled"}
    assert advice.parse_reply(reply) == {0: "CONTINUE", 1: "BREAK"}
    with pytest.raises(ValueError):
        advice.parse_reply("")
    assert not advice.ChatAdvisor("http://127.0.0.1:9").available()


def test_last_window_wins(spark):
    answers = spark.createDataFrame([("a", 0, 3, "BREAK"), ("a", 1, 3, "CONTINUE"), ("a", 0, 4, "BREAK"), ("b", 0, None, "failed: x")], "doc string, place int, unit_idx int, decision string")
    assert {tuple(r) for r in advice.merged(answers).collect()} == {("a", 3, "CONTINUE"), ("a", 4, "BREAK")}


def test_windows(spark):
    u = paragraphs(spark, {"a": ["x"] * 12, "b": ["x"] * 3, "c": ["x"], "d": ["x"] * 7}, 100)
    got = {}
    for r in advice.windows(u, 250).orderBy("doc", "place").collect():
        got.setdefault(r.doc, []).append((r.start, len(r.snippets)))
    assert got == {"a": [(0, 5), (3, 5), (6, 5), (9, 3)], "b": [(0, 3)], "d": [(0, 5), (3, 4)]}


# Retrieval


def test_index(spark, tmp_path):
    e = retrieval.HashingEmbedder()
    rows = [(0, "same_id", "machine learning of models"), (1, "same_id", "cooking of pasta"), (2, None, None), (3, "", "weather today")]
    index = retrieval.build_index(spark.createDataFrame(rows, "pos int, chunk_id string, text string"), e)
    got = {r.pos: r for r in index.collect()}
    assert [got[i].chunk_id for i in range(4)] == ["same_id", "same_id_dup1", "chunk_2", "chunk_3"] and got[1].page_number == 1 and got[1].section == "General" and got[1].language == "unknown" and got[2].text == ""
    assert all(len(r.embedding) == 384 and abs(sum(x * x for x in r.embedding) - 1) < 1e-4 for r in got.values())
    for k, n in ((1, 1), (3, 3), (10, 4), (0, 0), (-1, 0)):
        assert retrieval.retrieve(index, "learning models", e, k).count() == n
    best = retrieval.retrieve(index, "learning models", e, 2).collect()
    assert best[0].chunk_id == "same_id" and len(best[0]) == 18 and best[0].text == best[0].original_text
    assert retrieval.retrieve(index, "learning models", e, 4, 0.999).count() == 0
    for q in (None, "", "  "):
        assert retrieval.retrieve(index, q, e).count() == 0
    assert retrieval.retrieve(index.limit(0), "x", e).count() == 0
    place = retrieval.save_index(index, str(tmp_path / "i"))
    assert [r.score for r in retrieval.retrieve(retrieval.load_index(spark, place), "learning models", e).collect()] == [r.score for r in retrieval.retrieve(index, "learning models", e).collect()]
    with pytest.raises(FileNotFoundError):
        retrieval.load_index(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"rubbish")
    with pytest.raises(RuntimeError):
        retrieval.load_index(spark, str(tmp_path / "bad"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(RuntimeError):
        retrieval.load_index(spark, str(tmp_path / "other"))


def test_batches_in_blocks(spark, monkeypatch):
    v = spark.range(60).select(F.col("id").alias("pos"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3)]).alias("embedding"))
    q = v.where("pos < 20").select(F.col("pos").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, retrieval.top_k_batch(v, q, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, retrieval.top_k_batch(v, q, 4).collect())) == whole and len(whole) == 80


def test_page_limits(spark):
    df = spark.createDataFrame([("a", "x" * 2500), ("b", "y" * 2501), ("c", None), ("d", " " * 10)], "doc string, text string")
    got = {(r.doc, r.page_number): r for r in paging.paginate_text(df).collect()}
    assert set(got) == {("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1)} and got["b", 2].content == "y" and got["d", 1].metadata.char_count == 10 and got["b", 2].metadata.total_pages == 2


def test_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("quire.llm.")] + ["quire.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)


def test_catalog():
    import __spark_entry__ as entry

    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line_passes_engines(monkeypatch, tmp_path):
    """OCR is on unless it is switched off, and an installed PDF parser is used."""
    from quire import cli
    from quire.sources import engines

    seen = []

    def ingest(spark, path, settings, advisor, parse, engine):
        seen.append((parse, engine))
        raise ValueError("far enough")

    monkeypatch.setattr(cli, "_session", lambda: None)
    monkeypatch.setattr(cli.Settings, "from_session", classmethod(lambda cls, spark: cls()))
    monkeypatch.setattr(cli.ingest, "ingest", ingest)
    parser = lambda content: [(1, "text", False, None)]
    monkeypatch.setattr(engines, "pdf_parser", lambda: parser)
    assert cli.main(["ingest", "a.pdf", "--no-semantic"]) == 1 and cli.main(["ingest", "a.pdf", "--no-semantic", "--no-ocr"]) == 1
    assert seen == [(parser, engines.best), (parser, None)]
