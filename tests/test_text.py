from pyspark.sql import functions as F

from quire.functions import lang, ocr, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def test_native_quality(spark):
    q = lambda t: one(spark, t, text.native_quality)
    assert not q("").usable and not q(None).usable and not q(" \n").usable
    assert q("abcdefghij" + "1" * 23).usable and not q("abcdefghij" + "1" * 24).usable
    assert q("abcd efgh " + "1 " * 30).usable and not q("Scanned by CamScanner 12\n").usable
    assert q("Scanned  by\tCAMSCANNER x\nreadable text here").clean == "readable text here"


def test_normalize(spark):
    t = " a  b\r\n c\t d \r\n\r\n\n<div class='x'>e</div>\n \n<pre>f</pre>\n\nScanned by CamScanner\n"
    assert one(spark, t, text.normalize_native) == "a b\nc d\n\ne\n\nf"
    assert one(spark, "", text.normalize_native) == "" and one(spark, None, text.normalize_native) is None


def test_words_of_unicode(spark):
    t = " a b\x1cc 　"
    assert one(spark, t, text.words) == ["a", "b", "c"] and one(spark, t, text.word_count) == 3 and one(spark, t, text.strip) == "a b\x1cc"


def test_sentences_and_windows(spark):
    assert one(spark, "One. Two!  Three? चार। Five: six", text.sentences) == ["One.", "Two!", "Three?", "चार।", "Five: six"]
    assert one(spark, " ".join("abcdefg"), lambda c: text.word_windows(c, 3)) == ["a b c", "d e f", "g"]
    assert one(spark, "", lambda c: text.word_windows(c, 3)) == []


def test_sections(spark):
    for t, want in [("UNIT II Intro", "UNIT II Intro"), ("UNIT I Intro", "page"), ("1. Intro text", "page"), ("1 Intro text", "1 Intro text"), ("x\n## Two words: y", "Two words")]:
        assert one(spark, t, lambda c: text.unit_section(c, F.lit("page"))) == want
    assert one(spark, "# A title that goes on " + "x" * 50, text.txt_section) == ("A title that goes on " + "x" * 50)[:41]
    assert one(spark, "text\n1.2 Methods: more", text.pdf_section) == "1.2 Methods" and one(spark, "none", text.pdf_section) is None
    heading = lambda t: one(spark, t, lambda c: text.is_docx_heading(c, F.lit(False)))
    assert heading("1.2 Intro") and not heading("1. Intro") and heading("chapter 3 of it") and not heading("UNIT IV " + "w " * 12)


def test_markup(spark):
    assert one(spark, "List<T> <b class='q'>x</b> class = \"y z\"", text.without_markup) == "List x"
    assert one(spark, "a <b and c> d", text.without_markup) == "a  d"
    assert one(spark, "<b>x</b><span>y</span>", text.without_block_markup) == "<b>x</b>y"


def test_previews(spark):
    assert one(spark, "a\nb", text.preview) == "a b" and one(spark, None, text.preview) == "<no readable text>" and len(one(spark, "x" * 200, text.preview)) == 100
    assert one(spark, "x" * 301, text.snippet) == "x" * 300 + "..." and one(spark, None, text.embedding_text) == " "
    assert one(spark, [["a ", "b"], ["c"]], text.table_text, "array<array<string>>") == "a | b\nc"


def test_ocr(spark):
    assert one(spark, "srate", ocr.corrected) == "states" and one(spark, "state", ocr.corrected) == "states" and one(spark, "estate", ocr.corrected) == "estate"
    readable = lambda t: one(spark, t, ocr.is_readable_line)
    assert not readable("A1 + B2") and not readable("x = y") and readable("The sum = 5")
    assert one(spark, [("a", 0.6), ("b", 0.5), (" ", 0.9), (None, 0.9), ("c", None)], ocr.confident_lines, "array<struct<text:string,score:double>>") == ["a"]
    assert one(spark, "one\ntwo.\nthree", ocr.reflow) == "one two.\nthree"


def test_languages(spark):
    assert one(spark, "क" * 10 + "த" * 40, lambda c: lang.script(c, 10)) == "hi" and one(spark, "क" * 9, lambda c: lang.script(c, 10)) is None
    en = "this is the text of a book that was written by one person and it is for all of the people with time to read it"
    de = "das ist der Text von dem Buch und die Leute mit Zeit lesen nicht auf der Bank, das ist für ein Kind zu viel"
    assert one(spark, en, lang.language) == "en" and one(spark, de, lang.language) == "de" and one(spark, "zu kurz", lang.language) == "en"
    assert one(spark, de, lambda c: lang.chunk_language(c, F.lit("fr"), F.array(F.lit("en")))) == "fr"
    assert one(spark, de, lambda c: lang.chunk_language(c, F.lit("fr"), F.lit(None).cast("array<string>"))) == "de"
    assert one(spark, "TA", lang.language_name) == "Tamil" and one(spark, "xx", lang.language_name) == "XX"


def test_document_shares(spark):
    from quire.operators import languages

    found = spark.createDataFrame([("a", 1, 0, "en", 105), ("a", 1, 1, "hi", 141), ("a", 1, 2, "ta", 148), ("b", 1, 0, "en", 92), ("b", 1, 1, "de", 8), ("c", 1, 0, "en", 9201), ("c", 1, 1, "de", 799)], "doc string, page int, para int, lang string, weight int")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc string")
    got = {r.doc: r for r in languages.analyze(docs, found).collect()}
    assert got["a"].summary_display == "Tamil (ta) — 38%, Hindi (hi) — 36%, English (en) — 27%" and got["a"].primary_language == "ta"
    assert [tuple(x) for x in got["a"].breakdown] == [("ta", 37.6), ("hi", 35.8), ("en", 26.6)]
    assert got["b"].detected_languages == ["en", "de"] and got["b"].summary_display == "English (en)" and got["c"].detected_languages == ["en"]
    assert [tuple(x) for x in got["d"].breakdown] == [("en", 100.0)] and not got["d"].is_multilingual


def test_labels(spark):
    kind = "array<struct<lang:string,pct:double>>"
    assert one(spark, [("en", 95.0), ("fr", 5.0)], lang.shown_label, kind) == "English (en) - 95%, French (fr) - 5%"
    assert one(spark, [("xx", 100.0)], lang.shown_label, kind) == "XX (xx)"
    assert one(spark, 1234567, text.thousands, "int") == "1,234,567"
    assert one(spark, "llama3.2_semantic", text.strategy_label) == "Semantic (advised)" and one(spark, "deterministic_fallback", text.strategy_label) == "Deterministic (fallback)"


def test_ocr_texts(spark):
    """What the rules give for the literal rows of the catalog, written down by hand."""
    from quire.plans import catalog

    clean = {1: "The states of the machines\nfinite states and more\npath", 2: "states", 3: "the transition goes on", 4: "", 5: "", 6: "Line one\nline two\nline three", 7: "abThis is it, &his not", 8: "अ हिंदी पाठ"}
    flowed = {1: "This line goes on here.\nNew one\n- bullet after it", 2: "He said \"yes.\"\nThen\n\nPara two ends;\nx", 3: "1.2 Heading body\nNOTE: x", 4: "", 5: ""}
    made = {r.id: r.x for r in catalog.rows(spark, catalog.OCR_TEXTS, "id int, t string").select("id", ocr.sanitize(F.col("t")).alias("x")).collect()}
    assert {i: made[i] for i in clean} == clean
    made = {r.id: r.x for r in catalog.rows(spark, catalog.REFLOW, "id int, t string").select("id", ocr.reflow(F.col("t")).alias("x")).collect()}
    assert {i: made[i] for i in flowed} == flowed
