import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, units
from tests.model import chunks as modelled

UNIT = "doc string, unit_idx int, text string, page_number int, section string, source_type string, ocr_applied boolean, word_count int"


def table(spark, docs):
    return spark.createDataFrame([(d, i, u["text"], u["page"], u["section"], "txt", u["ocr"], len(u["text"].split())) for d, us in docs.items() for i, u in enumerate(us)], UNIT)


def found(df):
    out = {}
    for r in df.orderBy("document_name", "chunk_index").collect():
        assert r.chunk_id == f"{r.document_name}_c{r.chunk_index}" and r.word_count == len(r.text.split()) and r.char_count == len(r.text)
        assert r.char_end - r.char_start == r.char_count and r.metadata.page_start == r.page_number
        out.setdefault(r.document_name, []).append((r.text, r.page_number, r.section, r.ocr_applied, r.char_start))
    return out


def compare(got, docs, decisions=None, **budget):
    for d, us in docs.items():
        want = modelled(us, None if decisions is None else decisions.get(d, {}), **budget)
        assert got[d] == [(c["text"], c["page"], c["section"], c["ocr"], c["start"]) for c in want], d


def random_docs(seed, n=25):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bb", "ccc", "end.", "so!", "<b>", "class='x'", "List<T>", "é"])
    docs = {}
    for d in range(n):
        us = []
        for i in range(rnd.randint(1, 25)):
            head = rnd.choice(["", "", "", "", "CHAPTER 3 ", "Unit IV ", "section 12\n"])
            us.append({"text": (head + " ".join(word() for _ in range(rnd.choice([1, 3, 9, 20, 45, 90])))).strip(), "page": i // 3 + 1, "section": f"s{i // 4}", "ocr": rnd.random() < 0.05})
        docs[f"d{d}"] = us
    return docs


@pytest.mark.parametrize("budget", [(30, 50, 80, 10), (30, 50, 80, 0), (5, 12, 20, 30), (0, 40, 60, 5), (210, 260, 400, 40)])
@pytest.mark.parametrize("advised", [False, True])
def test_fold_equals_the_loop(spark, budget, advised):
    docs = random_docs(sum(budget))
    b = dict(zip(("low", "target", "high", "overlap"), budget, strict=True))
    decisions = {d: {i: "BREAK" if i % 3 == 0 else "CONTINUE" for i in range(len(us))} for d, us in docs.items()} if advised else None
    table_ = spark.createDataFrame([(d, i, x) for d, m in (decisions or {"none": {0: "BREAK"}}).items() for i, x in m.items()], "doc string, unit_idx int, decision string")
    got = found(chunks.assemble(table(spark, docs), chunks.Budget(*budget), table_ if advised else None))
    compare(got, docs, decisions, **b)


def unit(text, page=1):
    return {"text": text, "page": page, "section": "General", "ocr": False}


def test_long_paragraph(spark):
    """900 words of 12-word sentences, then 9 words: 444, 444 and 45 words."""
    s = "This long paragraph keeps every sentence whole through all the chunks made."
    assert len(s.split()) == 12
    docs = {"d": [unit(" ".join([s] * 75)), unit("nine words at the end of this one document", 2)]}
    rows = chunks.assemble(table(spark, docs)).orderBy("chunk_index").collect()
    assert [r.word_count for r in rows] == [444, 444, 45] and rows[2].page_number == 1


def test_even_units(spark):
    """Eight units of 176 words: chunks of 352, 392, 392, 392 on pages 1, 3, 5, 7."""
    docs = {"d": [unit(" ".join(["word"] * 176), i + 1) for i in range(8)]}
    for decisions in (None, spark.createDataFrame([("d", i, "BREAK" if i % 2 == 0 else "CONTINUE") for i in range(8)], "doc string, unit_idx int, decision string")):
        rows = chunks.assemble(table(spark, docs), decisions=decisions).orderBy("chunk_index").collect()
        assert [(r.word_count, r.page_number) for r in rows] == [(352, 1), (392, 3), (392, 5), (392, 7)]


def test_overlap_of_nothing(spark):
    docs = {"d": [unit(" ".join([f"w{i}"] * 30)) for i in range(6)]}
    rows = chunks.assemble(table(spark, docs), chunks.Budget(30, 60, 120, 0, compat=False)).collect()
    assert sum(r.word_count for r in rows) == 180


def test_one_shuffle(spark):
    pages = spark.createDataFrame([("a", 1, "x", "txt", "General", "en", (1, 1, None, False, False))], "doc string, page_number int, content string, source_type string, section string, language string, metadata struct<total_pages:int,char_count:int,extraction_method:string,needs_ocr:boolean,ocr_applied:boolean>")
    made = chunks.assemble(units.paragraph_units(pages.repartition(4, F.rand(1)))).drop("x")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == 1


def same_as_sql(spark, folder, name):
    """A page of three sentences and 771 words in one paragraph, and one more page."""
    import duckdb

    from quire.plans import catalog

    t = "The first of them.\nThe second.\n" + "to " * 822 + "\n\n" + "thti " * 300
    spark.createDataFrame([(7, t, "en")], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = catalog.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_long_unit_as_in_sql_deterministic(spark, tmp_path):
    """F4"""
    same_as_sql(spark, tmp_path, "chunk_deterministic")


def test_long_unit_as_in_sql_semantic(spark, tmp_path):
    """F5"""
    same_as_sql(spark, tmp_path, "chunk_semantic")


def test_long_unit_as_in_sql_summary(spark, tmp_path):
    """F6"""
    same_as_sql(spark, tmp_path, "doc_summary")
