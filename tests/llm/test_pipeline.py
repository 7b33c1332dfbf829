"""Every pipeline stage on hand-made rows: its decisions, its columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paysift.llm import toxicity
from paysift.llm.queries import QUERIES, SQL, labels_by_category

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, whole_row string, is_toxic string, row_key string, mix_rate string, text_key string, length string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    text = " ".join(words[:200])
    passage = " ".join(words[200:300])
    made = [(5000, text), (5001, text), (5002, text.replace(words[9], "zzzz")), (5003, f"{' '.join(words[300:340])} {passage} one"), (5004, f"{' '.join(words[340:380])} {passage} two"), (5005, None), (5006, ""), (None, " ".join(words[400:450]))]
    rows = [(i, t, "en", "src1" if i != 5005 else None, len(t or ""), *["own"] * 6) for i, t in made]
    own = base.select("*", *[F.lit("own").alias(c.split()[0]) for c in SCHEMA.split(", ")[5:]])
    return own.unionByName(spark.createDataFrame(rows + rows[:1], SCHEMA)), text, passage


def test_stages_in_turn(spark, sf, docs):
    now, text, passage = docs
    before = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == now.columns and out.dtypes == now.dtypes
        before[name] = (now.toPandas(), out.toPandas())
        now = corpus_pipeline.cut(out)
    given, kept = before["toxicity"]
    marked = toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels_by_category(spark, sf)).where("is_toxic").toPandas()
    gone = set(given.doc_id.dropna()) - set(kept.doc_id.dropna())
    assert gone and gone == set(marked.doc_id)
    kept = before["near_duplicates"][1]
    assert {5000, 5003, 5004, 5005, 5006} <= set(kept.doc_id.dropna()) and not {5001, 5002} & set(kept.doc_id.dropna())
    assert kept.doc_id.isna().sum() == 1 and not kept.doc_id.duplicated().any()
    given, kept = before["repeated_passages"]
    assert len(given) == len(kept)
    by = kept.set_index("doc_id")
    assert passage not in by.text[5003] and by.text[5003].endswith("one") and by.text[5000] == text
    assert all(n == len(t) for n, t in zip(kept.n_chars, kept.text, strict=True) if t is not None)
    given, kept = before["source_mix"]
    assert set(kept.text.dropna()) <= set(given.text.dropna())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert (packed.piece == 0).sum() == len(kept)


def test_repeated_passages_of_over_50_words(spark, sf):
    r = random.Random(9)
    words = lambda n, size: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))
    short, usual, few, solid = words(51, 1), words(51, 5), words(40, 5), words(1, 400)
    rows = [(2 * i + j, f"{words(60, 6)} {'xy'[j]} {p}{after}", "en", "s", 0) for i, p in enumerate((short, usual, few, solid)) for j, after in enumerate((f"\n{words(60, 6)} x", ""))]
    out = {x.doc_id: x for x in corpus_pipeline.remove_repeated_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), sf).collect()}
    for i, p in enumerate((short, usual, few, solid)):
        assert all((p in out[2 * i + j].text) == (p == few) for j in (0, 1)), p
    assert all(len(x.text) >= 420 and x.n_chars == len(x.text) for x in out.values())


def test_empty_documents(spark, sf, docs):
    empty = docs[0].limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(SQL) <= set(QUERIES) and set(SQL) <= set(entry.oracle_sql())
