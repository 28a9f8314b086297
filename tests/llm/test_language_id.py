import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import language_id as li

EN = "the quick brown fox jumps over the lazy dog and then it runs through the whole forest with that other dog"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den ganzen wald mit dem anderen"
RU = "быстрая коричневая лиса прыгает через ленивую собаку"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)] + [(99, None, "en"), (98, EN, None), (97, "", "de")]
    return li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain_labels(model, text, penalty=li.SWITCH_PENALTY):
    """The best path, one text and one word at a time."""
    scores = model.word_scores(li.words_of([text]))
    n = len(model.languages)
    paths = [(0.0, [])] * n
    for s in scores:
        top = max(range(n), key=lambda k: (paths[k][0], -k))
        paths = [(max(paths[k][0], paths[top][0] - penalty) + s[k], (paths[k] if paths[k][0] >= paths[top][0] - penalty else paths[top])[1] + [k]) for k in range(n)]
    return max(paths, key=lambda p: p[0])[1] if len(scores) else []


def test_paths_equal_the_plain_ones(model):
    texts = [f"{EN} {DE} {EN}", RU, "a", "", f"{DE} {RU}", EN.upper(), "dog hund dog", "x" * 500]
    words = li.words_of(texts)
    got = np.split(model.labels(words), np.cumsum(words.per_text)[:-1])
    assert [g.tolist() for g in got] == [plain_labels(model, t) for t in texts]


def test_spans_of_mixed_text(model):
    text = f"{EN}. {DE}! {RU}"
    spans = model.spans(text)
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert text[spans[2][0] : spans[2][1]] == RU


@pytest.mark.parametrize("limit", [1, 30, 200, 1 << 18])
def test_long_texts_in_slices_equal_whole_ones(model, limit):
    for text in (f"{EN}. {DE}! {RU} " * 8, RU, "日本" * 300 + "。", "", "a" * 400, "a\u0301" * 200 + " dog"):
        words = li.words_of([text])
        assert "".join(li.text_slices(text, limit)) == text
        if text:
            got, lengths = model.long_labels(text, limit=limit)
            assert got.tolist() == model.labels(words).tolist() and lengths.tolist() == words.lengths.tolist()


def test_the_stage_rejects_by_prediction(spark, monkeypatch):
    """Whole texts of one language stay; of three languages in like parts none has half of the letters."""
    rows = [(i, t, x) for i, (t, x) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)]
    mixed = f"{EN[:60]} {DE[:60]} {RU}"
    docs = spark.createDataFrame([*rows, (90, mixed, None), (91, "12", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in li.keep_known(spark, docs).collect()} == set(range(15))
    assert {r.doc_id for r in li.keep_known(spark, docs, languages=("de",)).collect()} == {1, 4, 7, 10, 13}
    assert {r.doc_id for r in li.keep_known(spark, docs, least_share=0.1).collect()} == {*range(15), 90}


def test_words_are_runs_of_letters():
    words = li.words_of(["Don't 12 été", None, "́ 7", "日本 x"])
    assert words.per_text.tolist() == [3, 0, 0, 2]
    assert words.lengths.tolist() == [3, 1, 5, 2, 1]
    assert words.scripts.tolist() == [1, 1, 1, 13, 1]


def test_no_letters_and_order(spark, model):
    rows = [(1, EN), (2, None), (3, ""), (4, "12 !?"), (None, DE), (5, RU), (5, RU), (6, f"{EN} " * 3000 + DE), (7, "\x00"), (8, "日本")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = docs.select("text", li.predicted(spark, model, F.col("text")).alias("p")).collect()
    want = {EN: "en", DE: "de", RU: "ru", None: "und", "": "und", "12 !?": "und", "\x00": "und"}
    for r in got:
        assert 0 <= r.p.score <= 1
        assert r.p.lang_pred == want.get(r.text, r.p.lang_pred)
        assert r.p.lang_pred in {*model.languages, "und"}
    stage = li.keep_known(spark, docs.withColumn("lang", F.lit("en")))
    assert stage.count() == 6 and stage.columns == [*docs.columns, "lang"]
    assert li.keep_known(spark, docs.withColumn("lang", F.lit(None).cast("string"))).count() == 6
    assert li.keep_known(spark, docs.withColumn("lang", F.lit("en")).limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = li.op8_query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
