import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from accordant.llm import byte_bpe, decontaminate, language_id, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "simhash_dedup", "decontamination", "byte_bpe"]


def test_run_equals_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # language ID: one text at a time by the model of these documents; what mixes languages too much goes
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    said = {k: model.predict([t]) for k, t in docs.items()}
    left = {k: t for k, t in docs.items() if any(c.isalpha() for c in t or "") and said[k][1][0] >= 0.5}
    frame = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin(list(left)))
    # quality: by the scores of trees from the same rows
    trees = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {k: t for k, t in left.items() if trees.score(quality.matrix([t]))[0] >= 0.5}
    # near copies: the smallest id of each class stays, by all pairs
    sets = {k: frozenset(simhash.shingle_hashes(t, 5).tolist()) for k, t in left.items()}
    heads = {}
    for k in sorted(left):
        linked = {heads[o] for o in heads if len(sets[o] & sets[k]) >= 0.8 * len(sets[o] | sets[k])}
        head = min({k, *linked})
        heads = {o: head if h in linked else h for o, h in heads.items()} | {k: head}
    left = {k: left[k] for k in set(heads.values())}
    # decontamination: one text at a time
    block = next(decontaminate.blocks(spark.read.parquet(f"{SF}/benchmark.parquet")))
    left = {k: t for k, t in left.items() if not block.matches(t, decontaminate.Canonical(block.words))}
    enc = byte_bpe.encoder(*byte_bpe.default_vocabulary())
    assert set(got) == set(left) and 0 < len(left) < len(docs)
    for k, t in left.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_hard_rows_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a fine text with words", "en", "s", 1, "x"), (1, "a fine text with words", "en", "s", 1, "x"), (2, None, None, None, None, "x"), (None, "another text", "en", None, 3, "x"), (3, "", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, _k0 string")
    for rows, name in ((docs, "some"), (docs.limit(0), "none")):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == ["1", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/some").columns == docs.columns
