import hashlib
from array import array

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwell.llm import language, mixing
from tests.llm.data import docs, odd_docs
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near import brute as grouped


def test_each_stage_by_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_near_dedup", "source_mixing", "bpe_coding"]
    known = stages["language_id"](spark, df, sf_dir).cache()
    assert known.columns == df.columns
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in df.collect() if r.text and language.LETTER.search(r.text)}
    net = language.fit(df, "text", "lang", "doc_id")
    rows = known.collect()
    assert [r.lang for r in rows] == language.predict(net, [r.text.encode() for r in rows])[0]
    single = stages["minhash_near_dedup"](spark, known, sf_dir).cache()
    want = {i for i, _, _, first in grouped([(r.doc_id, r.text) for r in known.collect()], 5, 80) if first}
    assert single.columns == df.columns and sorted(r.doc_id for r in single.collect()) == sorted(want)
    taken = stages["source_mixing"](spark, single, sf_dir).cache()
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    sizes = {i: (n, t) for i, n, _, _, t in mixed([(r.doc_id, r.text, r.source) for r in single.collect()])}
    assert taken.columns == df.columns and counts == {i: t // n for i, (n, t) in sizes.items() if t}
    tokens = stages["bpe_coding"](spark, taken, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in taken.collect()}
    assert len(tokens) == taken.count()
    for r in tokens[::7]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert array("I", bytes(r.ids)).tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_and_empty_documents(spark, sf_dir):
    for df in (odd_docs(spark), docs(spark, [])):
        df = df.withColumns({c: F.lit(1) for c in ("_hash", "_key", "_size", "_copy", "lang_pred", "target", "source_size", "row")})
        names = df.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == names
        assert df.where("text is null").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()


def test_mix_keeps_the_columns(spark):
    df = docs(spark, [(i, "w " * (1 + i % 9), "en", f"s{i % 4}") for i in range(60)])
    out = corpus_pipeline.mixing_stage(spark, df, "")
    assert out.columns == df.columns and out.count() > 0
    assert set(mixing.mix(df.withColumn("_size", mixing.word_count(F.col("text"))), "source", "_size", "doc_id").columns) >= {"target", "times"}


def test_texts_stay_without_labels(spark):
    rows = [(1, "Ein Text.", None, "a"), (2, "été", None, None), (None, "日本語", None, "a"), (4, "1 2 3 !", None, "a"), (5, None, None, "a"), (6, "", None, None)]
    out = corpus_pipeline.language_stage(spark, docs(spark, rows), "")
    assert sorted((r.text, r.lang) for r in out.collect()) == sorted((t, None) for t in ("Ein Text.", "été", "日本語"))
    assert out.columns == docs(spark, rows).columns
