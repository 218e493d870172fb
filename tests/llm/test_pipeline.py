"""The pipeline against its stages done by hand."""

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pluvio.llm import bpe, decontamination, pii, toxicity
from pluvio.llm.common import read
from tests.llm.test_text_operators import jaccard_classes


def test_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    texts = {r.doc_id: r.text for r in scores.filter("score < 0.5").collect()}
    classes = jaccard_classes(texts, 5, 80, 100)
    texts = {i: t for i, t in texts.items() if classes[i][0] == 0 or classes[i][1] == i}
    hit = {r.doc_id for r in decontamination.contamination(docs, read(spark, sf_dir, "benchmark")).filter("n_hit > 0").collect()}
    texts = {i: t for i, t in texts.items() if i not in hit}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    plain = {r.doc_id: r.text for r in pii.pseudonymise(docs, corpus_pipeline.PII_KEY).collect()}
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))),
        special_tokens={},
    )
    for i, r in rows.items():
        assert r.text == plain[i] and r.round_trip and len(r.text) == r.n_chars
        assert bytes(r.ids) == np.array(library.encode_ordinary(r.text), dtype="<u4").tobytes()


def test_stages_on_odd_rows(spark, odd_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns and out.count() >= 6
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf_dir)
    assert last.columns[: len(odd_docs.columns)] == odd_docs.columns and last.filter(~F.col("round_trip")).count() == 0
