import struct

import corpus_pipeline
from strata.llm import bpe


def test_encoding_is_decoded_again(spark):
    docs = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents")
    vocabulary = bpe.load(*bpe.default_vocabulary())
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = struct.unpack(f"<{len(r['ids']) // 4}I", bytes(r["ids"]))
        assert len(ids) == r["n_tokens"] and bytes(r["decoded"]) == vocabulary.decode(ids) == texts[i]
