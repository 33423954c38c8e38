import hashlib

import public_tokenizers
import tiktoken
from cohortspark.llm.byte_codec import VOCABULARY, Codec, encode_decode, op9_byte_bpe_codec, read_ranks
from helpers import awkward_texts, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
TOKENS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
CODEC = Codec(TOKENS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_and_round_trip(text):
    ids = [i for part in CODEC.encode([text])[0] for i in part]
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_documents(spark):
    docs = clashing(documents(spark, awkward_texts())).drop("ids", "decoded")
    rows = encode_decode(docs, PATH, PATTERN).collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        text = awkward_texts()[r.doc_id] or ""
        assert r.ids == LIBRARY.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert encode_decode(docs.limit(0), PATH, PATTERN).count() == 0
    assert encode_decode(clashing(documents(spark, ["a", "a"])), PATH, PATTERN).count() == 2


def test_query(spark, tmp_path):
    texts = awkward_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_byte_bpe_codec(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
