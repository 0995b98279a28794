"""Token ids of whole tables against the named tokenizer."""

import duckdb
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tomeflow.llm import packing


def test_ids_of_all_documents_are_the_tokenizers():
    named = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids_of = packing.TokenIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [t for (t,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    assert len(texts) >= 1000
    for text in texts:
        assert np.array_equal(ids_of(text), named.encode(text, add_special_tokens=False).ids)
