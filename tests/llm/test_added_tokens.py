"""Texts that hold added tokens, against the tokenizers library as it is loaded."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from tracklane.llm import queries, vocab

PATH = vocab.public_file("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
END = "<|endoftext|>"
TEXTS = ["plain", f"see {END} here", END, f" {END}{END}  x", f"a  {END}\n\n", f"<{END}", "<|endoftext", None, "", "after"]
PARTS = [END, "<|endoftext|", ">", "<", "|", " ", "  ", "\n", "the", " the", "é", "日本", "'s", "'", "12", "."]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_whole_texts_as_the_library_as_loaded(text):
    assert np.frombuffer(vocab.library_encoder(PATH, added=True).encode(text), "<u4").tolist() == want(text)


def test_tokens_that_start_alike(tmp_path):
    library, path = Tokenizer.from_file(PATH), str(tmp_path / "more.json")
    library.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in ("<|e", "<|end", "|>")])
    library.save(path)
    encoder = vocab.library_encoder(path, added=True)
    for text in ("a <|end b", "<|e|>", f"<|ends {END} <|e", "x<|en|>>"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_queries_and_pipeline(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS}), tmp_path / "documents.parquet")
    at = 0
    for r in sorted(queries.QUERIES["op9_token_files"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = np.array([*want(TEXTS[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    packed = queries.QUERIES["op2_cost_packing"](spark, str(tmp_path)).collect()
    for r in packed:
        ids = np.array([*want(TEXTS[r.doc_id]), 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in packed) == sum(len(want(t)) + 1 for t in TEXTS)
    stage = corpus_pipeline.packing_stage(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert stage.agg(F.sum("length")).first()[0] == sum(r.length for r in packed)
