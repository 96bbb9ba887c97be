"""Prefix BPE, packing and token files against the public libraries, and the BPE table under edits."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklane.llm import bpe, packing, pieces, queries, tokenfiles, vocab
from tracklane.llm.packing import Packing

RANKS, LIBRARY = vocab.public_file("byte_bpe_50k.tiktoken"), vocab.public_file("byte_bpe_50k.json")
TEXTS = [
    (1, "The quick brown fox."), (2, None), (3, ""), (4, "a" * 3000), (5, "x  y   z \n\n q\t "), (6, "don't <|endoftext|> stop"),
    (7, "Größe naïve 日本語 😀 … 123 45"), (7, "Größe naïve 日本語 😀 … 123 45"), (None, "no id"), (9, " lead and trail "), (10, "word " * 4000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "keep", 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens int").repartition(3)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=vocab.public_pattern(), mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={})


PARTS = ["a", "aaa", "the", " the", " ", "  ", "   ", "\n", "\t", "'s", "'ll", "12", "é", "ß", "!!", "...", " ", "\x1c", "\x85", "日本", "😀", "_", "\r\n", "    ", "z."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_whole_texts_as_the_libraries(text):
    want = tiktoken.Encoding("own", pat_str=vocab.public_pattern(), mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={}).encode_ordinary(text)
    assert np.frombuffer(bpe.prefix_encoder(RANKS).encode(text), "<u4").tolist() == want
    assert np.frombuffer(vocab.library_encoder(LIBRARY).encode(text), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text("aabeiothn -=.", min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 60), st.text("aabeio -", max_size=6))
def test_appends_and_edits(text, a, b, put):
    vocabulary = bpe.load(RANKS)
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    table = bpe.PrefixEncoding(vocabulary, text[:a].encode())
    table.append(text[a:].encode())
    assert table.tokens() == enc.encode_ordinary(text)
    table.replace(a, b, put.encode())
    assert table.tokens() == enc.encode_ordinary(text[:a] + put + text[b:])


def test_an_edit_is_redone_only_nearby():
    table = bpe.PrefixEncoding(bpe.load(RANKS), b"one two three " * 200)
    assert table.replace(10, 11, b"x") < 400
    assert table.data.startswith(b"one two thxee")


def test_encode_and_decode(spark, docs, own):
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in rows) == sorted((str(i), t or "") for i, t in TEXTS)
    assert all(r.ids == own.encode_ordinary(bytes(r.decoded).decode()) for r in rows)


def test_token_files_round_trip(spark, docs, library, tmp_path):
    for layout in (tokenfiles.Layout(), tokenfiles.Layout(encoding="delta", row_group_bytes=4096, page_rows=2)):
        folder = str(tmp_path / layout.encoding)
        tokenfiles.write(docs, LIBRARY, folder, layout=layout)
        got = sorted(tokenfiles.checksums(spark, folder).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
        at, texts = 0, dict(TEXTS)
        for r in got:
            ids = [*library(texts[r.doc_id]), 0]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        one = tokenfiles.read(spark, folder).where("doc_id = 1").select("tokens").collect()
        assert one[0].tokens == [*library(texts[1]), 0]
    with pytest.raises(ValueError):
        tokenfiles.Layout(encoding="other").options()


def test_page_index_and_encodings_are_written(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        folder = tmp_path / encoding
        tokenfiles.write(docs, LIBRARY, str(folder), layout=tokenfiles.Layout(encoding=encoding))
        for file in folder.glob("part-*.parquet"):
            group = pq.read_metadata(file).row_group(0)
            column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("tokens"))
            assert name in column.encodings and column.has_offset_index


def test_packing_is_exact_and_dense(docs, library):
    packed = packing.pack(docs, LIBRARY, Packing(capacity=64, window=500)).collect()
    texts = dict(TEXTS)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = [*library(texts[r.doc_id]), 1]
        assert bytes(r.ids) == np.array(ids[r.start : r.start + r.length], "<u4").tobytes() and r.doc_tokens == len(ids)
        of_doc[r.doc_id].append((r.start, r.length))
        of_sequence[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for i, t in texts.items():
        copies = sum(j == i for j, _ in TEXTS)
        assert sum(n for _, n in of_doc[i]) == copies * (len(library(t)) + 1)
    for runs in of_sequence.values():
        at = 0
        for offset, length, total in sorted(runs):
            assert offset == at
            at += length
        assert at == total and (at == 64 or at & (at - 1) == 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=40))
def test_balance_places_every_token_once(lengths):
    rows = packing.balance(lengths, Packing(capacity=64))
    for doc, n in enumerate(lengths):
        at = 0
        for _, start, length, _, _ in sorted(r for r in rows if r[0] == doc):
            assert start == at
            at += length
        assert at == n
    size = packing.rooms(sum(lengths), 64)
    assert np.bincount([r[3] for r in rows], [r[2] for r in rows]).tolist() == size.tolist()


def test_balance_evens_out_cost():
    rows = packing.balance([8] * 16 + [32] * 4, Packing(capacity=64))
    cost = defaultdict(float)
    for _, _, n, where, _ in rows:
        cost[where] += n + n * n / 1024
    assert max(cost.values()) - min(cost.values()) < 2


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, LIBRARY).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    tokenfiles.write(none, LIBRARY, str(tmp_path / "none"))
    assert tokenfiles.checksums(spark, str(tmp_path / "none")).count() == 0


def test_digest_query(spark, own):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, d, "documents").collect()}
    for r in queries.QUERIES["op3_prefix_bpe"](spark, d).collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert queries.packing_digest(packing.pack(queries.table(spark, d, "documents"), LIBRARY)).agg(F.sum("length")).first()[0] > 0


def test_a_word_with_a_mark_is_not_encoded_again():
    met = []
    encoder = pieces.TextEncoder(lambda w: met.append(w) or w.encode(), vocab.public_pattern())
    assert encoder.encode("one größer größer, größer. größer") == "one größer größer, größer. größer".encode()
    assert met.count(" größer") == 1


def test_neighbours_are_told_by_few_joins():
    """Only tokens that others begin with are joined with such that others end with."""
    vocabulary = bpe.load.__wrapped__(RANKS)

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    rnd = np.random.default_rng(2)
    usable = sorted(vocabulary.usable.values())
    pairs = [(int(a), int(b)) for a, b in rnd.choice(usable, (2000, 2))]
    want = [bpe.PrefixEncoding(vocabulary, vocabulary.bytes[a] + vocabulary.bytes[b]).tokens() == [a, b] for a, b in pairs]
    vocabulary._beside.clear()
    vocabulary.ranks = Counted(vocabulary.ranks)
    tried = sum(len(vocabulary.edges(a)[1]) * len(vocabulary.edges(b)[0]) for a, b in pairs)
    assert [vocabulary.beside(a, b) for a, b in pairs] == want
    assert vocabulary.ranks.asked < tried / 2, (vocabulary.ranks.asked, tried)
