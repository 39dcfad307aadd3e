import json
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationflow.llm import queries as Q
from stationflow.llm.packing import hilbert_key, pack_documents, powers
from stationflow.llm.token_counts import _BYTES, _WORDS, LongestMatch, count_tokens, load_vocabulary
from stationflow.llm.token_files import read_token_files, token_digests, write_token_files
from stationflow.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ENC = {p: Encoder(p) for p in (WORD, BYTE)}
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, start string, lang string"


def odd_docs(spark):
    rows = [(1, None), (None, "no id"), (2, ""), (3, "same"), (4, "same"), (4, "same"), (4, "other"), (5, "word " * 30000), (6, "<|endoftext|> a  b \n"), (7, "ÉİΣ \x1c　x")]
    return spark.createDataFrame([(i, t, None, "x", None) for i, t in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t　\x1c.'!sStdREa1ÉΣİ́")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_the_library(text):
    for path, enc in ENC.items():
        assert enc.kind is not None
        ids, n = enc.encode([text, None, text + " end."], end_id=7)
        want = [enc.tok.encode(t, add_special_tokens=False).ids + [7] for t in (text, "", text + " end.")]
        assert ids.tolist() == sum(want, []) and n.tolist() == [*map(len, want)], path


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    made = json.load(open(BYTE, encoding="utf-8"))
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(made), encoding="utf-8")
    enc = Encoder(str(tmp_path / "other.json"))
    assert enc.kind is None
    assert enc.encode(["a b  c\n", ""])[0].tolist() == enc.tok.encode("a b  c\n", add_special_tokens=False).ids


def test_memo_is_bounded_in_bytes():
    enc = Encoder(BYTE)
    enc.words.most = 1 << 16
    for k in range(40):
        enc.encode([" ".join(f"w{k}x{j}" for j in range(500))])
    assert enc.words.size < 3 << 16 and len(enc.words.old) < 4000


def check_pieces(pieces, texts):
    tok = Tokenizer.from_file(WORD)
    want = sorted(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts)
    seqs, docs = {}, {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    whole = sum(len(b"".join(x for _, x in parts)) for parts in docs.values())
    assert whole == sum(map(len, want))
    return want, docs


def test_packing(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    pieces = pack_documents(spark.createDataFrame(rows), WORD, 1).collect()
    want, docs = check_pieces(pieces, [r.text for r in rows])
    assert sorted(b"".join(x for _, x in sorted(parts)) for parts in docs.values()) == want


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    check_pieces(pack_documents(docs, WORD, 1, segment=100).collect(), [r.text for r in docs.collect()])
    assert pack_documents(docs.limit(0), WORD, 1).count() == 0


def test_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = grid[np.argsort(hilbert_key(grid, 3))]
    assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours in space
    assert powers(1337) == [1024, 256, 32, 16, 8, 1]


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tok, start = Tokenizer.from_file(BYTE), 0
    got = {r.doc_id: r for r in Q.op10_token_files(spark, DATA).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark):
    for encoding in ("dictionary", "delta"):
        path = write_token_files(odd_docs(spark), BYTE, 0, encoding=encoding)
        rows = token_digests(spark, path).orderBy("start").collect()
        assert len(rows) == 10 and rows[0].doc_id is None
        assert [r.start for r in rows] == (np.cumsum([r.n_tokens for r in rows]) - [r.n_tokens for r in rows]).tolist()
        assert read_token_files(spark, path, 3, 4).count() == 4
    path = write_token_files(odd_docs(spark).limit(0), BYTE, 0)
    assert token_digests(spark, path).count() == 0


def naive(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12), st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_match(vocabulary, word):
    assert LongestMatch(vocabulary).count(word) == naive(word, vocabulary)


def test_token_counts(spark):
    pieces = json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"]
    vocabulary = {bytes(_BYTES[c] for c in p) for p in pieces if all(c in _BYTES for c in p)}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(40)
    for r in count_tokens(docs, BYTE).collect():
        assert r.n_tokens == sum(naive(w.encode(), vocabulary) for w in _WORDS(r.text)) and r.n_words == len(_WORDS(r.text))
    odd = count_tokens(odd_docs(spark).withColumn("n_tokens", F.lit("x")), BYTE).collect()
    assert len(odd) == 10 and {r.n_tokens for r in odd if not r.text} == {0}
    assert count_tokens(docs.limit(0), BYTE).count() == 0
    assert load_vocabulary(BYTE).count(b"the") == 1
