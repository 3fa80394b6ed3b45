"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftplane.llm import pieces

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(PATH, "rb").read()
ODD = ["", " ", "  ", "a", "\n", "\x00", "▁", " ▁ ", "é", "é", "你好", "\U0001f600", "�", "</s>", "<0x0A>", "<unk>", "z" * 3000, "　", "⁇", "﻿x"]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(codec, texts):
    flat, sizes = codec.encode(texts)
    return pieces._split(flat.tolist(), sizes)


def test_agenda_equals_the_library():
    codec, lib, r = pieces.Codec(RAW), library(), random.Random(5)
    texts = ODD + ["".join(r.choice([*ODD, "the", "ing", "    ", "0", "00", ".\n"]) for _ in range(r.randint(1, 12))) for _ in range(2000)]
    got = encoded(codec, texts)
    assert got == lib.encode(texts, add_eos=True)
    assert [codec.decode(x) for x in got] == lib.decode(got)


def test_decoding_of_any_ids():
    codec, lib, r = pieces.Codec(RAW), library(), random.Random(6)
    draw = lambda: r.choice([0, 1, 2, r.randint(3, 258), r.randint(131, 194), r.randint(195, 258), 259, r.randint(259, 31999)])
    rows = [[draw() for _ in range(r.randint(0, 8))] for _ in range(20000)]
    for ids in rows:
        assert codec.decode(ids) == lib.decode(ids), ids
    flat, sizes = np.array([i for ids in rows for i in ids], np.int32), np.array([len(ids) for ids in rows])
    assert codec.decode_all(rows, flat, sizes).to_pylist() == lib.decode(rows)


def test_runs_are_joined_best_score_first_and_leftmost():
    codec = pieces.Codec(RAW)
    assert codec.merge("") == ()
    assert len(codec.merge("▁" * 33)) == len(library().encode(" " * 32))
    runs = [t.replace(" ", "▁") for t in ODD if t] + ["▁the", "ab", "aaaaaaa", "\U0001f600a", "x"]
    cp = np.frombuffer("".join(runs).encode("utf-32-le"), "<u4")
    flat, sizes = codec.merge_all(cp, np.array([len(t) for t in runs]))
    assert [tuple(x) for x in pieces._split(flat.tolist(), sizes)] == [codec.merge(t) for t in runs]
    long = "ab" * 100_000
    assert encoded(codec, [long])[0] == library().encode(long, add_eos=True)


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_RUNS", 50)
    codec, lib, r = pieces.Codec(RAW), library(), random.Random(7)
    for _ in range(30):
        texts = [" ".join(str(r.randint(0, 10**6)) for _ in range(9)) + r.choice(ODD) for _ in range(3)]
        assert encoded(codec, texts) == lib.encode(texts, add_eos=True)
        assert len(codec.keys) <= 200


def test_what_is_not_covered_is_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Codec(b"")
    codec = pieces.Codec(RAW)
    cut = RAW.replace(b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x00", b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x01")
    assert cut != RAW and codec.lead
    with pytest.raises(ValueError, match="normalised"):
        pieces.Codec(cut)


def test_rows(spark):
    rows = [(i, t, "ids") for i, t in enumerate([*ODD, None, "same", "same"])] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("id", F.lit(7))
    out = pieces.decode(pieces.encode(docs))
    assert out.columns == ["doc_id", "ids", "text"]
    got = {r.doc_id: (r.ids, r.text) for r in out.collect()}
    lib = library()
    for i, t, _ in rows:
        want = lib.encode(t or "", add_eos=True)
        assert got[i] == (want, lib.decode(want))
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_a_difference_ends_the_job(spark, monkeypatch):
    with pytest.raises(ValueError, match="differs"):
        pieces._differs("encoding", [[1], [2]], [[1], [3]])


def test_query_equals_the_library(spark):
    got = {r.doc_id: r for r in pieces.op11(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    lib, sha = library(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
