import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import packing
from tallyloom.llm.tokens import Encoder, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, extra string, sequence_id string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 1]


def check(rows, texts, plain):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for k, pieces in docs.items():
        ids, at = plain(texts[k]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad


def test_whole_table(spark, plain):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = packing.op2_harmonic_packing(spark, d).collect()
    pad = check(rows, texts, plain)
    assert pad <= 2048 + 0.02 * sum(r.length for r in rows)


def test_edges(spark, plain):
    odd = "a\x1c!\x1c b　c  d\n\n e\t\tf <|endoftext|> g   h"
    texts = {1: None, 2: "", 3: "x" * 30000, 4: odd, 5: " ", 6: "\n", 7: "word " * 9000, -1: "tie", 8: "tie"}
    df = spark.createDataFrame([(k, v, "e", "s") for k, v in texts.items()], SCHEMA).repartition(3)
    check(packing.pack(df, PATH).collect(), texts, plain)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_many_workers_reach_one(spark, plain):
    texts = {i: "alpha beta gamma " * (i % 90) for i in range(300)}
    df = spark.createDataFrame([(k, v, "e", "s") for k, v in texts.items()], SCHEMA).repartition(40)
    pad = check(packing.pack(df, PATH).collect(), texts, plain)
    assert pad <= 2 * 2048


def test_cuts():
    for n in range(2048):
        parts = packing.cuts(n)
        assert sum(x for x, _ in parts) == n and all(x <= 2048 // m for x, m in parts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_equal_whole(spark, name):
    enc = Encoder(vocabulary(name))
    texts = ["", " ", "  a", "It's 2 o'clock!!  \n\n Yes\t", "É́té ÑU ﬁ", "a\u0000b", "日本語 テスト", "don't  'LL <|startoftext|>", "\U0001f600 x\r\ny", "Σίσυφος ΟΔΟΣ", "é ́x"]
    texts += ["a", "a b", "a\nb c", "It's, a. B,\nC. d.", "x, y", "x", "Ünï, ñ.", ",", ". ,", "1, 2.", "é, é"]
    assert list(enc.encode(texts)) == [enc.whole(t) for t in texts]
    assert list(enc.encode_column(pa.array(texts * 400))) == [enc.whole(t) for t in texts] * 400


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_low_code_point_splits_alike(spark, name):
    enc = Encoder(vocabulary(name))
    for form in ("!{0}! {0}{0} x", "  {0} b{0}\n{0}c"):
        texts = [form.format(chr(c)) for c in range(0x3100)]
        assert list(enc.encode(texts)) == [enc.whole(t) for t in texts]
        assert list(enc.encode_column(pa.array(texts))) == [enc.whole(t) for t in texts]
