import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import rans, token_files, tokens
from tallyloom.llm.tokens import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def brute(texts):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(PATH), 0, []
    for k, s in texts:
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 1]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(map(tuple, token_files.op5_token_files(spark, d).collect())) == brute(texts)


def test_edges_and_ids(spark, tmp_path):
    texts = [(-3, "a"), (1, None), (2, ""), (3, "long " * 50000), (5, "É ﬁ <|endoftext|> x"), (5, "É ﬁ <|endoftext|> x"), (9, "z\x1cz")]
    df = spark.createDataFrame([(k, s, "e", 7) for k, s in texts], "doc_id long, text string, part string, block int").repartition(4)
    token_files.write(df, f"file://{tmp_path}/t", PATH, block=1000)
    assert sorted(map(tuple, token_files.read_digests(spark, f"file://{tmp_path}/t").collect())) == brute(texts)
    got = {r.start: r.ids for r in token_files.read_ids(spark, f"file://{tmp_path}/t").collect()}
    assert all(zlib.crc32(np.array(got[s], "<u4").tobytes()) == c for _, s, _, c in brute(texts))
    token_files.write(df.limit(0), f"file://{tmp_path}/e", PATH)
    assert token_files.read_digests(spark, f"file://{tmp_path}/e").count() == 0


def test_files_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k * 7 % 500 - 90, f"w{k} and some words " * (k % 40)) for k in range(500)], "doc_id long, text string").repartition(6)
    token_files.write(df, f"file://{tmp_path}/t", PATH, block=300)
    starts, ids = [], []
    for f in sorted(glob.glob(f"{tmp_path}/t/blocks/*.parquet")):
        t = pq.read_table(f)
        starts += t.column("start").to_pylist()
        ids += [k for b in t.column("doc_ids").to_pylist() for k in b]
    assert len(starts) > 20 and starts == sorted(starts) and ids == sorted(ids) == sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_do_not_depend_on_what_was_seen_before(name):
    """Every letter below U+3100 alone, then with marks, in one warm encoder, then random words of them."""
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(vocabulary(name)), tokens.Encoder(vocabulary(name))
    texts = []
    for c in map(chr, range(0x41, 0x3100)):
        texts += [c, f"{c}.", f"{c},", f"a{c}", f"a{c}.", f"x {c},", f"{c}b."]
    rng = random.Random(4)
    pool = [chr(c) for c in range(0x41, 0x3100)] + [chr(c) for c in range(0x41, 0x250)] * 12 + list("İıſßŉǅªº'") * 200
    for _ in range(20_000):
        w = "".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))
        texts.append(rng.choice([w, f"{w}.", f"{w},", f"{w} {w}. {w},", f"{w}'s {w}.\n{w}"]))
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time every chunk has been met
        assert [t for t, a, b in zip(texts, enc.encode(texts), want, strict=True) if a != b] == []
        assert [t for t, a, b in zip(texts, enc.encode_column(pa.array(texts)), want, strict=True) if a != b] == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 200_000), st.integers(1, 50_000), st.integers(0, 9))
def test_block_round_trip(n, symbols, seed):
    rng = np.random.default_rng(seed)
    ids = (symbols * rng.random(n) ** 3).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids, minlength=1) if n else np.zeros(0))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    k = rans.marks(block)
    parts = [rans.decode(block, table, i, i + 1) for i in range(k + 1)]
    assert (np.concatenate(parts) == ids).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 700
    table = rans.Table.scaled(np.bincount(ids))
    block = bytearray(rans.encode(ids, table))
    block[-9] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(bytes(block), table)
