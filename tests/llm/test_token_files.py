import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty
from tokenizers import Tokenizer

from pickwell.llm import rans as R
from pickwell.llm import token_files as T
from pickwell.llm.queries import QUERIES
from pickwell.session import fresh_path

JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
TEXTS = ["b", None, "", "a", "x" * 3_000, "word 12 " * 9_000, "  \n\n é 😀 don't", "<|endoftext|> a", "a"]


def brute(rows):
    """Of ``(doc_id, text)`` in order: id, ids before, number and checksum of the ids, and all ids."""
    tokenizer, out, every = Tokenizer.from_str(JSON), [], []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    return out, every


def found(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=700), st.integers(0, 3))
def test_blocks_round_trip(ids, times):
    ids = np.array(ids * 2**times, np.uint32)
    table = R.table_of(ids)
    assert not len(ids) or int(table.frequencies.sum()) == 1 << table.bits and table.frequencies.min() >= 1
    back = R.unpack_table(R.pack_table(table))
    assert back.bits == table.bits and (back.symbols == table.symbols).all() and (back.frequencies == table.frequencies).all()
    blocks = R.encode(ids, table)
    assert [x for b in R.decode(blocks, back) for x in b.tolist()] == ids.tolist()


def test_many_blocks_near_the_entropy_and_apart():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 3 * R.BLOCK_TOKENS + 77), 50_000).astype(np.uint32)
    table = R.table_of(ids)
    blocks = R.encode(ids, table)
    assert len(blocks) == 4 and (np.concatenate(R.decode(blocks, table)) == ids).all()
    assert (R.decode(blocks[2:3], table)[0] == ids[2 * R.BLOCK_TOKENS : 3 * R.BLOCK_TOKENS]).all()
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert sum(map(len, blocks)) * 8 < 1.06 * len(ids) * -(share * np.log2(share)).sum()
    same = np.full(1_000, 9, np.uint32)
    assert len(R.encode(same, R.table_of(same))[0]) < 1_100 and (R.decode(R.encode(same, R.table_of(same)), R.table_of(same))[0] == 9).all()


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint32) % 7
    table = R.table_of(ids)
    (block,) = R.encode(ids, table)
    for at in (0, 5, 40, len(block) - 1):
        with pytest.raises(R.Damaged):
            R.decode([block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :]], table)
    with pytest.raises(R.Damaged):
        R.decode([block[:-9]], table)
    sealed = R.pack_table(table)
    with pytest.raises(R.Damaged):
        R.unpack_table(sealed[:9] + bytes([sealed[9] ^ 1]) + sealed[10:])
    with pytest.raises(R.Damaged):
        R.decode([R._sealed(block[:-12])], table)  # a short stream under a right checksum


@pytest.mark.parametrize("segment", [1, 50, T.SEGMENT_TOKENS])
def test_files(spark, segment):
    path = fresh_path(spark, "tokens")
    T.write(documents(spark, TEXTS), JSON, path, segment_tokens=segment)
    want, every = brute(enumerate(TEXTS))
    assert found(T.documents(spark, path)) == want
    assert spark.read.parquet(path).count() == (len(TEXTS) if segment == 1 else spark.read.parquet(path).count())
    for start, stop in ((0, 1), (3, 3_900), (1_200, 1_201), (0, len(every) + 9), (5, 5)):
        rows = T.read_range(spark, path, start, stop).orderBy("start").collect()
        assert [x for r in rows for x in r.ids] == every[start:stop]


def test_null_and_repeated_ids_and_empty_table(spark):
    path = fresh_path(spark, "tokens")
    T.write(documents(spark, ["a", "bb bb", "c", "a"], [None, 1, 1, 1]), JSON, path)
    rows = found(T.documents(spark, path))
    assert [r[0] for r in rows] == [None, 1, 1, 1] and [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows[:-1])]).tolist()
    assert sorted(r[2:] for r in rows) == sorted(r[2:] for r in brute(enumerate(["a", "bb bb", "c", "a"]))[0])
    path = fresh_path(spark, "tokens")
    T.write(empty(spark), JSON, path)
    assert T.documents(spark, path).count() == 0 and T.read_range(spark, path, 0, 9).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    frame = QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001")
    assert frame.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert found(frame) == brute([(r.doc_id, r.text) for r in rows])[0]
