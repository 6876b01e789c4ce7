import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import BYTE, WORD, texts_of
from wardline.llm import bytebpe, common, huffman, packing
from wardline.llm.wordtokens import batch_ids

TOKENIZER = Tokenizer.from_file(WORD)
ODD = ["a\x1cb \x85c  İstanbul ΣΑΣ Σ. DON'T i'll'd é e ́ ﬁ Ⅷ ²½ 漢字 🙂🙂", "", " ", "'S 's'T", "<|endoftext|> a", "ª. a\x00b", None]


def word_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(rows):
    texts = [*rows.values(), *ODD]
    ids, n = batch_ids(pa.array(texts), WORD)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [word_ids(t) for t in texts]


def file_rows(given):
    at, out = 0, []
    for doc_id, text in given:
        raw = np.array([*word_ids(text), 1], "<u4")
        out.append((doc_id, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    return out


def by_id(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_token_file_round_trip(docs, rows, monkeypatch):
    monkeypatch.setattr(huffman, "RANGE_TOKENS", 20_000)
    monkeypatch.setattr(huffman, "BLOCK_BYTES", 3_000)
    got = huffman.with_crc(huffman.huffman_round_trip(docs, WORD)).collect()
    assert sorted(map(tuple, got)) == file_rows(sorted(rows.items()))


def test_token_file_odd_and_empty(odd, none):
    got = [tuple(r) for r in huffman.with_crc(huffman.huffman_round_trip(odd, WORD)).collect()]
    given = sorted(texts_of(odd), key=by_id)
    assert sorted(got, key=by_id) == file_rows(given)
    assert huffman.huffman_round_trip(none, WORD).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, limit in ((2, 1), (5, 3), (300, 9), (1000, 12)):
        counts = rng.zipf(1.3, n).clip(1, 10**9)
        bits = huffman.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(2.0 ** -bits.astype(float)) <= 1
    fib = [1, 1, 2, 3, 5, 8, 13]
    assert sorted(huffman.code_lengths(np.array(fib), 20)) == [1, 2, 3, 4, 5, 6, 6]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    got = packing.with_crc(packing.pack(df, WORD)).collect()
    expect = []
    for doc_id, text in texts_of(df):
        raw = np.array([*word_ids(text), 0], "<u4")
        expect += [(doc_id, i // 2048, i, len(raw[i:i + 2048]), zlib.crc32(raw[i:i + 2048].tobytes())) for i in range(0, len(raw), 2048)]
    assert sorted([tuple(r)[:5] for r in got], key=by_id) == sorted(expect, key=by_id)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    bound = -(-sum(r["length"] for r in got) // 2048)
    assert len(held) <= bound * 1.02 + 1


def test_placing_takes_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 33, 300).tolist(), reverse=True)
    sequence, offset = packing.place(lengths, 32)
    room = {}
    for s, at, o in zip(lengths, sequence, offset):
        def total(held):
            n = np.bincount([r for r in held.values() if r], minlength=33)
            return int((n ** 2).sum())
        choices = {a: total({**room, a: r - s}) for a, r in room.items() if r >= s}
        if choices:
            assert at in room and choices[at] == min(choices.values())
        assert o == 32 - room.get(at, 32)
        room[at] = room.get(at, 32) - s
        assert room[at] >= 0


def test_byte_bpe(docs, odd, none):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bytebpe.read_ranks(BYTE))
    for df in (docs, odd, none):
        encoded = bytebpe.encode_documents(df, BYTE, public_tokenizers.PATTERN)
        got = sorted([(r["doc_id"], r["ids"]) for r in encoded.collect()], key=by_id)
        assert got == sorted([(d, reference.encode_ordinary(t)) for d, t in texts_of(df)], key=by_id)
        back = bytebpe.decode_documents(encoded, BYTE, public_tokenizers.PATTERN).collect()
        assert sorted([(r["doc_id"], bytes(r["bytes"])) for r in back], key=by_id) == sorted([(d, t.encode()) for d, t in texts_of(df)], key=by_id)


def test_byte_bpe_of_long_pieces():
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bytebpe.read_ranks(BYTE))
    codec = bytebpe.Codec(bytebpe.read_ranks(BYTE), public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    texts = ["a" * 700, "ab" * 300, " " * 200 + "x", "".join(rng.choice(list("abcdéf"), 900)), "".join(rng.choice(list(" \n\tab'sé1!"), 500))]
    assert [bytebpe._numbers(s).tolist() for s in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters, size", [("etaoinsr", 100_000), ("etaoinsr", 1_000_000), ("a", 1_000_000), ("ab", 20_000), ("=-", 5000), ("é漢a", 3000)])
def test_byte_bpe_of_unbroken_words(letters, size):
    """Windows of a long word join to what the whole word gives, in bounded memory."""
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bytebpe.read_ranks(BYTE))
    codec = bytebpe.Codec(bytebpe.read_ranks(BYTE), public_tokenizers.PATTERN)
    text = "".join(np.random.default_rng(size).choice(list(letters), size))
    assert bytebpe._numbers(codec.encode([f"one {text} two"])[0]).tolist() == reference.encode_ordinary(f"one {text} two")


def test_windows_equal_the_whole_piece_under_any_ranks():
    """Ranks in random order, so that merged tokens may come before their parts."""
    rng = np.random.default_rng(8)
    for _ in range(5):
        tokens = {"".join(rng.choice(list("abc"), n)).encode() for n in rng.integers(2, 6, 60)}
        order = rng.permutation(256 + len(tokens)).tolist()
        ranks = dict(zip([bytes([i]) for i in range(256)] + sorted(tokens), order))
        codec = bytebpe.Codec(ranks, public_tokenizers.PATTERN)
        for _ in range(4):
            word = "".join(rng.choice(list("abc"), 700)).encode()
            whole, stitched = codec._encoded([word])[word], codec._stitched([word])[word]
            assert whole.tolist() == stitched.tolist()


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 37 % 90) for i in range(50)])], ["a", "b"])
    parts = list(common.pieces(iter([batch]), 200))
    assert len(parts) > 5 and pa.Table.from_batches(parts)["a"].to_pylist() == list(range(50))
