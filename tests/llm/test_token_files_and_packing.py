import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import chunk_encoding, packing, token_files
from folio.llm.chunk_encoding import PLAIN, ChunkEncoder

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb\n\n c  d ", "don't 's I'll 12 345 x9 \t tab", "été é ́x y ́",
    "<|endoftext|> mid <|startoftext|>", "ΑΣ ΑΣ. ß ẞ İ ﬁ", " x y 　z", "日本語 テキスト 한국어 하", "😀 👍🏽 a‍b", "x\x1cy \x1f z",
    "a" * 3000, "word " * 5000, "#$% *** && \u0000 q", "Thonble, THE the.\nRe's",
]


def whole(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunked_encoding_is_exact(path):
    t, mine = whole(path), ChunkEncoder(path)
    for text in TEXTS + ["".join(TEXTS), " ".join(TEXTS)]:
        want = t.encode(text, add_special_tokens=False)
        assert mine.ids(text).tolist() == want.ids, text[:50]
        got = mine.spans(text)
        assert got[:, 0].tolist() == want.ids
        assert [tuple(x) for x in got[:, 1:].tolist()] == want.offsets, text[:50]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_cut_here_is_encoded_as_by_the_library(path):
    t, mine = whole(path), ChunkEncoder(path)
    letters = [c for c in map(chr, range(0x20, 0x250)) if PLAIN[mine.cut].fullmatch(c)]
    assert len(letters) > 400
    rng = random.Random(8)
    texts = [x for c in letters for x in (c, f"a{c}b", f" {c}{c.lower()} ", f"9{c}'s")]
    texts += ["Əliyev", "aƁb", "ƏƆƐ İı ẞ ŉ"] + ["".join(rng.choices(letters + ["ß", "İ", "ǅ", "é", "\n"], k=rng.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        assert mine.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_texts_encoded_together_have_their_own_ids(path, monkeypatch):
    rng = random.Random(5)
    pieces = ["'s", "'", "re", "'ll", "'ve", "l", "d", " ", "  ", "\n", "\n\n", "word", "Été", "12", "&&", ".", "ß", "m", "t"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(6000)] + ["".join(TEXTS), *TEXTS, "", "'", "'s", "s", "\n ", " '", ""]
    wild = [x for c in map(chr, range(0x3001)) if c.isspace() for x in (f"a{c} b", f"a {c}b", f"{c}a", f"a {c}")]
    t, mine = whole(path), ChunkEncoder(path)
    for at_once in (64, 1 << 23):
        monkeypatch.setattr(chunk_encoding, "AT_ONCE", at_once)
        for some in (texts, wild, texts + wild):
            got = list(mine.each(pa.array(["cut off", *some]).slice(1)))
            for text, ids in zip(some, got, strict=True):
                assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:50])
    assert list(mine.each(pa.array([], pa.string()))) == []


def test_a_pretoken_of_many_texts_is_looked_up_once():
    class Asked(dict):
        n = 0

        def __getitem__(self, pretoken):
            Asked.n += 1
            return memory[pretoken]

    mine = ChunkEncoder(BYTE)
    memory, mine._pretoken = mine._pretoken, Asked()
    mine._ids = None  # and no chunk
    got = list(mine.each(pa.array(["Some word.\nSome word", "a word"] * 500)))
    assert len(got) == 1000 and Asked.n == 5  # "Some", " word", ".", "\n", "a"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (3, "dup", None), (3, "dup", None)], "doc_id long, text string, shard string")


def test_token_files_read_back(spark):
    t = whole(BYTE)
    docs = rows(spark, TEXTS)
    got = sorted(token_files.token_file_index(docs, BYTE, seq_len=16, batch_rows=4).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sequences_are_views_of_equal_length(spark, tmp_path):
    shards = token_files.write_token_files(rows(spark, TEXTS), BYTE, f"file://{tmp_path}", seq_len=16, batch_rows=4)
    for s in shards.collect():
        shard = token_files.TokenShard(s.tokens_file)
        n = -(-s.n_tokens // 16)
        found = [shard.sequence(i) for i in range(n)]
        assert all(len(ids) == len(mask) == 16 and not ids.flags.owndata and not mask.flags.owndata for ids, mask in found)
        again = [shard.sequence(i) for i in range(n)]
        assert all(np.shares_memory(x, y) for one, two in zip(found, again) for x, y in zip(one, two))
        assert sum(int(mask.sum()) for _, mask in found) == s.n_tokens


def test_masks_take_no_byte_for_each_id(spark, tmp_path):
    docs = rows(spark, ["word " * 40_000] * 4).coalesce(1)
    for s in token_files.write_token_files(docs, BYTE, f"file://{tmp_path}", seq_len=2048).collect():
        size = (tmp_path / s.tokens_file.split("/")[-1]).stat().st_size
        assert s.n_tokens < 10_000 or size < 2.2 * s.n_tokens  # ids take two bytes
        shard = token_files.TokenShard(s.tokens_file)
        masks = [shard.sequence(i)[1] for i in range(-(-s.n_tokens // 2048))]
        assert np.concatenate(masks).tolist() == [int(i < s.n_tokens) for i in range(2048 * len(masks))]


def test_empty_tables(spark):
    none = rows(spark, []).filter("false")
    assert token_files.token_file_index(none, BYTE).collect() == []
    assert packing.pack_documents(none, WORD).collect() == []


def test_pieces_and_packing(spark):
    t = whole(WORD)
    docs = rows(spark, TEXTS).withColumn("offset", F.lit("clash"))
    got = packing.pack_documents(docs, WORD, capacity=64, keep_ids=True).collect()
    joined = {}
    for r in sorted(got, key=lambda r: r.piece):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        if r.doc_id is not None and r.doc_id != 3:
            assert r.start == len(joined.setdefault(r.doc_id, []))
            joined[r.doc_id] += ids.tolist()
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert joined[i] == [*t.encode(text, add_special_tokens=False).ids, 1]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64


def test_best_two_fit_matches_a_plain_loop():
    """The docstring's rule on lists, without counters or bit sets."""

    def plain(lengths, capacity):
        left, bins = sorted(lengths), []
        while left:
            held, gap = [], capacity
            while fits := [x for x in left if x <= gap]:
                held.append(fits[-1])
                left.remove(fits[-1])
                gap -= fits[-1]
            if gap and left and len(held) > 1:
                room = gap + held[-1]
                pairs = [(a + b, b - a, b, a) for k, a in enumerate(left) for b in left[k + 1 :] if a + b <= room]
                if pairs and max(pairs)[0] > held[-1]:
                    out = held.pop()
                    for x in max(pairs)[2:]:
                        held.append(x)
                        left.remove(x)
                    left = sorted([*left, out])
            bins.append(sorted(held))
        return sorted(bins)

    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = rng.integers(1, 40, rng.integers(1, 60))
        bins, _ = packing.best_two_fit(lengths, 64)
        got = sorted(sorted(lengths[bins == k].tolist()) for k in range(bins.max() + 1))
        assert got == plain(lengths.tolist(), 64)


def test_best_two_fit_is_tight():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.2, 5000).astype(np.int64) + 1)
    bins, offsets = packing.best_two_fit(lengths, 4096)
    loads = np.bincount(bins, lengths)
    assert loads.max() <= 4096 and len(loads) <= -(-lengths.sum() // 4096) + 2
    assert packing.best_two_fit(np.array([], np.int64), 10)[0].size == 0
    # 6 and 3 leave a gap of 1; 2 and 2 fill it in place of the 3
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert np.bincount(bins, [6, 3, 2, 2]).tolist() == [10, 3]
    assert pa.__version__
