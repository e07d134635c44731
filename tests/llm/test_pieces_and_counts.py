import hashlib

import numpy as np
import pytest

from folio.llm import pieces, token_counts

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL, BYTE, WORD = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "  ", "a", " a ", "a  b   c", "a\n b\t\n", "▁x ▁ y", "日本語 テキスト", "😀 👍🏽 é é", "word " * 3000, "x" * 5000, "\u0000 \x07 <s> </s> <unk> <0x0A>", "1234 5.6\nline\n\nlast", "ﬁ Ａ① ½"]


def table(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "n", "y")] * 2, "doc_id long, text string, ids string")


def test_ids_and_decoding_equal_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = pieces.encode_pieces(table(spark), MODEL)
    digests = {r.doc_id: r for r in pieces.digests(encoded).collect()}
    for r in encoded.filter("doc_id is not null").collect():
        text = TEXTS[r.doc_id] or ""
        want, data = library.encode(text), text.encode()
        assert r.ids == want and r.decoded == library.decode(want)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert len(r.bounds) == len(want) + 1 and r.bounds == sorted(r.bounds) and r.bounds[-1] == len(data)
        for i, (a, b) in zip(r.ids, zip(r.bounds, r.bounds[1:])):
            piece = library.id_to_piece(i)
            if a > 0 and not library.is_byte(i):  # the first piece also holds the dummy prefix
                assert data[a:b].decode().replace(" ", "▁") == piece
    assert len(digests) == len(TEXTS) + 1
    assert pieces.encode_pieces(table(spark).limit(0), MODEL).collect() == []


def test_character_map_and_alignment():
    from sentencepiece import sentencepiece_model_pb2 as proto

    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    model = proto.ModelProto()
    model.ParseFromString(made.serialized_model_proto())
    mine = pieces.Normaliser(model.normalizer_spec)
    for text in [t or "" for t in TEXTS] + ["ＡＢＣ①  ㍿ x ", "ﬃ é が", "  　lead", "tail 　"]:
        want, offsets = made.normalize(text, with_offsets=True)
        got, align = mine.normalise(text)
        assert got == want, text
        assert len(align) == len(got.encode()) + 1 and (np.diff(align) >= 0).all()
        # the library counts code points of the source for each code point of the result
        at, source = 0, text.encode()
        for k, c in enumerate(got):
            assert len(source[: align[at]].decode()) == offsets[k]
            at += len(c.encode())


def test_section_counts(spark):
    import tokenizers

    for path in (BYTE, WORD):
        t = tokenizers.Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for rule in token_counts.RULES:
            got = {}
            for r in token_counts.section_counts(table(spark).filter("doc_id is not null"), path, boundary="\n|x", rule=rule).collect():
                got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
            for i, text in enumerate(TEXTS):
                text = text or ""
                starts = [0] + [k + 1 for k, c in enumerate(text[:-1]) if c in "\nx"]
                ends = [*starts[1:], len(text)]
                want = [0] * len(starts)
                for a, b in t.encode(text, add_special_tokens=False).offsets:
                    shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
                    held = [k for k, n in enumerate(shares) if n]
                    want[{"first": held[0], "last": held[-1], "majority": shares.index(max(shares))}[rule]] += 1
                assert got[i] == {k: (s, e, n) for k, (s, e, n) in enumerate(zip(starts, ends, want))}, (i, rule)
    assert token_counts.section_counts(table(spark).limit(0), BYTE).collect() == []
