"""Operator 6: SentencePiece encoding that keeps offsets, and decoding.

The text is normalised here as the model file declares: at each position the longest prefix found
in the compiled character map (a double-array trie over UTF-8 bytes) is replaced, other characters
stay, and every byte of the result records the byte of the source that it comes from. White space
becomes U+2581, with a dummy prefix and without surplus blanks if the model says so. The library
then segments the normalised text, and each piece is projected through the recorded alignment to a
span of the original bytes.

If no piece of the vocabulary has U+2581 after another character, no merge crosses the start of a
run of U+2581, so a text is segmented run by run, and a worker remembers the segments it has seen;
its memory is emptied when full.

Nulls: a null text is empty (no ids), a null doc_id is kept. Repeated rows are encoded as often as
they come; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import whole_text

SPACE = "▁"
REMEMBERED = 700_000
LONGEST_REMEMBERED = 256
ROWS_OUT = 512


class CharacterMap:
    """The compiled character map of a model: longest prefix of bytes → replacement."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest prefix of ``data[at:]`` in the map."""
        units, found = self.units, None
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source."""
        if self.map is None and not self.squeeze and self.escape:
            return self._plain(text)
        return self._mapped(text.encode())

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int32)
        source = np.frombuffer(text.encode(), np.uint8)
        widths = np.where(source == 0x20, 3, 1)
        align = np.repeat(np.arange(len(source), dtype=np.int32), widths)
        head = [0] * 3 if self.dummy else []
        return SPACE * self.dummy + text.replace(" ", SPACE), np.concatenate([np.array(head, np.int32), align, np.array([len(source)], np.int32)])

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        first = data[at]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + width], width

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data):
                piece, width = self._prefix(data, at)
                if piece != b" ":
                    break
                at += width
        if at == len(data):
            return "", np.array([at], np.int32)

        def put(piece: bytes) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.dummy:
            put(space)
        blank = self.squeeze
        while at < len(data):
            piece, width = self._prefix(data, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", space))
                blank = self.squeeze and piece.endswith(b" ")
            at += width
        end = at
        if self.squeeze:
            while out.endswith(space):
                del out[len(out) - len(space) :]
                end = align[len(out)]
                del align[len(out) :]
        return out.decode(), np.array([*align, end], np.int32)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(model.normalizer_spec)
        plain = proto.ModelProto()
        plain.CopyFrom(model)
        plain.normalizer_spec.CopyFrom(proto.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=model.normalizer_spec.escape_whitespaces))
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        self.byte_ids = {i for i in range(len(model.pieces)) if self.library.is_byte(i)}
        self.widths = [1 if i in self.byte_ids else len(p.piece.encode()) for i, p in enumerate(model.pieces)]
        self.unknown = self.library.unk_id()
        self.runs = model.normalizer_spec.escape_whitespaces and not any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        self.seen: dict[str, tuple[bytes, bytes]] = {}

    def _segment(self, text: str) -> tuple[bytes, bytes]:
        """Ids and byte lengths of the pieces of a normalised segment."""
        found = self.seen.get(text)
        if found is None:
            raw = text.replace(SPACE, " ")
            ids = self.segmenter.encode(raw)
            if self.unknown in ids:
                got = self.segmenter.encode(raw, out_type="immutable_proto")
                widths = [1 if p.id in self.byte_ids else len(p.piece.encode()) if p.id != self.unknown else len(p.surface.replace(" ", SPACE).encode()) for p in got.pieces]
            else:
                widths = [self.widths[i] for i in ids]
            found = array("i", ids).tobytes(), array("i", widths).tobytes()
            if len(text) <= LONGEST_REMEMBERED:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[text] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the bounds of the pieces in the bytes of the source: piece i covers
        ``bounds[i]`` to ``bounds[i + 1]``."""
        normal, align = self.normaliser.normalise(text)
        if not normal:
            return np.empty(0, np.int32), align[-1:]
        if not self.runs:
            segments = [normal]
        elif SPACE * 2 not in normal and normal[0] == SPACE:
            segments = [SPACE + w for w in normal.split(SPACE)[1:]]
        else:
            segments = [s for s in re.findall(f"{SPACE}*[^{SPACE}]*", normal) if s]
        found = list(map(self._segment, segments))
        ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), np.int32))
        return ids, align[np.concatenate([[0], ends])]


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, bounds (one more than ids; bytes of the text) and the decoded text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_encoder(model_path)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(a, ROWS_OUT)
                got = [pieces.encode(t.as_py()) for t in batch.column(1)]
                decoded = [pieces.library.decode(ids.tolist()) for ids, _ in got]
                lists = []
                for k in (0, 1):
                    offsets = np.concatenate([[0], np.cumsum([len(g[k]) for g in got])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([g[k] for g in got]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "bounds", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, bounds array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
