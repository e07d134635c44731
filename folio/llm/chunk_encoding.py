"""Exact encoding of whole texts with the tokenizers library, chunk by chunk.

A BPE merge never crosses a pretoken, so a text that is cut only where its pretokenizer always cuts
has the ids of its chunks, one after the other. A worker encodes each distinct chunk once and
remembers it; the memory is emptied when it is full, so its size does not depend on the input.

Where the cut is made depends on the tokenizer's own declaration:

* byte-level pattern without a normaliser: a single space between two other characters that aren't
  white space starts a new pretoken;
* a normaliser that folds white space and a pattern that removes it: every space and line feed;
* anything else: the text is not cut.

Many plain texts at once (``each``) are cut into pretokens where their bytes lie, and each distinct
pretoken of all of them is looked up once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that each of a worker's memories holds at most.
REMEMBERED = 700_000
#: Longer chunks are encoded each time.
LONGEST_REMEMBERED = 256
#: Bytes of the texts whose pretokens are made distinct at once.
AT_ONCE = 1 << 23

#: Chunks of these characters only are cut into pretokens here, and the library's model encodes the
#: pretokens, which recur far more often than chunks do. The classes of these characters
#: are the same in every version of Unicode. Other chunks go through the library's whole chain.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ɏ"

def _plain(lowered: bool) -> re.Pattern:
    """Texts of printable ASCII, line feeds and LETTERS; if they are ``lowered`` first, only of the
    letters whose lower case is one of LETTERS too."""
    letters = [c for c in map(chr, range(0x80, 0x250)) if re.fullmatch(f"[{LETTERS}]", c)]
    fine = [c for c in letters if not lowered or re.fullmatch(f"[{LETTERS}]", c.lower())]
    return re.compile(f"[\\n -~{''.join(fine)}]*")


PLAIN = {"leading": _plain(False), "removed": _plain(True)}
PRETOKENS = {
    "leading": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"),
    "removed": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+"),
}
#: The kind of each byte of a text that is ``PLAIN["leading"]``; bytes from 0x80 on are parts of letters.
LETTER, DIGIT, OTHER, SPACE, LINE_FEED = range(5)
KINDS = np.array([LETTER if b >= 0x80 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SPACE if b == 0x20 else LINE_FEED if b == 0x0A else OTHER for b in range(256)], np.uint8)
BESIDE_SPACE = re.compile(r" \s|\s ")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = value
        return value


class ChunkEncoder:
    """``ids(text)``: ids as a numpy array; ``spans(text)``: ids with the code points of each token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.cut = _cut_rule(declared)
        self.lead = " " if self.cut == "leading" else ""
        self.model = self.tokenizer.model
        self.type_code = "H" if self.dtype.itemsize == 2 else "I"
        self._pretoken = _Memory(self._encode_pretoken)
        self._ids = _Memory(lambda chunk: self._encode(self.lead + chunk))
        self._spans = _Memory(lambda chunk: self._encode_spans(self.lead + chunk))

    def _encode_pretoken(self, pretoken: str) -> bytes:
        return array(self.type_code, [t.id for t in self.model.tokenize(_as_bytes(pretoken))]).tobytes()

    def _encode(self, chunk: str) -> bytes:
        if self.cut != "whole" and PLAIN[self.cut].fullmatch(chunk):
            pretokens = PRETOKENS[self.cut].findall(chunk.lower() if self.cut == "removed" else chunk)
            return b"".join(map(self._pretoken.__getitem__, pretokens))
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode_spans(self, chunk: str) -> tuple[bytes, int, int]:
        if self.cut == "leading" and chunk.isascii() and PLAIN[self.cut].fullmatch(chunk):  # a character is a byte: a token is as long as its letters
            rows, at = array("i"), 0
            for pretoken in PRETOKENS[self.cut].findall(chunk):
                for t in self.model.tokenize(_as_bytes(pretoken)):
                    rows.extend((t.id, at, at := at + len(t.value)))
            return rows.tobytes(), len(rows) // 3, len(chunk)
        got = self.tokenizer.encode(chunk, add_special_tokens=False)
        rows = array("i", [x for i, (a, b) in zip(got.ids, got.offsets) for x in (i, a, b)])
        return rows.tobytes(), len(rows) // 3, len(chunk)

    def _chunks(self, text: str) -> list[str]:
        if self.cut == "leading":
            return LONE_SPACE.split(text) if BESIDE_SPACE.search(text) else text.split(" ")
        if self.cut == "removed":
            return text.replace("\n", " ").split(" ")
        return [text]

    def ids(self, text: str) -> np.ndarray:
        first, *rest = self._chunks(text)
        head = self._encode(first) if self.lead else self._ids[first]
        return np.frombuffer(head + b"".join(map(self._ids.__getitem__, rest)), self.dtype)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``ids`` of each text."""
        if self.cut != "leading":
            yield from (self.ids(text) for text in texts.to_pylist())
            return
        texts = texts.cast(pa.large_string())
        run = pc.binary_length(texts).to_numpy().cumsum() // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)]
        for a, b in zip(edges, edges[1:]):
            some = texts.slice(a, b - a)
            plain = pc.match_substring_regex(some, rf"\A(?:{PLAIN['leading'].pattern})\z")
            found = self._plain_ids(some.filter(plain))
            yield from (next(found) if p else self.ids(text.as_py()) for p, text in zip(plain.to_pylist(), some))

    def _plain_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        starts = _pretoken_starts(raw, edges)
        bounds = pa.py_buffer(np.append(starts, len(raw)))
        pretokens = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(raw)).dictionary_encode()
        which = pretokens.indices.to_numpy()
        coded = list(map(self._pretoken.__getitem__, pretokens.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()])), pa.array(np.frombuffer(b"".join(coded), self.dtype)))
        ids = lists.take(pretokens.indices).flatten().to_numpy()
        at = np.concatenate([[0], sizes[which].cumsum()])[np.searchsorted(starts, edges)]
        for a, b in zip(at, at[1:]):
            yield ids[a:b]

    def spans(self, text: str) -> np.ndarray:
        """int32 rows (id, first code point, end) in the order of the text."""
        first, *rest = self._chunks(text)
        found = [self._encode_spans(first), *map(self._spans.__getitem__, rest)]
        rows = np.frombuffer(b"".join([f[0] for f in found]), "<i4").reshape(-1, 3).copy()
        counts = np.fromiter((f[1] for f in found), np.int64, len(found))
        widths = np.fromiter((f[2] for f in found), np.int64, len(found))
        if not self.lead and self.cut == "removed":
            widths += 1  # the space or line feed that was removed
        shift = np.repeat(np.cumsum(widths) - widths, counts).astype(np.int32)
        rows[:, 1] += shift
        rows[:, 2] += shift
        return rows


def _pretoken_starts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where ``PRETOKENS["leading"]`` cuts the texts between ``edges``, each of them ``PLAIN["leading"]``."""
    n = len(raw)
    kind = KINDS[raw]
    white = kind >= SPACE
    first = np.zeros(n + 1, bool)  # a text begins, or all texts end
    first[edges] = True
    start = first.copy()
    inner = ~first[1:n]  # between two characters of a text
    before, after = kind[:-1], kind[1:]
    # a run of one kind begins; a space goes with what follows it; white space is one kind
    start[1:n] |= (before != after) & (before != SPACE) & ~(white[:-1] & white[1:])
    # the last of several white spaces stands alone or with what follows it, unless the text ends there
    start[1 : n - 1] |= white[: n - 2] & white[1 : n - 1] & ~white[2:] & inner[: n - 2] & ~first[2:n] if n > 2 else False
    # contractions: the apostrophe begins a pretoken, the cut behind it moves behind the letters
    for at in (at for at in np.flatnonzero((raw == 0x27) & start[:n]).tolist()):
        ending = raw[at + 1 : at + 3].tobytes()
        for letters in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            if ending.startswith(letters) and not first[at + 1 : at + 1 + len(letters)].any():
                start[at + 1 : at + 1 + len(letters)] = False
                start[at + 1 + len(letters)] = True
    return np.flatnonzero(start[:n])


def _byte_letters() -> dict[int, str]:
    """Byte → the character that stands for it in byte-level vocabularies: itself if it is printable
    Latin-1 other than the soft hyphen, else the next character from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _as_bytes(pretoken: str) -> str:
    if pretoken.isascii() and pretoken.isprintable():
        return pretoken.replace(" ", BYTE_LETTERS[0x20])
    return pretoken.encode().decode("latin-1").translate(BYTE_LETTERS)


def _cut_rule(declared: dict) -> str:
    pre, norm = declared.get("pre_tokenizer") or {}, declared.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "leading"
    steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
    folds = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in (norm or {}).get("normalizers", []))
    splits = [s for s in pre.get("pretokenizers", []) if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    if folds and splits and set(steps) <= {"NFC", "Replace", "Lowercase"}:
        return "removed"
    return "whole"


@cache
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and vocabulary."""
    return ChunkEncoder(path)
