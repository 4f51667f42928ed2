"""Exact word-level memos in front of the BPE models of the ``tokenizers`` library.

A text is cut where no token can cross, each distinct piece is encoded once by the library, and the
ids of the pieces are joined. The memos are dictionaries of bounded size that live in the Python
worker, so later tasks on the same executor find the frequent words already encoded.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Regex, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

#: Bytes that a memo may hold; longer keys than LONGEST_KEY are not kept.
MEMO_BYTES, LONGEST_KEY = 80 << 20, 64
EDGE_MARKS = frozenset(b".,;:!?")
# Letters of these ranges are in NFC, are \p{L} in every Unicode version and have one-to-one lower case.
PLAIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+").fullmatch
# ASCII marks that are pre-tokens of their own behind a plain word: no apostrophe, which begins endings, and no underscore.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


@lru_cache(maxsize=1)
def byte_alphabet() -> str:
    """The printable character that stands for each byte 0..255 in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return "".join(table[b] for b in range(256))


@lru_cache(maxsize=1)
def _alphabet_table() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


def as_alphabet(data: bytes) -> str:
    if data.isalpha():  # ASCII letters stand for themselves
        return data.decode()
    return data.decode("latin-1").translate(_alphabet_table())


def pack_ids(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class BoundedMemo(dict):
    """key -> ``compute(key)`` for keys of up to LONGEST_KEY bytes or characters, in two generations of half of MEMO_BYTES.

    A full generation becomes the older one, and the one before it goes; entries that are used again move up, so frequent ones stay.
    """

    held = 0
    #: What an entry's objects and its place in the dictionary take, besides the key's own bytes.
    entry_bytes = 200

    def __init__(self):
        self.older: dict = {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.compute(key)
        if len(key) <= LONGEST_KEY:
            self.held += len(key) + self.entry_bytes + (len(value) if isinstance(value, bytes) else 0)
            if self.held > MEMO_BYTES // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


class WordMemo(BoundedMemo):
    """bytes of a chunk without ASCII white space -> its ids as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space: no token crosses it, so a text's ids are those of its chunks.
    A plain word goes to the BPE model in lower case at once; a run of ASCII marks behind a plain word, no apostrophe
    among them, is encoded by itself, since no pre-token crosses from letters to marks; everything else takes the library's whole chain. ``spell`` spells out
    what looks like a special token; without it such a string becomes that token, as the library does by itself.
    """

    def __init__(self, path: str, spell: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell
        self.model = self.tokenizer.model
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Special tokens that hold white space would be cut at it.
        self.whole_texts = not spell and any(t.special and set(t.content) & set(" \t\n\r\v\f") for t in self.tokenizer.get_added_tokens_decoder().values())

    def compute(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(MARKS)
        marks, text = chunk[len(word) :], word.decode("utf-8", "replace")
        if word.isalpha() or PLAIN_WORD(text):
            low = text.lower().encode()
            if marks:
                return self[low] + self[marks]
            return self[low] if low != word else pack_ids([t.id for t in self.model.tokenize(as_alphabet(word))])
        return self._whole(chunk.decode("utf-8", "replace"))

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, data: bytes) -> bytes:
        if self.whole_texts:
            return self._whole(data.decode("utf-8", "replace"))
        low = data.lower()
        # One entry for all spellings, unless they tell strings apart: added tokens, and letters that combine with a mark in one case only.
        if b"\xcc" not in data and not any(s in low for s in self.added):
            data = low
        return b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def word_memo(path: str, spell: bool = False) -> WordMemo:
    return WordMemo(path, spell)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of vocabulary entries whose concatenation is an entry, by the rank of the concatenation.

    A rank file merges whichever neighbours spell an entry, so each split of an entry counts as a merge.
    """
    pairs = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        pairs += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return pairs


class ChunkMemo(BoundedMemo):
    """A chunk between cuts -> its ids, with a blank before it or none."""

    def __init__(self, bpe: ByteBpe, blank: str):
        super().__init__()
        self.bpe, self.blank = bpe, blank

    def compute(self, chunk: str) -> bytes:
        return self.bpe.chunk(chunk, self.blank)


class ByteBpe:
    """A byte-level BPE from a rank file: encoding, the byte table for decoding, and character offsets."""

    #: A single blank between two characters that no engine takes for white space starts a new match.
    cut = re.compile(r"(?<=\S) (?=\S)").split

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        vocab = {as_alphabet(token): rank for token, rank in ranks.items()}
        merges = [(as_alphabet(a), as_alphabet(b)) for a, b in merges_of(ranks)]
        self.model = BPE(vocab, merges, ignore_merges=True)
        self.splitter = Split(Regex(pattern), "isolated")
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.first, self.after_blank = ChunkMemo(self, ""), ChunkMemo(self, " ")

    def _match(self, piece: str) -> bytes:
        return pack_ids([t.id for t in self.model.tokenize(as_alphabet(piece.encode("utf-8")))])

    def chunk(self, chunk: str, blank: str) -> bytes:
        if not chunk:
            return b""
        if PLAIN_WORD(chunk):
            return self._match(blank + chunk)
        if ord(chunk[-1]) < 128 and ord(chunk[-1]) in EDGE_MARKS and PLAIN_WORD(chunk[:-1]):
            return (self.after_blank if blank else self.first)[chunk[:-1]] + self.first[chunk[-1]]
        return b"".join(self._match(piece) for piece, _ in self.splitter.pre_tokenize_str(blank + chunk))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        head, *rest = self.cut(text)
        return self.first[head] + b"".join(map(self.after_blank.__getitem__, rest))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)
