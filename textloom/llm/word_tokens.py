"""Token ids of a tokenizer file, one white-space-free chunk at a time, with a cache that has a size bound.

The file's normalizer composes, lower-cases and folds white space, and its pre-tokenizer drops white space: nothing
crosses it, so the ids of a text are those of its chunks, one after the other. Most chunks of a corpus repeat.
"""

from __future__ import annotations

import re
import struct

CHUNKS = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: What str.split() takes for white space besides.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: Chunks of ASCII and Latin-1 letters: lower() is one to one there, and they are composed.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+")
SPECIAL = "<|"
STOPS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkTokenizer:
    def __init__(self, path: str, cache_size: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cache_size = cache_size
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL not in text and latin(text):
            text = text.lower()
        chunks = CHUNKS.findall(text) if any(c in text for c in CONTROLS) else text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            pass
        for cache in (self.chunks, self.pieces):
            if len(cache) > self.cache_size:
                cache.clear()
        for chunk in set(chunks).difference(self.chunks):
            self.chunks[chunk] = self.encode_chunk(chunk)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode_chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(STOPS)
        if word.isalpha() and latin(word):  # most chunks: a word, perhaps with stops
            return self.piece(word.lower()) + (self.piece(chunk[len(word) :]) if len(word) < len(chunk) else b"")
        if SPECIAL not in chunk and PLAIN.fullmatch(chunk):
            return b"".join(map(self.piece, PIECES.findall(chunk.lower())))
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(letters)]
            got = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return got


def latin(text: str) -> bool:
    """All characters are under U+0100, where lower() is one to one and composing changes nothing."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ready: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker, kept between tasks."""
    if path not in _ready:
        _ready[path] = ChunkTokenizer(path)
    return _ready[path]


def default_path() -> str:
    """The word-level vocabulary of the public tokenizers package; call on the worker, its place may differ there."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
