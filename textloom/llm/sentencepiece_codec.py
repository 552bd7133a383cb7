"""SentencePiece encoding and decoding by a forward pass that words with a common prefix share.

The vocabulary is byte-pair encoded, so the best path isn't the one of the highest sum of scores: it is the one path on
which every two neighbours are stable, that is, merging their joint text gives just these two pieces. (In a merge that
crosses a border between two pieces, only these two take part up to then, so a chain of stable neighbours is what
merging the whole text gives.) The forward pass keeps, for each end of a prefix, the last piece of the path; a piece
that ends there continues the path at its start if both are stable. One word's states serve every word that begins the
same way: sorted words are the depth-first order of their trie, and only the letters behind the common prefix are new.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
CACHE = 500_000
STOPS = ".,;:!?"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str, cache_size: int = CACHE):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.raw = [b""] * size
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        # A piece that merging its own text doesn't give is never on a path.
        self.reachable = {p for p in self.ids if self.merge(p) == [p]}
        #: The lengths, longest first, of the reachable pieces that end in these three letters.
        self.lengths: dict[str, list[int]] = {}
        for size, end in sorted({(-len(p), p[-3:]) for p in self.reachable if len(p) > 2}):
            self.lengths.setdefault(end, []).append(-size)
        # No piece spans two letters that no piece has side by side: there, a word can be cut before it is looked up.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.stable: dict[tuple[str, str], bool] = {}
        self.cache_size = cache_size
        self.marked: dict[str, tuple] = {}
        self.bare: dict[str, tuple] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-scored neighbours first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, left: str, right: str) -> bool:
        got = self.stable.get((left, right))
        if got is None:
            got = self.stable[left, right] = self.merge(left + right) == [left, right]
        return got

    def encode_words(self, words: list[str]) -> dict[str, tuple]:
        """The ids of each word: a depth-first walk of the words' trie."""
        out, last, before = {}, [""], ""
        reachable, lengths, stable, is_stable = self.reachable, self.lengths, self.stable, self.is_stable
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in (*lengths.get(word[end - 3 : end], ()), 2) if end > 2 else (2,):
                    piece, start = word[end - size : end], end - size
                    if start < 0 or piece not in reachable:
                        continue
                    if not start:
                        break
                    pair = (last[start], piece)
                    if stable[pair] if pair in stable else is_stable(*pair):
                        break
                else:  # just one piece continues the path, so it is this letter
                    piece = word[end - 1]
                last.append(piece)
            path, end = [], len(word)
            while end:
                path.append(last[end])
                end -= len(last[end])
            out[word] = tuple(i for p in reversed(path) for i in self.piece_ids(p))
            before = word
        return out

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """The text's words as (marked, word); a marked word is written without its mark. Newlines are words."""
        out: list[tuple[bool, str]] = []
        if not text:
            return out
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append((False, "\n"))
            parts = line.split(" ")
            if "" in parts or MARK in line:
                given = (line if n else " " + line).replace(" ", MARK)
                out += [(True, w[1:]) if w[0] == MARK and len(w) > 1 and w[1] != MARK else (False, w) for w in RUNS.findall(given)]
                continue
            out.append((not n, parts[0]))
            out += [(True, w) for w in parts[1:]]
        return out

    def prepare(self, texts: list[str]) -> list[list[tuple[bool, str]]]:
        """The words of all texts, with the ids of each in the caches: the new ones go through one trie."""
        for cache in (self.marked, self.bare):
            if len(cache) > self.cache_size:
                cache.clear()
        if len(self.stable) > 2 * self.cache_size:
            self.stable.clear()
        split = [self.pieces(t) for t in texts]
        new = {x for words in split for x in words if x[1] not in (self.marked if x[0] else self.bare)}
        cut = {x: self.cut(x[1]) for x in new}
        cores = {(x[0], core) for x, (core, _) in cut.items()} | {(False, tail) for _, tail in cut.values() if tail}
        cores = {x for x in cores if x[1] not in (self.marked if x[0] else self.bare)}
        ids = self.encode_words([MARK + w if m else w for m, w in cores])
        for m, w in cores:
            (self.marked if m else self.bare)[w] = ids[MARK + w if m else w]
        for (m, w), (core, tail) in cut.items():
            if tail:
                own = self.marked if m else self.bare
                own[w] = own[core] + self.bare[tail]
        return split

    def cut(self, word: str) -> tuple[str, str]:
        """The word without the stops at its end, and these, if no piece spans the place between."""
        core = word.rstrip(STOPS)
        at = len(core)
        if not 0 < at < len(word) or word[at - 1 : at + 1] in self.joined:
            return word, ""
        return core, word[at:]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        marked, bare = self.marked, self.bare
        return [[i for m, w in words for i in (marked[w] if m else bare[w])] for words in self.prepare(texts)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ready: dict[str, PieceCodec] = {}


def piece_codec(path: str | None) -> PieceCodec:
    path = path or default_path()
    if path not in _ready:
        _ready[path] = PieceCodec(path)
    return _ready[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, batch: int = 512) -> DataFrame:
    """One row per document: id_col, ids (array<int>, as the library encodes the text) and decoded, the ids' text.

    Tasks are independent; each holds `batch` texts and a cache of bounded size. A null or empty text has no ids.
    Decoding gives the text back but for the mark character itself, which reads as a space. Repeated rows are encoded
    each; other columns of docs are ignored.
    """
    import pyarrow as pa

    def run(batches):
        codec = piece_codec(path)
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch)
                ids = codec.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
