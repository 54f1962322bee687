"""BPE encoding and decoding by dynamic programming over prefixes.

For a byte-level vocabulary, the encoding of a text piece is the one sequence of tokens whose
neighbours are all compatible: two tokens are, if merging the bytes of both ends in just these two. So
the last token of each prefix is unique: of the vocabulary's tokens that end there (an Aho-Corasick
automaton over the vocabulary gives them, longest first), the first that is compatible with the last
token of the prefix before it. Back-pointers from the end give the ids. Time is linear in the piece,
however long it is. Pieces come from the tokenizer's own split; encodings of pieces are remembered in
each worker, up to a bound, as pieces repeat.

Defined results: null and empty texts give no ids; special tokens written in a text become their ids,
as the tokenizers library does by default; repeated rows give repeated rows; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, table

#: The split of byte-level tokenizers of this kind (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pieces a generation and pairs of tokens that a worker remembers; new words keep making pairs that others made before.
REMEMBERED, PAIRS = 120_000, 400_000
SPEC = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_names() -> dict[str, int]:
    """The characters under which a byte-level vocabulary file lists bytes: printable Latin-1 as
    themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces(dict):
    """Ids of pieces, in two generations: a full one becomes the old one, and what is met again comes
    back from it, so frequent pieces stay. Pieces of over 64 characters are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.encode()), dtype="<u4").tobytes()
            if len(piece) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file (bytes of a tokenizers JSON)."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.text = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.text.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, its two parts
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[ids[a], ids[b]] = rank
            self.made.setdefault(ids[a + b], (rank, ids[a], ids[b]))
        self.automaton = ahocorasick.Automaton()
        # a token that no merge makes never comes about
        for b, i in ids.items():
            if len(b) == 1 or i in self.made:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece)
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def forget(self) -> None:
        """Drops what was remembered; the worker may next serve another operator."""
        self.pieces.clear()
        self.pieces.old.clear()
        self.pairs.clear()
        self.spines.clear()

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts on the right (side 2) or left (1) edge of a token, each with the rank of the merge
        that takes it up."""
        if (found := self.spines.get((token, side))) is None:
            found, up = [], float("inf")
            while True:
                found.append((token, up))
                if token not in self.made:
                    break
                up, token = self.made[token][0], self.made[token][side]
            self.spines[found[0][0], side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those inside. Of equal merges
        the leftmost goes first: one inside a before, one inside b after the border's."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            known = True
            for p, p_up in self.spine(a, 2):
                for q, q_up in self.spine(b, 1):
                    r = self.rank.get((p, q))
                    if r is not None and r < p_up and r <= q_up:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, came, known = [-1] * (n + 1), [0] * (n + 1), self.pairs
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known.get(before << 32 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[at], came[at] = token, start
        out = []
        while n:
            out.append(last[n])
            n = came[n]
        return out[::-1]

    def encode_plain(self, text: str) -> bytes:
        split = self.split_ascii if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.split
        return b"".join(map(self.pieces.__getitem__, split.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        cut = self.specials.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self.encode_plain(p) for i, p in enumerate(cut))

    def decode(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_built: dict[bytes, Bpe] = {}


def built(file: bytes) -> Bpe:
    """One encoder for each vocabulary and worker."""
    key = hashlib.sha256(file).digest()
    if key not in _built:
        _built[key] = Bpe(file)
    return _built[key]


def bpe_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded text of every whole text and
    the digests of both. vocabulary: path of a tokenizers file on the driver; its bytes (a few MB) are
    broadcast."""
    with open(vocabulary, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = built(file.value)

        def work(texts):
            ids = [bpe.encode(t) for t in texts]
            return {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "decoded": pa.array([bpe.decode(x) for x in ids], pa.string()),
            }

        work.done = bpe.forget
        return work

    rows = over_texts(docs.select("doc_id", "text"), make, SPEC)
    return rows.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    rows = bpe_documents(table(spark, sf_dir, "documents"), default_vocabulary())
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
