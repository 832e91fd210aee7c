"""Public tokenisers read from files; the folder is a parameter and nothing is copied or trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

FOLDER = "/opt/tokenizers"
#: The pre-tokenisation pattern published with the byte-level vocabulary.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts beyond this many characters are encoded in pieces cut at white space.
LONG = 1 << 19


def pieces(text: str, limit: int = LONG) -> list[str]:
    """Cut before single spaces between other characters, so that no piece but one without any is much over the limit."""
    out, lo = [], 0
    while len(text) - lo > limit:
        hi = text.find(" ", lo + limit)
        while hi >= 0 and (text[hi - 1].isspace() or text[hi + 1 : hi + 2].isspace() or hi + 1 == len(text)):
            hi = text.find(" ", hi + 1)
        if hi < 0:
            break
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


class PieceVocabulary:
    """A sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.size)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        if max(map(len, texts), default=0) <= LONG:
            return self.model.encode(texts, num_threads=1)
        # the model puts a space before every text, so a piece goes without its own
        return [[k for n, part in enumerate(pieces(t)) for k in self.model.encode(part[n > 0 :])] for t in texts]


class ByteVocabulary:
    """A byte-level BPE vocabulary in rank form."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[[k for b, k in ranks.items() if len(b) == 1 and b[0] >= 128]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(t) if len(t) <= LONG else [k for part in pieces(t) for k in self.coder.encode_ordinary(part)] for t in texts]

    def decode(self, ids) -> str:
        return self.coder.decode([int(k) for k in ids])


@lru_cache(maxsize=4)
def load(name: str, folder: str = FOLDER) -> PieceVocabulary | ByteVocabulary:
    """The vocabulary in a file, kept by each worker process."""
    path = os.path.join(folder, name)
    return PieceVocabulary(path) if name.endswith(".model") else ByteVocabulary(path)
