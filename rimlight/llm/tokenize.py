"""Token ids of many texts with a tokenizer file, each distinct piece encoded once.

Byte-level BPE works inside pre-tokenised pieces, so the ids of a text are those of its pieces in a
row. Texts of common Latin characters are cut by the tokenizer's own pattern and their pieces looked
up; a piece not seen before goes through the library's model. All other texts, and texts with the
string of an added token, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# The split pattern of byte-level pre-tokenizers with ``use_regex``, spelled out for the
# characters of COMMON, of which LETTERS are the letters and 0-9 the only numbers.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
PIECES = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
#: Characters whose class (letter, number, space) no Unicode version or library disputes.
COMMON = r"\t\n\r -~¡-¬®-±´-¸º»¿-ſ‐-―‘-‟"
#: Pieces kept by a worker, some 150 bytes each; the store starts anew when full.
MAX_PIECES = 200_000


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.by_pieces = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                          and not any(config.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")))
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.find = re.compile(PIECES).findall
        self.uncommon = re.compile(f"[^{COMMON}]").search
        self.characters = byte_characters()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)

    def _learn(self, piece: str) -> int:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))]
        k, end = len(self.index), self.used + len(ids)
        if k == len(self.start):
            self.start, self.length = np.resize(self.start, 2 * k), np.resize(self.length, 2 * k)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.used:end] = ids
        self.start[k], self.length[k], self.index[piece] = self.used, len(ids), k
        self.used = end
        return k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_pieces or self.uncommon(t) or any(a in t for a in self.added)]
        for i, found in zip(whole, self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False) if whole else ()):
            out[i] = np.array(found.ids, np.int32)
        if len(self.index) > MAX_PIECES:
            self._clear()
        skip = set(whole)
        for i, text in enumerate(texts):
            if i in skip or not text:
                continue
            pieces = self.find(text)
            at = list(map(self.index.get, pieces))
            if None in at:
                for k, (piece, known) in enumerate(zip(pieces, at)):
                    if known is None:
                        again = self.index.get(piece)
                        at[k] = self._learn(piece) if again is None else again
            at = np.array(at, np.int64)
            n = self.length[at]
            ends = np.cumsum(n)
            out[i] = self.ids[np.repeat(self.start[at] - (ends - n), n) + np.arange(int(ends[-1]))]
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder for all tasks of a worker."""
    return PieceEncoder(path)
