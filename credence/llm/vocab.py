"""Ids of the public word tokenizer for whole texts: distinct words go to the library once, arrays do the rest.

A text goes to the library whole where the arrays' rules might differ from it: it spells a special token, or holds
combining marks, unassigned code points or code points from U+2E80 on, where Unicode versions differ.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .common import runs_of
from .textvec import MARK, UNKNOWN, Scan, WordIds, split_words

#: Characters scanned at a time.
RUN_CHARS = 1_500_000
_PLAIN_BELOW = 0x2E80


@functools.cache
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordTokenizer:
    def __init__(self, path: str):
        self.library = library(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.cache = WordIds(self._words, limit=600_000)

    def _words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in self.library.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        return out

    def _plain(self, text: str) -> str | None:
        """The normalised text, or None where the library has to see it whole."""
        if "<|" in text and any(x in text for x in self.special):
            return None
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str]):
        """Yield one uint32 array of ids for each text, in order."""
        for i, j in runs_of(texts, RUN_CHARS):
            plain = [self._plain(x) for x in texts[i:j]]
            s = Scan([x or "" for x in plain])
            odd = (s.cp >= _PLAIN_BELOW) | (s.cls == MARK) | (s.cls == UNKNOWN)
            whole = set(np.searchsorted(s.last, np.flatnonzero(odd)).tolist()) if odd.any() else set()
            ids, at = self.cache.ids(s, *split_words(s))
            for k in range(j - i):
                if plain[k] is None or k in whole:
                    yield np.array(self.library.encode(texts[i + k], add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[at[k] : at[k + 1]]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
