"""Token ids of whole texts by a public word tokenizer, with the ids of each distinct word kept in memory."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

CACHE_WORDS = 200_000  # distinct words after which a worker forgets those that it has not met since as many words ago
WORDS_AT_ONCE = 4_000  # the tokenizer's own result of a word is much larger than its ids
LONG_WORD = 64  # longer pieces are not remembered

#: The word pattern of the tokenizer, for texts of the characters below.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Anything but these characters sends a text to the tokenizer itself. They are their own composed form, are
#: lower-cased alone, and Python's classes agree with the tokenizer's on them.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ž‐-‧‰-⁞€]")


class WordTokens:
    """Ids of texts: equal to those of the tokenizer file, without special tokens added."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the words remembered earlier
        # words are normal and split already, so their byte letters go straight to the merges
        self.merges = Tokenizer(self.tokenizer.model)
        self.letters = {b: self._letter(b) for b in range(256)}

    @staticmethod
    def _letter(byte: int) -> str:
        """Printable Latin-1 bytes stand for themselves, the others follow from 256 on, in order."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte) if byte in shown else chr(256 + sum(b not in shown for b in range(byte)))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
        pieces: list[list[str] | None] = []
        unknown: set[str] = set()
        for text in texts:
            plain = not OTHER.search(text) and not any(s in text for s in self.special)
            pieces.append(WORD.findall(text.lower()) if plain else None)
            if plain:
                unknown.update(pieces[-1])
        unknown.difference_update(self.words)
        met = unknown.intersection(self.before)
        self.words.update((w, self.before[w]) for w in met)
        new = list(unknown - met)
        extra: dict[str, bytes] = {}
        for first in range(0, len(new), WORDS_AT_ONCE):
            some = new[first : first + WORDS_AT_ONCE]
            spelt = [w.encode().decode("latin-1").translate(self.letters) for w in some]
            for word, found in zip(some, self.merges.encode_batch_fast(spelt, add_special_tokens=False), strict=True):
                (self.words if len(word) <= LONG_WORD else extra)[word] = np.array(found.ids, dtype="<u4").tobytes()
        known = self.words if not extra else self.words | extra
        out = []
        for text, words in zip(texts, pieces, strict=True):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4"))
        return out


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this process, read once."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
