"""Ids of whole texts by a tokenizer that drops white space, with each distinct run of other characters encoded once.

Such a tokenizer never joins across white space, so a text's ids are those of its runs one after another. A bounded
cache maps runs to ids; what it lacks is encoded by the library itself, alphabetic runs many at a time.
"""

from __future__ import annotations

import os
import string
import unicodedata

import numpy as np


_KEPT: dict[str, CachedIds] = {}


def cached_ids(path: str) -> CachedIds:
    """This process's encoder for a tokenizer: a Python worker keeps it, and what it has cached, from task to task."""
    if path not in _KEPT:
        _KEPT[path] = CachedIds(path)
    return _KEPT[path]


class CachedIds:
    """Little-endian 32-bit ids of a text.

    The cache has two generations of up to `most` runs: a full one becomes the older one, whose runs are taken over when
    they occur again and else forgotten, so frequent runs stay and memory is bounded.
    """

    def __init__(self, path: str, most: int = 300_000, joined: int = 256):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.most, self.joined = Tokenizer.from_file(path), most, joined
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # Words of lower-case ASCII letters pass the normalizer and the splitter unchanged: for them the same model without both.
        self.folds = self._folds()
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _folds(self) -> bool:
        """Whether ASCII letters are only put into lower case before words of them reach the model."""
        letters, normalizer, splitter = string.ascii_letters, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or splitter is None or normalizer.normalize_str(letters) != letters.lower():
            return False
        return [w for w, _ in splitter.pre_tokenize_str(letters.lower())] == [letters.lower()]

    @staticmethod
    def runs(text: str) -> list[str]:
        """Pieces between blanks and line ends, some empty; other white space stays inside and is dropped by the tokenizer."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _encode(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def _missing(self, keys: set[str]) -> set[str]:
        """The keys that are not cached, once those of the older generation are taken over."""
        new = keys.difference(self.known)
        if self.older:
            again = {k for k in new if k in self.older}
            self.known.update({k: self.older[k] for k in again})
            new -= again
        return new

    def _learn_words(self, words: list[str], tokenizer) -> list[str]:
        """Adds the ids of alphabetic words, many in one call; returns those that the normalizer splits or drops."""
        odd = []
        batches = [words[k : k + self.joined] for k in range(0, len(words), self.joined)]
        for group, e in zip(batches, tokenizer.encode_batch_fast([" ".join(g) for g in batches], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                odd += group
                continue
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            self.known.update({w: raw[a:b] for w, a, b in zip(group, [0, *ends[:-1]], ends, strict=True)})
        return odd

    @staticmethod
    def _letters(word: str) -> bool:
        """Whether the tokenizer sees nothing but letters in a word: some letters become a letter and a mark."""
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def learn(self, runs: set[str]) -> None:
        """Adds the ids of runs. ASCII punctuation after letters is a piece of its own to the tokenizer, so such a run's ids
        are those of its word and its tail."""
        made, needed = [], set()
        for r in runs:
            word = r.rstrip(string.punctuation)
            if word is r or not self._letters(word):
                needed.add(r)
            else:
                made.append((r, word, r[len(word) :]))
        needed.update([word for _, word, _ in made], {tail for _, _, tail in made})
        bare, words, rest = [], [], []
        for r in self._missing(needed):
            if not r.isalpha():
                rest.append(r)
            elif self.folds and r.isascii() and r.islower():
                bare.append(r)
            else:
                words.append(r)
        rest += self._learn_words(bare, self.bare) + self._learn_words(words, self.tokenizer)
        self.known.update(zip(rest, self._encode(rest), strict=True))
        known = self.known
        known.update([(r, known[w] + known[tail]) for r, w, tail in made])

    def _lowered(self, text: str) -> str:
        """The text in lower case if the tokenizer makes the same of it, so that fewer runs differ; else the text itself."""
        low = text.lower()
        if not self.folds or any(t in low for t in self.added) or "\u03a3" in text or "\u0130" in text:
            return text
        return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.runs(self._lowered(t)) for t in texts]
        needed = set().union(*parts)
        new = needed.difference(self.known)  # looks up the few, not all that is cached
        if new:
            if len(self.known) + len(new) > self.most:
                self.older, self.known = self.known, {"": b""}
                new = needed
            new = self._missing(new)
            if new:
                self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]
