"""Token ids of whole texts by a public tokenizer, with each worker's memory of words it has met.

The tokenizers used here drop white space and never join across it, so a text's ids are those of its words one
after another. Words are hashed all at once (64 bits), each distinct word of a chunk is looked up once, and words
not met yet are encoded together.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np

from .minhash_dedup import Powers, located_words

#: When a worker has met so many words, those met in one chunk alone are forgotten; bounds its memory.
MOST_WORDS = 700_000


class WordCoder:
    """Encodes texts given as UTF-8 bytes; ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str, most_words: int = MOST_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.most_words = most_words
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word of letters
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.marks = {m: self._encoded([m]) for m in (b".", b",")}
        self.powers = Powers()
        self._forget(np.zeros(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Keeps the words at `kept` of the table only: keys in order, ids from starts on, sizes, chunks that met them."""
        if not len(kept):
            self.keys, self.starts, self.sizes, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)
            self.ids = np.zeros(0, "<u4")
            return
        ids = self._gathered(kept)
        self.keys, self.sizes = self.keys[kept], self.sizes[kept]
        self.starts, self.met, self.ids = (np.cumsum(self.sizes) - self.sizes).astype(np.int32), np.zeros(len(kept), np.int8), ids

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of the table's words at `at`, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words. Those of Latin letters alone are one piece of text to the tokenizer each, so that many
        can be encoded as one text and told apart by the ids that end a word."""
        texts = [w.decode() for w in words]
        one = np.array([w.isalpha() and max(w) < "ɐ" for w in map(str.lower, texts)], bool)
        letters, others = np.flatnonzero(one), np.flatnonzero(~one)
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        groups = [letters[k : k + 2000] for k in range(0, len(letters), 2000)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some]) for some in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            last = np.flatnonzero(self.closes[ids])
            if len(last) != len(some):
                raise ValueError("the tokenizer parts words of letters")
            sizes[some] = np.diff(last, prepend=-1)
            parts.append(ids)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)):
            sizes[i] = len(e.ids)
            parts.append(np.array(e.ids, "<u4"))
        order = np.concatenate([letters, others])
        ids, n = np.concatenate([*parts, np.zeros(0, "<u4")]), sizes[order]
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(n) - n
        ends = np.cumsum(sizes)
        return ids[np.arange(len(ids)) + np.repeat(starts - (ends - sizes), sizes)], sizes

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the table keys are or belong, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        starts = np.cumsum(sizes) - sizes + len(self.ids)
        self.keys, self.starts, self.sizes, self.met = (np.insert(a, at, b) for a, b in ((self.keys, keys[order]), (self.starts, starts[order]), (self.sizes, sizes[order]), (self.met, np.int8(0))))
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Adds words with these keys. A word with one stop or comma at its end is the word and the mark."""
        tail = np.array([w[-1] in b".," and len(w) > 1 and w[-2:-1].isalnum() for w in words], bool)
        tails = np.flatnonzero(tail)
        if len(tails):
            ids, sizes, _ = self._spans([b" ".join([words[i][:-1] for i in tails])])
            marks = np.concatenate([self.marks[words[i][-1:]][0] for i in tails])
            self._add(keys[tails], np.insert(ids, np.cumsum(sizes), marks), sizes + 1)
        plain = np.flatnonzero(~tail)
        plain = plain[~self._place(keys[plain])[1]]  # a stem may be there by now
        if len(plain):
            self._add(keys[plain], *self._encoded([words[i] for i in plain]))

    def spans(self, texts: list[bytes], located: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words of all texts, how many each word has, each text's first word and the end); located: located_words() of the texts, if known."""
        if len(self.keys) > self.most_words:
            again = np.flatnonzero(self.met > 1)
            self._forget(again if len(again) <= self.most_words // 2 else again[:0])
        return self._spans(texts, located)

    def _spans(self, texts: list[bytes], located: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashed, first, joined, starts, ends = located or located_words(texts, self.powers)
        odd = np.unique(np.searchsorted(starts, [m.start() for m in self.special.finditer(joined)], "right") - 1) if self.special else np.zeros(0, int)
        if len(odd):
            hashed = hashed.copy()  # the caller's stay
        for i in odd.tolist():
            hashed[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest())
        keys, some, back = np.unique(hashed, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._place(keys)[1])
        if len(new):
            at = some[new]
            words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn(keys[new], [w if self.special and self.special.search(w) else w.lower() for w in words])
        at = self._place(keys)[0]
        self.met[at] = np.minimum(self.met[at], 1) + 1
        at = at[back]
        return self._gathered(at), self.sizes[at].astype(np.int64), first

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, sizes, first = self.spans(texts)
        ends = (4 * np.concatenate([[0], np.cumsum(sizes)])[first]).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


_CODERS: dict[tuple[str, int], WordCoder] = {}


def coder(path: str, most_words: int = MOST_WORDS) -> WordCoder:
    """This worker's coder for the tokenizer file at path."""
    if (path, most_words) not in _CODERS:
        _CODERS[path, most_words] = WordCoder(path, most_words)
    return _CODERS[path, most_words]


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
