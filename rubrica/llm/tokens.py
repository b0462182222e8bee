"""Token ids of whole texts, with a bounded cache of words.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words
one after the other. Words repeat, and an id list once computed serves every later occurrence; only
unseen words reach the tokenizer. The cache lives as long as the Python worker and drops its less used
half when full, so memory does not grow with the corpus.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, repeat
from string import ascii_letters

import numpy as np

from rubrica.llm.common import BLANKS, blocks, cut_text

#: Words the cache holds before the less used half goes.
CACHE_WORDS = 800_000
#: Words given to the tokenizer in one call.
AT_ONCE = 4096
#: Characters encoded at a time; a longer text is cut at white space.
PIECE = 1 << 20
#: Sentence marks that end a word, behind a letter.
MARKS = b".,;:!?"
#: Words of small letters of which each is one character in every normal form that composes.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Stands behind every text among the words: bytes that no text has in UTF-8.
_TEXT_END = b"\n\xff\n"
_IS_MARK, _IS_LETTER, _IS_BLANK = (np.isin(np.arange(256), list(own)) for own in (MARKS, ascii_letters.encode(), BLANKS.encode()))


def _marks_apart(raw: bytes) -> bytes:
    """A blank before every single mark between a letter and a blank, so that the word and the mark are looked up apart."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_IS_MARK[data[1:-1]]) + 1
    at = at[_IS_LETTER[data[at - 1]] & _IS_BLANK[data[at + 1]]]
    return np.insert(data, at, 32).tobytes() if len(at) else raw


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        # a task has one core: the tokenizer's own threads would only contend for it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache_words = cache_words
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.uses = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0
        self._append(_TEXT_END.split(), np.zeros(0, np.uint32), np.zeros(1, np.int64))  # place 0, no ids

    def _halve(self) -> None:
        """Keep the words used most since the last time."""
        uses = self.uses[: len(self.known)]
        kept = np.zeros(len(uses), bool)
        kept[np.argsort(uses, kind="stable")[len(uses) - self.cache_words // 2 :]] = True
        kept[0] = False  # the text end is there from the start
        words = [w for w, k in self.known.items() if kept[k]]
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size, flat = self.size[at], self._flat(at)
        self._empty()
        self._append(words, flat, size)

    def _learn(self, words: list[bytes]) -> None:
        """Add unseen words to the cache, each given once. Marks behind a letter are apart to the vocabulary, so
        a word with them takes the ids of its two parts."""
        small = [w for w in words if w.isalpha() and w.islower()]
        self._learn_letters(small, b" ".join(small).decode().split())
        parted, stems, marks, plain = [], [], [], []
        for w in words if len(small) < len(words) else []:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem[-1:].isalpha():
                parted.append(w)
                stems.append(stem)
                marks.append(w[len(stem) :])
            else:
                plain.append(w)
        rest: list[bytes] = []
        letters, texts = [], []
        for w in dict.fromkeys(chain(plain, stems, marks)):
            if w in self.known:
                continue
            if _LETTERS.fullmatch(text := w.decode("utf-8", "surrogatepass")):
                letters.append(w)
                texts.append(self.as_bytes.pre_tokenize_str(text)[0][0])
            else:
                rest.append(w)
        self._learn_letters(letters, texts)
        for k in range(0, len(rest), AT_ONCE):
            some = rest[k : k + AT_ONCE]
            text = [w.decode("utf-8", "surrogatepass") for w in some]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
            self._append(some, np.array([i for own in ids for i in own], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        if parted:
            place = self.known.__getitem__
            both = np.fromiter(chain(map(place, stems), map(place, marks)), np.int64, 2 * len(parted)).reshape(2, -1)
            self._append(parted, self._flat(both.T.ravel()), self.size[both[0]] + self.size[both[1]])

    def _learn_letters(self, words: list[bytes], texts: list[str]) -> None:
        """Words with nothing to normalise or to cut: the vocabulary's merges alone, over their bytes, give their ids."""
        merge = self.tokenizer.model.tokenize
        for k in range(0, len(words), AT_ONCE):
            ids = [[token.id for token in merge(text)] for text in texts[k : k + AT_ONCE]]
            flat, sizes = chain.from_iterable(ids), map(len, ids)
            self._append(words[k : k + AT_ONCE], np.fromiter(flat, np.uint32), np.fromiter(sizes, np.int64, len(ids)))

    def _flat(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after the other."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]

    def _append(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, count = len(self.known), len(words)
        while first + count > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[first : first + count] = sizes
        self.start[first : first + count] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(words, range(first, first + count)))

    def places(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of the words of all texts, a text end behind each, and where the text ends stand."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        words = _marks_apart(b"".join([(r if b"<|" in r else r.lower()) + _TEXT_END for r in raw])).split()
        if len(self.known) > self.cache_words:
            self._halve()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(words[k] for k in missing)))
            at[missing] = [self.known[words[k]] for k in missing]
        np.add.at(self.uses, at, 1)
        return at, np.flatnonzero(at == 0)

    def encode_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of short texts, together."""
        at, text_ends = self.places(texts)
        flat, ends = self._flat(at), np.cumsum(self.size[at])
        bounds = np.concatenate([[0], ends[text_ends]])
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def count_many(self, texts: Sequence[str], counts: np.ndarray) -> None:
        """Add the texts' ids to ``counts`` without listing them."""
        at, _ = self.places(texts)
        words, times = np.unique(at, return_counts=True)
        counts += np.bincount(self._flat(words), np.repeat(times, self.size[words]), minlength=len(counts)).astype(np.int64)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, about ``PIECE`` characters at a time."""
        for run in blocks((t or "" for t in texts), PIECE):
            if len(run) == 1 and len(run[0]) > PIECE:
                yield np.concatenate([self.encode_many([piece])[0] for piece in cut_text(run[0], PIECE)])
            else:
                yield from self.encode_many(run)

    def count_all(self, texts: Iterable[str | None], counts: np.ndarray) -> None:
        for run in blocks((t or "" for t in texts), PIECE):
            for part in [[piece] for piece in cut_text(run[0], PIECE)] if len(run) == 1 else [run]:
                self.count_many(part, counts)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """The 49,408-word vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
