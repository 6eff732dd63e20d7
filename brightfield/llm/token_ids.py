"""Encoding texts with a public tokenizer file through its library.

A worker remembers the ids of words, and the library encodes only the unseen ones, where a file is of one of two kinds:

* It cuts at white space and drops it, so that the ids of a text are those of its words in turn. The library itself tells: its
  normaliser and pre-tokenizer must part samples at a blank just as they part the samples alone.
* It is byte-level without a normaliser, with the usual pattern, in which a blank belongs to the word after it. There a piece always
  begins at a blank or line feed that follows another character, and texts with other white space go to the library whole.

A full stop or comma before a blank is cut off the letter or digit before it only where the file's own normaliser keeps that character
a letter, or a digit, and never joins the two: each character of _LETTERS is asked about. All other files get whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words that a worker remembers; the cache is emptied when full. Longer words than LONG are not remembered.
WORDS, LONG = 1_000_000, 64
CHARS_AT_ONCE = 1_000_000
#: Unseen words that the library gets as one text.
JOINED = 200
TOKENIZER = "word_bpe_49k.json"

#: Samples that a blank must part; the blanks that texts are cut at.
_SAMPLES = ("a", "Ab", "1", "12", ".", "'s", "'", "-", "é", "ß", "é", "́", "你", "🙂", "<|", "…")
_BLANKS = (" ", "\n")
#: Characters that a full stop or comma may be cut off, if the file agrees: letters and digits of Latin scripts.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c) in ("Lu", "Ll", "Nd"))
#: What no text that is cut at blanks may hold in a byte-level file; it includes _CUT.
_OTHER_BLANKS = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]
_PLAIN_BLANKS = [c for c in _OTHER_BLANKS if c.isascii()]
_BLANK_RUNS = ("  ", " \n", "\n ", "\n\n")
_BLANK_AND_WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_CUT = "\x1e"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        plain = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_word = plain and self._parts_at_blanks()
        self.by_piece = plain and not self.by_word and self._is_byte_level()
        letters = "".join(filter(self._lets_marks_go, _LETTERS)) if self.by_word or self.by_piece else ""
        #: A full stop or comma between one of the letters and a blank.
        self.mark = re.compile(f"(?<=[{letters}])(?=[.,][ \n])") if letters else None

    def _pieces(self, text: str) -> list[str]:
        normalizer = self.tokenizer.normalizer
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)]

    def _parts_at_blanks(self) -> bool:
        if self.tokenizer.pre_tokenizer is None:
            return False
        pieces = self._pieces
        alone = {s: pieces(s) for s in _SAMPLES}
        return all(pieces(x + blank + y) == alone[x] + alone[y] and pieces(x + 2 * blank + y) == alone[x] + alone[y] for blank in _BLANKS for x in _SAMPLES for y in _SAMPLES)

    def _is_byte_level(self) -> bool:
        parts = json.loads(self.tokenizer.to_str())
        cutter = parts["pre_tokenizer"] or {}
        return parts["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and cutter.get("add_prefix_space") is False

    def _lets_marks_go(self, c: str) -> bool:
        """Whether the normaliser leaves letters or digits only of a character, and a mark before a blank is a piece after it."""
        normalizer = self.tokenizer.normalizer
        made = normalizer.normalize_str(c) if normalizer else c
        if not made or any(unicodedata.category(x)[0] != unicodedata.category(c)[0] for x in made):
            return False
        blank = [] if self.by_word else self._pieces(" a")
        after = " " if self.by_word else " a"
        return all(self._pieces(x + c + mark + after) == self._pieces(x + c) + self._pieces(mark) + blank for mark in ".," for x in ("", "a", "1", "-"))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember words; where a text of them has as many pieces, each word is one piece, and the library's word numbers part the ids."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        joined = [(" " if self.by_word else "").join(g) for g in groups]
        for some, made in zip(groups, self.tokenizer.encode_batch(joined, add_special_tokens=False), strict=True):
            numbers = made.word_ids
            if None not in numbers and numbers and numbers[-1] == len(some) - 1 and len(set(numbers)) == len(some):
                raw = np.array(made.ids, "<u4").tobytes()
                at = np.searchsorted(numbers, np.arange(len(some) + 1)).tolist()
                self.words.update(zip(some, [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])], strict=True))
            else:
                self.words.update(zip(some, self._library(some), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a few texts at a time, to hold few words at once."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= CHARS_AT_ONCE:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _split(self, text: str) -> list[str]:
        if self.by_word:
            return self.mark.sub(" ", text).replace("\n", " ").split(" ") if self.mark else text.replace("\n", " ").split(" ")
        if any(c in text for c in (_PLAIN_BLANKS if text.isascii() else _OTHER_BLANKS)):
            return [text]
        if text[:1] in _BLANKS or text[-1:] in _BLANKS or any(run in text for run in _BLANK_RUNS):
            return _BLANK_AND_WORD.findall(text)
        text = self.mark.sub(_CUT, text) if self.mark else text
        return text.replace(" ", _CUT + " ").replace("\n", _CUT + "\n").split(_CUT)

    def _one_piece(self, word: str) -> bool:
        return word.isalpha() if self.by_word else word[:1] == " " and word[1:].isalpha()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not (self.by_word or self.by_piece):
            return self._library(texts)
        split = [self._split(t) for t in texts]
        unseen = sorted(set(chain.from_iterable(split)).difference(self.words), key=self._one_piece)
        letters = bisect_left(unseen, True, key=self._one_piece)
        self.words.update(zip(unseen[:letters], self._library(unseen[:letters]), strict=True))
        self._learn(unseen[letters:])
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        for w in unseen:
            if len(w) > LONG:
                del self.words[w]
        if len(self.words) > WORDS:
            self.words.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)
