"""Byte-level BPE vocabularies of the tokenizers library, applied to texts of any length."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Characters of a text that are read at once; the library's answer is some fifty times as large.
CHUNK_CHARS = 250_000
#: White space and what follows it. No token reaches over the border before white space that the library knows as such too.
WORD = re.compile(r"\s*\S+|\s+")
#: White space to Python, not to the library.
DOUBTFUL = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII; without it a word begins where a byte of white space follows another byte.
WIDE = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace()) + "]")
#: What the bytes of a text are to a byte-level pattern: white space, letters, digits, others, and those (apostrophes, beyond ASCII) beside which nothing is cut.
KIND = np.array([4 if c > 127 or c == 39 else 0 if c in b"\t\n\v\f\r " else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], dtype=np.uint8)
#: What such a pattern takes as one word, whatever follows.
SINGLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Words that a task learns before it forgets those which it has not met since the time before, and the longest of them.
TABLE_WORDS, LONG_WORD = 150_000, 256
#: No token of a byte-level pattern reaches over the place between a letter and a space with a letter behind it.
BORDER = re.compile("[A-Za-z](?= [A-Za-z])")


def cut(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in pieces of some `size` characters, cut at borders only; text without borders stays in one piece."""
    at = 0
    while len(text) - at > size:
        border = BORDER.search(text, at + size - 1)
        if border is None:
            break
        yield text[at:border.end()]
        at = border.end()
    yield text[at:]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, of which encoding makes none: it walks through every remembered word."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WordTable(dict):
    """What `learn` says of words, asked once while a word is remembered; long words are never remembered."""

    def __init__(self, learn: Callable[[list[str]], list]):
        super().__init__()
        self.learn, self.older = learn, {}

    def values_of(self, words: list[str]) -> list:
        if len(self) > TABLE_WORDS:
            self.older = dict(self)
            self.clear()
        found = list(map(self.get, words))
        missing = [i for i, value in enumerate(found) if value is None]
        if missing:
            fresh = dict.fromkeys(map(words.__getitem__, missing))
            met = [word for word in fresh if word in self.older] if self.older else []
            self.update(zip(met, map(self.older.__getitem__, met)))
            new = [word for word in fresh if word not in self]
            self.update(zip(new, self.learn(new)))
            for i in missing:
                found[i] = self[words[i]]
            for word in new:
                if len(word) > LONG_WORD:
                    del self[word]
        return found


def encoded_words(words: list[str], encode: Callable[[str], np.ndarray], sizes: np.ndarray) -> list[bytes] | None:
    """The ids (as bytes) of words that are set one behind the other; None if tokens reach over their borders after all."""
    out = []
    for at in range(0, len(words), 2000):
        some = words[at:at + 2000]
        ids = encode("".join(some))
        token_ends, word_ends = np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) for w in some])
        cut = np.searchsorted(token_ends, word_ends)
        if not len(ids) or token_ends[-1] != word_ends[-1] or (token_ends[cut] != word_ends).any():
            return None
        raw, ends = ids.tobytes(), (ids.itemsize * (cut + 1)).tolist()
        out += map(raw.__getitem__, map(slice, [0, *ends], ends))
    return out


def _kinds(coded: np.ndarray) -> np.ndarray:
    """KIND of each byte; both bytes of Latin-1 letters are letters."""
    kind = KIND[coded]
    latin = np.flatnonzero(coded[:-1] == 0xC3)
    latin = latin[(coded[latin + 1] & 0xDF) != 0x97]  # but for the signs of times and division
    kind[latin] = kind[latin + 1] = 1
    return kind


def _cut_up(texts: list[str], begins_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[pa.StringArray, np.ndarray]:
    """The strings of all texts, and how many each has; `begins_of` (bytes, ends of texts) says which bytes begin another."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    data = b"".join(raw)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[:-1] = begins_of(np.frombuffer(data, dtype=np.uint8), ends)
    begins[ends] = True  # also where a text ends, and of the last word
    at = np.flatnonzero(begins).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)), np.diff(np.searchsorted(at, ends))


def plain_words(texts: list[str], meets: np.ndarray | None = None) -> tuple[pa.StringArray, np.ndarray]:
    """The words (as by WORD) of all texts, and how many each has; the texts' white space is ASCII.

    With `meets` (which bytes follow each other in any piece of a vocabulary) words
    are cut where the kind of characters changes and no piece reaches over.
    """

    def begins_of(coded: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = _kinds(coded)
        before, after, out = kind[:-1], kind[1:], np.zeros(len(coded), dtype=bool)
        out[1:] = (after == 0) & (before != 0)
        if meets is not None:
            at = np.flatnonzero((before != after) & (before % 4 != 0) & (after % 4 != 0))
            out[at[~meets[coded[at], coded[at + 1]]] + 1] = True
        return out

    return _cut_up(texts, begins_of)


def plain_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """What byte-level patterns never read across, finer than words, of all texts, and how many each has; the texts' white space is ASCII.

    A letter, a digit and another character stand in different tokens, and of a run of white space before something else
    only a last blank goes with what follows. A run that ends a text stays whole.
    """

    def begins_of(coded: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = _kinds(coded)
        before, after, out = kind[:-1], kind[1:], np.zeros(len(coded), dtype=bool)
        out[1:] = (before != after) & np.where(before == 0, coded[:-1] != 32, (before != 4) & (after != 4) | (after == 0))
        last = (before == 0) & (after != 0)  # of a run with something behind it
        last[ends[(ends > 0) & (ends < len(coded))] - 1] = False
        out[:-1] |= last
        return out

    return _cut_up(texts, begins_of)


def wide_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The same for any text."""
    words = [WORD.findall(t) for t in texts]
    return pa.array([w for some in words for w in some], pa.string()), np.array([len(some) for some in words], dtype=np.int64)


def laid_out(found: list[bytes], place: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """The ids of texts of so many words each; `place` says which of `found` (ids as bytes) each word has."""
    known, sizes = np.frombuffer(b"".join(found), dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64) // 4
    of_word, begins = sizes[place], (np.cumsum(sizes) - sizes)[place]
    ends = np.append(0, np.cumsum(of_word))
    ids = known[np.repeat(begins - ends[:-1], of_word) + np.arange(ends[-1])]
    cuts = ends[np.append(0, np.cumsum(number))]
    return [ids[low:high] for low, high in zip(cuts, cuts[1:])]


class ByteTokens:
    """Ids of texts, and the bytes of each id.

    `plain` reads the strings of special tokens inside texts as ordinary text.
    The library encodes a word once while it is remembered: the new words of a
    few texts are set one behind the other, encoded together and told apart by
    the bytes of their tokens; words of one kind of characters go to the library's
    model as they are, since its pattern finds nothing to divide. Texts that hold
    an added token are read whole. Vocabularies that are not byte-level, or rewrite
    texts, get whole texts.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        said = json.loads(self.tokenizer.to_str())
        reader = said["pre_tokenizer"] or {}
        self.cuttable = (said["normalizer"] is None and reader.get("type") == "ByteLevel" and not reader.get("add_prefix_space")
                         and reader.get("use_regex", True) and not any(re.search("[A-Za-z] [A-Za-z]", t["content"]) for t in said["added_tokens"]))
        self.added = re.compile("|".join(re.escape(t["content"]) for t in said["added_tokens"]) or "(?!)")
        self.model, self.letters = self.tokenizer.model, str.maketrans({chr(b): c for c, b in _byte_letters().items()})
        self.vocabulary = max(self.tokenizer.get_vocab().values(), default=-1) + 1
        self.sizes = np.array(list(map(len, self.bytes_of())), dtype=np.int64)
        self.words = WordTable(self.learn)
        #: Every text comes back byte for byte: nothing is rewritten, and each single byte has an entry.
        self.lossless = self.cuttable and plain and _byte_letters().keys() <= self.tokenizer.get_vocab().keys()

    def pieces(self, text: str) -> list[str]:
        return list(cut(text)) if self.cuttable else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuttable:
            return self._encoded(texts)
        every = "\n".join(texts)
        strange, wide = (any(p.search(every) for p in which) for which in ((DOUBTFUL, self.added), (WIDE,)))
        out = [self._encoded([t])[0] if strange and (DOUBTFUL.search(t) or self.added.search(t)) else None for t in texts]
        at = [i for i, ids in enumerate(out) if ids is None]
        plain = [i for i in at if not WIDE.search(texts[i])] if wide else at
        for which, (words, number) in ((plain, plain_pieces([texts[i] for i in plain])), (rest := sorted({*at} - {*plain}), wide_words([texts[i] for i in rest]))):
            for i, ids in zip(which, self._by_words(words, number)):
                out[i] = ids
        return out

    def _by_words(self, words: pa.StringArray, number: np.ndarray) -> list[np.ndarray]:
        """The ids of texts of so many words each; a word that comes again is looked up once."""
        coded = words.dictionary_encode()
        found = self.words.values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return laid_out(found, coded.indices.to_numpy(), number)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of new words. Of those that the pattern divides, such as begin with white space and end without are set behind each other."""
        known, single = {}, [w for w in words if SINGLE.fullmatch(w)]
        spelled = "\n".join(single).encode().decode("latin-1").translate(self.letters).split(_LINE_FEED) if single else []
        made = list(map(self.model.tokenize, spelled))
        raw = np.array([t.id for tokens in made for t in tokens], dtype=np.int32).tobytes()
        ends = (4 * np.cumsum(list(map(len, made)), dtype=np.int64)).tolist()
        known.update(zip(single, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        joined = [w for w in words if w not in known and w[0].isspace() and not w[-1].isspace()]
        made = encoded_words(joined, lambda text: self._encoded([text])[0], self.sizes)
        known.update(zip(joined, made or ()))
        alone = [w for w in words if w not in known]
        for at in range(0, len(alone), 2000):
            some = alone[at:at + 2000]
            known.update(zip(some, (ids.tobytes() for ids in self._encoded(some))))
        return [known[w] for w in words]

    def bytes_of(self) -> list[bytes]:
        """The bytes each id stands for (of an added token its string); an id without an entry has none."""
        letters = _byte_letters()
        out = [b""] * self.vocabulary
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = token.content.encode()
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        return out


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


_LINE_FEED = next(c for c, b in _byte_letters().items() if b == 10)
