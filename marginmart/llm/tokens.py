"""Token ids of whole texts, through the tokenizers library.

The word vocabulary's rules drop white space, never let a token span it, and cut each word into
runs of letters, single digits, contractions and runs of other signs. The ids of a text are thus
those of its words' pieces, in order. Arrow cuts a batch of texts at ASCII white space and finds
its different words, the library encodes each new piece once per worker, and numpy puts the ids
of all words in order. Words and pieces are kept in one bounded cache; when it is full, those
that fewest batches had are dropped. A vocabulary file with other rules is noticed, and its texts
are given to the library whole. Words with letters beyond Latin, with the marks of special
tokens, or with one of the four characters that only Python counts as white space, are given to
the library as they are.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marginmart.llm._common import worker_cache

#: Words and pieces that a worker keeps, and their characters; beyond, half of them at least go.
CACHE_WORDS, CACHE_CHARS = 600_000, 9_600_000
#: Letters beyond Latin, one whose lower case is two code points, white space of Python alone, special tokens.
ODD = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]|<\\|")
#: Fixed value: the vocabulary file's split pattern, for lower-case Latin text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The rules of a vocabulary file that the words' way stands for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [{"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: The bytes that stand for themselves in the vocabulary (ByteLevel); the others have letters from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(SHOWN)))}
UNLIKE = re.compile("[^ -~]")


@functools.cache
def letters(c: str) -> str:
    """The vocabulary's letters for a character; asked for Latin letters and signs only."""
    return c.encode().decode("latin-1").translate(LETTERS)


def has_known_rules(path: str) -> bool:
    """Whether a vocabulary file normalises and splits as the words' way does, and marks word ends."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    parts = lambda key, inner: (rules.get(key) or {}).get(inner)
    return parts("normalizer", "normalizers") == NORMALIZERS and parts("pre_tokenizer", "pretokenizers") == SPLITS and parts("model", "end_of_word_suffix") == "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[k] places from first[k] on, for one k after the other."""
    at = np.repeat(first - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return at


def sums(n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the parts of n that end there."""
    return np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)


class Encoder:
    """Encodes lists of texts into arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = has_known_rules(path)
        self.plain = Tokenizer.from_file(path)  # for pieces that are already normal, in the vocabulary's letters
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.findall = regex.compile(PIECE + "|\n").findall
        self._clear()

    def _clear(self) -> None:
        #: The slot of each word or piece; by slot, its first place in ids, its number of ids, and how many batches had it.
        self.known: dict[str, int] = {}
        self.first, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids, self.chars = np.zeros(0, np.uint32), 0
        self._add(["\n"], self.ids, np.zeros(1, np.int64))  # no word has it; it parts words in _learn, as slot 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Give words slots of their own, for these ids of all of them."""
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        self.chars += sum(map(len, words))

    def _forget(self) -> None:
        """Keep the words that most batches had, at least two and half the cache at most."""
        slots = np.fromiter(self.known.values(), np.int64, len(self.known))
        uses = np.minimum(self.uses[slots], 1000)
        having = np.cumsum(np.bincount(uses, minlength=1002)[::-1])[::-1]  # words that so many batches had, or more
        keep = (uses >= max(2, int(np.argmax(having <= CACHE_WORDS // 2)))) & (slots > 0)
        words, slots, uses = [w for w, k in zip(self.known, keep.tolist()) if k], slots[keep], uses[keep] // 2
        sizes = self.size[slots]
        ids = self.ids[runs(self.first[slots], sizes)]
        self._clear()
        if sum(map(len, words)) <= CACHE_CHARS // 2:
            self._add(words, ids, sizes)
            self.uses[1:] = uses

    def _learn(self, new: list[str]) -> None:
        """Take words that are not known into the cache."""
        alone, several, odd = [], [], []
        for w in new:
            (alone if w.isascii() and w.isalpha() else odd if ODD.search(w) else alone if w.isalpha() else several).append(w)
        lows = [w.lower() for w in alone]
        # All words' pieces at once, a line end after each word's.
        flat = self.findall("".join([f"{w}\n" for w in several]).lower())
        known = self.known
        fresh = list({*lows, *flat}.difference(known))
        found, sizes = [], []
        for at in range(0, len(fresh), 5000):
            part = fresh[at : at + 5000]
            text = UNLIKE.sub(lambda m: letters(m[0]), " ".join(part))
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not mark word ends")
            found.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        if fresh:
            self._add(fresh, np.concatenate(found), np.concatenate(sizes))
        known.update(zip(alone, map(known.__getitem__, lows)))
        slots = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.uses[slots] += 1
        n = self.size[slots]
        self._add(several, self.ids[runs(self.first[slots], n)], sums(n, np.flatnonzero(slots == 0)))
        if odd:
            found = [self.whole(w) for w in odd]
            self._add(odd, np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after the other, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        here = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        slots = np.fromiter(map(self.known.get, here, itertools.repeat(-1)), np.int64, len(here))
        new = np.flatnonzero(slots < 0)
        if len(new):
            unknown = [here[k] for k in new.tolist()]
            self._learn(unknown)
            slots[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(new))
        self.uses[slots] += 1
        # The batch's own words first: a small table is read faster than that of all known ones.
        n = self.size[slots]
        own, first, word = self.ids[runs(self.first[slots], n)], np.cumsum(n) - n, words.indices.to_numpy()
        n = n[word]
        return own[runs(first[word], n)], sums(n, cut.offsets.to_numpy()[1:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        ids, n = self.encode_all(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]
