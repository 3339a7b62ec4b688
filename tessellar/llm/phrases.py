"""Sentences of a whole batch of texts as hashed features, without a loop over texts, sentences or words.

Texts are joined and folded as one string, read as bytes, and cut by masks: a word is a run of letters, digits and the
signs that stand for letters, a sentence ends at a full stop and a blank or at a line's end. Disguises are undone on the
way: marks without width, look-alike letters, accents, letters set apart, stretched letters, digits and signs for letters.
Only distinct words are looked at one by one.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessellar.llm.wordhash import BASE, mix, prefix_powers

# Letters of other scripts that look like Latin ones, digits and signs that stand for letters, and marks
# without width; then punctuation that is read as its plain form.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ø": "o", "æ": "ae", "œ": "oe"}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
NO_WIDTH = re.compile("[­​-‏‪-‮⁠-⁤﻿᠎͏]")
PUNCTUATION = {"’": "'", "‘": "'", "´": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "-", "€": "e", "¡": " ", "¿": " ", "•": " ", "·": "."}

FOREIGN = re.compile(r"[^\x00-\x7f]+")
LONG_RUN = re.compile(r"([^\d])\1{2,}")
VOWELS = re.compile(r"[aeiouy*]")
NUMBER = "#"

_CHARS = np.arange(256)
_WORD = np.isin(_CHARS, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)) | (_CHARS >= 128)
_INSIDE = _WORD | np.isin(_CHARS, np.frombuffer(b"@$!*'_", np.uint8))
_LETTER = _WORD & ~np.isin(_CHARS, np.frombuffer(b"0123456789", np.uint8))
_CLOSING = np.isin(_CHARS, np.frombuffer(b"\"')]", np.uint8))
_FULL_STOP = np.isin(_CHARS, np.frombuffer(b".!?", np.uint8))
_BLANK = np.isin(_CHARS, np.frombuffer(b" \t\r\n\0\x0b\x0c", np.uint8))
_BREAK = np.isin(_CHARS, np.frombuffer(b"\n\0", np.uint8))
_FIRST, _LAST = mix(np.array([1, 2], np.uint64))


@lru_cache(maxsize=100_000)
def _latin(s: str) -> str:
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", NO_WIDTH.sub("", s)).casefold())
    return "".join(LOOKALIKES.get(c) or PUNCTUATION.get(c, c) for c in t if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def canonical(w: str) -> str:
    """The form in which a word counts; of numbers only that they are some; nothing for signs alone."""
    w = LONG_RUN.sub(r"\1", w).strip("!'_@$")
    if not w or w.isalpha():
        return w
    if not any(c.isalpha() for c in w) and not (any(c.isdigit() for c in w) and any(c in "@$!*" for c in w)):
        return NUMBER if any(c.isdigit() for c in w) else ""
    return w.translate(LEET).strip("'_")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=200_000)
def word_features(w: str, bits: int) -> tuple[np.ndarray, int]:
    """A word's features (itself, its consonants, its runs of four characters) and its hash."""
    names = ["w" + w]
    if w != NUMBER:
        names += ["*"] if "*" in w else []
        names.append("s" + VOWELS.sub("", w)[:8] + w[:1])
        framed = f"<{w.replace('*', '')}>"
        names += ["c" + framed[i : i + 4] for i in range(len(framed) - 3)] if len(framed) > 4 else []
    mask = (1 << bits) - 1
    return np.unique(np.array([_hash(n) & mask for n in names], np.int64)), _hash(w) | _hash("h" + w) << 32


class Sentences:
    """Sentences of texts as rows of a sparse matrix of features, each row scaled to unit length.

    ``word`` numbers the words in ``vocabulary``; ``off`` are the sentences' offsets into it and ``doc`` the text of each;
    ``sig`` is a hash of the whole sentence. Null texts have no sentence, nor have sentences without a word.
    """

    def __init__(self, texts: list[str | None], bits: int = 18):
        self.bits, self.size = bits, 1 << bits
        joined = "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
        folded = FOREIGN.sub(lambda m: _latin(m[0]), joined.casefold())
        raw = np.frombuffer(folded.encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends, sentence, doc = self._cut(raw)
        ids, known = self._words(raw, starts, ends)
        ids, known, kept = self._joined(raw, starts, ends, sentence, ids, known)
        forms = [canonical(w) for w in known]
        number = {w: i for i, w in enumerate(dict.fromkeys(f for f in forms if f))}
        form = np.array([number.get(f, -1) for f in forms], np.int64)
        word = form[ids] if len(ids) else ids
        there = word >= 0
        self.vocabulary, self.word = list(number), word[there]
        s = sentence[kept][there]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        self.off, self.doc = np.append(first, len(s)), doc[kept][there][first]
        self._features()

    @staticmethod
    def _cut(raw: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of words, and the sentence and text that each is in."""
        inside = _INSIDE[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        at = np.arange(len(raw))
        solid = np.maximum.accumulate(np.where(_CLOSING[raw], 0, at))  # the last character that closes nothing
        stop = np.zeros(len(raw), bool)
        if len(raw):
            stop[1:] = _BLANK[raw[1:]] & _FULL_STOP[raw[solid[:-1]]]
            stop |= _BREAK[raw]
        return starts, ends, np.cumsum(stop)[starts], np.cumsum(raw == 0)[starts]

    @staticmethod
    def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
        if not len(starts):
            return np.zeros(0, np.int64), []
        up, down = prefix_powers(len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        h = (total[ends] - total[starts]) * down[starts]
        coded = pa.array(mix(h + (ends - starts).astype(np.uint64))).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        one = np.zeros(len(coded.dictionary), np.int64)
        one[ids] = np.arange(len(ids))
        return ids, [raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in one]

    @staticmethod
    def _joined(raw, starts, ends, sentence, ids, known) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Three or more characters set apart by the same one or two signs become a word, if there is a letter."""
        kept = np.ones(len(ids), bool)
        if len(ids) > 2:
            single = (ends - starts == 1) & _WORD[raw[starts]]
            gap = starts[1:] - ends[:-1]
            key = np.where(single[1:] & single[:-1] & (gap <= 2) & (sentence[1:] == sentence[:-1]), raw[ends[:-1]].astype(np.int64) * 4 + gap, -1)
            turn = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            lo, hi = turn[:-1], turn[1:]
            letters = np.concatenate(([0], np.cumsum(_LETTER[raw[starts]])))
            run = (key[lo] >= 0) & (hi - lo >= 2) & (letters[hi + 1] > letters[lo])
            ids, known, new, taken = ids.copy(), list(known), {}, -1
            for a, z in zip(lo[run], hi[run], strict=True):
                if a <= taken:  # the letter before ended a word
                    continue
                w, taken = raw[starts[a : z + 1]].tobytes().decode("utf-8", "replace"), z
                if w not in new:
                    new[w] = len(known)
                    known.append(w)
                ids[a] = new[w]
                kept[a + 1 : z + 1] = False
        return ids[kept], known, np.flatnonzero(kept)

    def _features(self) -> None:
        fs = [word_features(w, self.bits) for w in self.vocabulary]
        self.of_word = np.concatenate([f for f, _ in fs]) if fs else np.zeros(0, np.int64)
        self.ptr = np.concatenate(([0], np.cumsum([len(f) for f, _ in fs], dtype=np.int64)))
        h, n, lead = mix(np.array([x for _, x in fs], np.uint64))[self.word], len(self.off) - 1, self.off[:-1]
        length, mask = np.diff(self.off), np.uint64(self.size - 1)
        left = np.concatenate((h[:1], h[:-1]))
        left[lead] = _FIRST
        self.pair = (mix(left * BASE + h) & mask).astype(np.int64)
        self.close = (mix(h[self.off[1:] - 1] * BASE + _LAST) & mask).astype(np.int64)
        third = np.arange(len(h)) - np.repeat(lead, length) >= 2
        self.third = np.flatnonzero(third)
        self.skip = (mix(h[self.third - 2] * np.uint64(0xD6E8FEB86659FD93) + h[self.third]) & mask).astype(np.int64)
        per = np.diff(self.ptr)[self.word] + 1 + third
        self.count = (np.add.reduceat(per, lead) if n else np.zeros(0, np.int64)) + 1
        self.scale = 1 / np.sqrt(self.count)
        place = (np.arange(len(h)) - np.repeat(lead, length)).astype(np.uint64)
        self.sig = np.add.reduceat(mix(h + place * BASE), lead) if n else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.off) - 1

    def sums(self, w: np.ndarray) -> np.ndarray:
        """The sum of the weights of each sentence's features."""
        if not len(self):
            return np.zeros(0)
        t = np.add.reduceat(w[self.of_word], self.ptr[:-1])[self.word] + w[self.pair]
        t[self.third] += w[self.skip]
        return np.add.reduceat(t, self.off[:-1]) + w[self.close]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.sums(w) * self.scale

    def counts(self, g: np.ndarray) -> np.ndarray:
        """Over the features, the sum of ``g`` of the sentences that have them."""
        t = np.repeat(g, np.diff(self.off))
        v = np.bincount(self.word, t, minlength=len(self.vocabulary))
        out = np.bincount(self.of_word, np.repeat(v, np.diff(self.ptr)), minlength=self.size)
        for at, x in ((self.pair, t), (self.skip, t[self.third]), (self.close, g)):
            out += np.bincount(at, x, minlength=self.size)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.counts(g * self.scale)

    def features(self, i: int) -> np.ndarray:
        """The distinct features of one sentence."""
        a, z = self.off[i], self.off[i + 1]
        own = [self.of_word[self.ptr[w] : self.ptr[w + 1]] for w in self.word[a:z]]
        lo, hi = np.searchsorted(self.third, (a, z))
        return np.unique(np.concatenate([*own, self.pair[a:z], self.skip[lo:hi], self.close[i : i + 1]]))


def tokens(text: str) -> list[list[str]]:
    """The words of each sentence."""
    s = Sentences([text])
    return [[s.vocabulary[w] for w in s.word[a:z]] for a, z in zip(s.off[:-1], s.off[1:], strict=True)]
