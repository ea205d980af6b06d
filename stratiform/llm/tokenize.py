"""Exact tokenisation of whole texts through a cache of encoded chunks.

Byte-pair encoders never merge across their pre-tokens, so a text may be cut wherever a pre-token
must end, each distinct chunk encoded once by the library, and the ids joined. Natural text
repeats its chunks, which saves most of the encoding; the cache holds at most ``CACHE`` chunks
of a worker and starts anew when it is full.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

CACHE = 300_000
#: Every white space character but the plain space and the line feed.
_ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
#: Chunks of printable ASCII (but no special token's "<") and Latin letters, lines within them too.
_PLAIN = "[!-;=-~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]+"
_LATIN = re.compile(rf"{_PLAIN}(?:\n+{_PLAIN})*")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LOADED: dict[str, Tokenizer] = {}
_ENGINES: dict[str, tuple[tiktoken.Encoding, np.ndarray] | None] = {}


def load(path: str) -> Tokenizer:
    """``path``: a file name of the public tokenizers, or a full path."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))
    return _LOADED[path]


def byte_level_chunks(text: str) -> tuple[list[str], bool]:
    """Cut before each lone space between two non-spaces: there a byte-level pre-token always ends.

    Returns the chunks and whether all but the first stand without the space they begin with.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
        return _CUT.split(text), False
    return text.split(" "), True


def byte_level_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_vocabulary_engine(path: str) -> tuple[tiktoken.Encoding, np.ndarray] | None:
    """A faster engine over the same file, and the bytes of each id; None if the ids are no ranks.

    Where the n-th merge makes the n-th id after the 256 bytes, ranks and merges say the same.
    """
    with open(path if "/" in path else public_tokenizers.path(path), encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_level_alphabet()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + n for n, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
    if len(ranks) != 256 + len(merges):
        return None
    engine = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(len(ranks), np.int64)
    for t, i in ranks.items():
        sizes[i] = len(t)
    return engine, sizes


class ByteLevelIds:
    """Ids of byte-level BPE by the tokenizers library, each text closed by ``end``.

    Chunks of Latin letters go through the faster engine, after a first lot of them has given the
    same ids in both.
    """

    def __init__(self, path: str, end: int = 0) -> None:
        self.tokenizer, self.end = load(path), end
        if path not in _ENGINES:
            _ENGINES[path] = same_vocabulary_engine(path)
        self.engine, self.tested = _ENGINES[path], False
        self.clear()

    def clear(self) -> None:
        self.bare: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.lens, self.pool = np.ones(1, np.int64), np.full(1, self.end, np.uint32)

    def _add(self, known: dict[str, int], words: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        known.update(zip(words, range(len(self.lens), len(self.lens) + len(words))))
        self.lens, self.pool = np.concatenate([self.lens, lens]), np.concatenate([self.pool, ids.astype(np.uint32)])

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.fromiter((i for ids in got for i in ids), np.uint32)

    def _by_engine(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        engine, sizes = self.engine
        ids = engine.encode_to_numpy(" " + " ".join(words), disallowed_special=())
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        upto = np.searchsorted(np.cumsum(sizes[ids]), ends, side="left") + 1
        return np.diff(upto, prepend=0), ids

    def _learn(self, known: dict[str, int], words: set[str], lead: str) -> None:
        new = [w for w in words if w not in known]
        plain = [w for w in new if _LATIN.fullmatch(w)] if lead and self.engine else []
        if plain:
            if not self.tested:
                a, b = self._by_library([lead + w for w in plain[:2000]]), self._by_engine(plain[:2000])
                self.tested = True
                if not (np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])):
                    self.engine, plain = None, []
            if plain:
                self._add(known, plain, *self._by_engine(plain))
        other = [w for w in new if w not in known]
        if other:
            self._add(known, other, *self._by_library([lead + w for w in other]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has (its ``end`` counts)."""
        if len(self.bare) + len(self.spaced) > CACHE:
            self.clear()
        cut = [byte_level_chunks(t) for t in texts]
        bare: set[str] = set()
        spaced: set[str] = set()
        for parts, lead in cut:
            if lead:
                bare.add(parts[0])
                spaced.update(parts[1:])
            else:
                bare.update(parts)
        self._learn(self.bare, bare, "")
        self._learn(self.spaced, spaced, " ")
        index: list[int] = []
        sizes = []
        for parts, lead in cut:
            if lead:
                index.append(self.bare[parts[0]])
                index.extend(map(self.spaced.__getitem__, parts[1:]))
            else:
                index.extend(map(self.bare.__getitem__, parts))
            index.append(0)
            sizes.append(len(parts) + 1)
        at = np.array(index, dtype=np.int64)
        n = self.lens[at]
        first = np.concatenate([[0], np.cumsum(self.lens)])[at]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(first - done[:-1], n) + np.arange(done[-1])]
        ends = np.cumsum(sizes)
        return ids, np.diff(done[ends], prepend=0)


class WordCounts:
    """Token counts where the pre-tokeniser drops white space, so that any of it may be cut at."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known = {}
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        words: set[str] = set().union(*cut)
        new = [w for w in words if w not in self.known]
        if new:
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update(zip(new, (len(e.ids) for e in got)))
        return [sum(map(self.known.__getitem__, parts)) for parts in cut]
