"""Token ids by a vocabulary of the tokenizers library, each distinct chunk of a worker's texts encoded once.

A text is cut into chunks where the vocabulary's own pre-tokenizer always cuts: at ASCII blanks, and between an ASCII letter
or digit and a run of punctuation that ends a word. So the ids of a text are the ids of its chunks in turn. Chunks are cut
and hashed (64 bits) for all texts of a batch at once, on their bytes; the library encodes those whose hash is new, and ids
are put together by index. Texts with other blanks, with controls that may count as blanks, or with a string of one of the
vocabulary's special tokens are encoded whole. A special token's string becomes its id, as the library does it; null counts
as empty.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .arrowtext import give_back, only_model, text_bytes
from .shingles import Hasher, byte_values, text_slices

# Blanks and separators besides the six ASCII blanks, in UTF-8.
OTHER_BLANKS = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf"
)
# Punctuation that ends a word; no apostrophe, which may begin a piece such as "'s".
ENDINGS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
BLANK, ENDING, ALNUM = (np.zeros(256, bool) for _ in range(3))
BLANK[[9, 10, 11, 12, 13, 32]] = True
ENDING[list(ENDINGS)] = True
ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
#: A million known chunks take some 35 MB, and as much again while others are put among them.
CHUNKS_KEPT = 1_000_000
#: The library's results take about a kilobyte a chunk until their ids are read.
CHUNKS_AT_ONCE = 5_000
#: Cutting and hashing takes some 60 bytes for each byte of a slice.
SLICE_BYTES = 1 << 19


def chunk_bounds(flat: np.ndarray, offsets: np.ndarray, keeps_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts.

    With `keeps_blanks` a word takes one space before it along, and a run of blanks is a chunk except for its last one if that
    comes before a word: as the vocabulary's pattern takes them. Otherwise blanks are in no chunk.
    """
    n = len(flat)
    word = np.zeros(n + 1, bool)
    word[:n] = ~BLANK[flat]
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = np.flatnonzero(word & (~before | edge)), np.flatnonzero(before & (~word | edge))
    plain = np.where(ENDING[flat], -1, np.arange(n))
    tail = np.maximum.accumulate(plain)[ends - 1] + 1 if len(ends) else ends  # where the final punctuation begins
    split = (tail < ends) & (tail > starts)
    split[split] = ALNUM[flat[tail[split] - 1]]
    if not keeps_blanks:
        return np.sort(np.concatenate([starts, tail[split]])), np.sort(np.concatenate([ends, tail[split]]))
    led = ~edge[starts]  # words with something before them in their text
    space = led.copy()
    space[led] = flat[starts[led] - 1] == 32
    own = led & ~space & ~before[starts]  # the last blank is no space: a chunk of its own
    cuts = np.zeros(n + 1, bool)
    cuts[starts - space] = True
    cuts[starts[own] - 1] = True
    cuts[starts[own]] = True
    cuts[ends] = True
    cuts[tail[split]] = True
    cuts[offsets] = True
    places = np.flatnonzero(cuts)
    return places[:-1], places[1:]


class Encoder:
    """`keeps_blanks`: whether the vocabulary has tokens for blanks; one that has none here also lower-cases.

    Known chunks are a sorted array of hashes with the places of their ids; CHUNKS_KEPT of them are kept at most.
    """

    def __init__(self, path: str, keeps_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread of the library would keep memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks = keeps_blanks
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # In either case, as chunks that differ in case alone may have one hash.
        self.whole = re.compile(b"|".join([OTHER_BLANKS.pattern, *[b"(?i:" + x + b")" for x in added]]))
        self.hasher = Hasher(byte_values(lower=not keeps_blanks))
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.places = np.zeros((0, 2), np.uint32)  # start and length in `ids`
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[k : k + CHUNKS_AT_ONCE] for k in range(0, len(texts), CHUNKS_AT_ONCE))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, raw: bytes, starts: list[int], ends: list[int]) -> None:
        """Take in new chunks, given by sorted hashes and their bounds."""
        lists = self._encode([raw[a:b].decode() for a, b in zip(starts, ends, strict=True)])
        lengths = np.array([len(x) for x in lists], np.int64)
        total = int(lengths.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        places = np.stack([self.used + np.cumsum(lengths) - lengths, lengths], axis=1).astype(np.uint32)
        at = np.searchsorted(self.known, hashes)
        self.known, self.places = np.insert(self.known, at, hashes), np.insert(self.places, at, places, axis=0)
        self.used += total

    def _slice(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        starts, ends = chunk_bounds(flat, offsets, self.keeps_blanks)
        hashes = self.hasher.spans(flat, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._unknown(distinct)
        if len(self.known) + int(new.sum()) > CHUNKS_KEPT:
            self._forget()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(distinct[new], flat.tobytes(), starts[at].tolist(), ends[at].tolist())
        places = self.places[np.searchsorted(self.known, distinct)][which].astype(np.int64)
        lengths = places[:, 1]
        after = np.cumsum(lengths)
        index = np.repeat(places[:, 0] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)
        out = self.ids[index].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], after])[np.searchsorted(starts, offsets)]).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for low, _, flat, offsets in text_slices(*text_bytes(texts), SLICE_BYTES):
            ids = self._slice(flat, offsets)
            raw = flat.tobytes()
            odd = np.unique(np.searchsorted(offsets, [m.start() for m in self.whole.finditer(raw)], "right") - 1)
            for k in odd.tolist():
                ids[k] = np.array(self._encode([raw[offsets[k] : offsets[k + 1]].decode()])[0], "<u4").tobytes()
            out += ids
        give_back()
        return out


def encoder(path: str, keeps_blanks: bool) -> Encoder:
    """The worker's encoder of this vocabulary."""
    return only_model((path, keeps_blanks), lambda: Encoder(path, keeps_blanks))
