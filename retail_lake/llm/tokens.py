"""Token ids of whole texts by a byte-level BPE vocabulary file.

``Encoder`` gives what ``tokenizers`` gives for the JSON file. With this pre-tokenizer nothing
merges over a space that stands alone, so texts are cut before such spaces and each distinct
word is encoded once per worker, by the rank file of the same vocabulary. Words are found and
looked up for many texts at once with numpy. Texts in which a space touches other white space,
texts with a special token or a huge word go to ``tokenizers`` whole.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words a worker remembers (about 40 bytes each); beyond it, it starts anew.
WORDS_KEPT = 500_000
#: Bytes of text looked at together; working memory is about forty times that.
SLICE = 1_000_000
LONGEST_WORD = 4_096
_FACTORS = np.random.default_rng(20_11).integers(1, 2**63, LONGEST_WORD, dtype=np.uint64) | np.uint64(1)
_SPACE = 32
# first bytes of white space in UTF-8 beyond ASCII, and the characters themselves
_WHITE = "\x85\xa0                　"
_WHITE_BYTES = tuple(c.encode() for c in (*"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", *_WHITE))
_AFTER, _BEFORE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_AFTER[[white[0] for white in _WHITE_BYTES]] = True
_BEFORE[[white[-1] for white in _WHITE_BYTES]] = True


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            self.special = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        self.ranked = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                pairs = [line.split() for line in file]
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
            self.ranked = tiktoken.Encoding(
                "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
            self.spaced = np.zeros(max(table.values()) + 1, dtype=bool)
            self.spaced[[rank for token, rank in table.items() if token.startswith(b" ")]] = True
        self._forget()

    @cached_property
    def whole(self):
        """The library's own form of the vocabulary, some 45 MB: loaded only once a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _forget(self) -> None:
        """Known words: their hashes in order, and where each one's ids lie in the pool."""
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without added tokens; a null text has none."""
        values = texts.cast(pa.large_binary())
        out: list[np.ndarray] = []
        first, held = 0, 0
        sizes = _sizes(values)
        for i, size in enumerate(sizes):
            held += size
            if held >= SLICE or i == len(sizes) - 1:
                out += self._slice(values.slice(first, i + 1 - first))
                first, held = i + 1, 0
        return out

    def _slice(self, values: pa.Array) -> list[np.ndarray]:
        sizes = _sizes(values)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(v for v in values.to_pylist() if v), dtype=np.uint8)
        if not len(data):
            return [np.zeros(0, dtype=np.uint32) for _ in sizes]
        slow = np.zeros(len(sizes), dtype=bool)
        if self.ranked is None or len(data) > 16 * SLICE:
            slow[:] = True
        else:
            slow |= self._uncuttable(data, ends)
        if slow.all():
            return [self._whole(v) for v in values.to_pylist()]
        ids, starts = self._cut(data, ends - sizes)
        # ids before each text: the words that start before it
        stops = [*starts[1:], len(ids)]
        out = []
        for i, value in enumerate(values.to_pylist()):
            out.append(self._whole(value) if slow[i] else ids[starts[i] : stops[i]])
        return out

    def _whole(self, value: bytes | None) -> np.ndarray:
        text = (value or b"").decode()
        if self.ranked is not None and not any(s in (value or b"") for s in self.special):
            return np.asarray(self.ranked.encode_to_numpy(text), dtype=np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _uncuttable(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts in which a space touches white space, or with a special token or huge word."""
        odd = np.zeros(len(ends), dtype=bool)
        spaces = np.flatnonzero(data == _SPACE)
        padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)])
        near = np.zeros(len(spaces), dtype=bool)
        for step, edge, table in ((5, 0, _AFTER), (3, -1, _BEFORE)):
            likely = np.flatnonzero(table[padded[spaces + step]])
            at = spaces[likely] + 4
            for white in _WHITE_BYTES:
                first = at + 1 if edge == 0 else at - len(white)
                same = np.ones(len(at), dtype=bool)
                for k, byte in enumerate(white):
                    same &= padded[first + k] == byte
                near[likely[same]] = True
        hits = spaces[near].tolist()
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                hits.append(at)
                at = raw.find(token, at + 1)
        edges = np.sort(np.concatenate([[0], spaces, ends]))
        hits += edges[:-1][np.diff(edges) >= LONGEST_WORD].tolist()
        odd[np.searchsorted(ends, np.array(hits, dtype=np.int64), side="right")] = True
        return odd

    def _cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids before each text."""
        is_start = data == _SPACE
        is_start[begins[begins < len(data)]] = True
        starts = np.flatnonzero(is_start)
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        np.minimum(place, LONGEST_WORD - 1, out=place)
        hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _FACTORS[place], starts)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(distinct, data, starts[example], sizes[example])
        found = np.searchsorted(self.keys, distinct)
        at, size = self.at[found][which], self.size[found][which]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(at - (upto - size), size) + np.arange(upto[-1])]
        before = np.concatenate([[0], upto])
        return ids, before[np.searchsorted(starts, begins)]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.keys) > WORDS_KEPT:
            self._forget()
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[near] != hashes)
        else:
            new = np.arange(len(hashes))
        spaced = data[starts[new]] == _SPACE
        for group in (new[spaced], new[~spaced]):
            if not len(group):
                continue
            raw = [data[a : a + n].tobytes() for a, n in zip(starts[group].tolist(), sizes[group].tolist())]
            if data[starts[group[0]]] == _SPACE:  # each begins with a space, and only there is one
                ids = np.asarray(self.ranked.encode_to_numpy(b"".join(raw).decode(errors="replace")), dtype=np.uint32)
                at = np.flatnonzero(self.spaced[ids])
                count = np.diff(np.append(at, len(ids)))
            else:
                each = [self.ranked.encode_ordinary(w.decode(errors="replace")) for w in raw]
                count = np.array([len(e) for e in each], dtype=np.int64)
                at = np.cumsum(count) - count
                ids = np.array([i for e in each for i in e], dtype=np.uint32)
            place = np.searchsorted(self.keys, hashes[group])
            self.keys = np.insert(self.keys, place, hashes[group])
            self.at = np.insert(self.at, place, at + len(self.pool))
            self.size = np.insert(self.size, place, count)
            self.pool = np.concatenate([self.pool, ids])


def _sizes(values: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.binary_length(values), 0)
    return sizes.to_numpy(zero_copy_only=False).astype(np.int64)


@cache
def encoder(vocabulary: str, ranks: str | None = None) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(vocabulary, ranks)
