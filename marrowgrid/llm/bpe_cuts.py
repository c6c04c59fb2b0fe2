"""Byte-level BPE with forced boundaries.

A pair of bytes that no vocabulary token contains can never end up inside a token, so a text may be cut between them
before any merge is looked at.  Every word of the pre-tokenizer is cut at such pairs, the fragments are encoded on
their own and their ids are concatenated.  Words and fragments recur, so a task remembers a bounded number of them.

Scale: one scan, no shuffle; the vocabulary (a fixed file) is read on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marrowgrid.llm.common import slices

#: the pattern that byte-level pre-tokenizers of this family split by (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words, and fragments, a task remembers
REMEMBERED = 200_000
_LONG = 48


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word to ids; forgets everything when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.make(key)
        if len(key) <= 64:
            self[key] = found
        return found


class ForcedCutBpe:
    """Encoder and decoder of one vocabulary file (the JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            codes = np.frombuffer(token, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        self.inside = inside
        self.cut_after = [bytes(np.nonzero(~row)[0].astype(np.uint8)) for row in inside]
        names = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        table = [names.get(i, b"") for i in range(max(names) + 1)]
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(table), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.fragments, self.words = _Words(self._merge), _Words(self._word)

    def __reduce__(self):
        raise TypeError("broadcast the text of the vocabulary instead")

    def fragments_of(self, data: bytes) -> list[bytes]:
        """Cut between bytes that never meet inside a token."""
        cut_after, start, out = self.cut_after, 0, []
        for i in range(1, len(data)):
            if data[i] in cut_after[data[i - 1]]:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one fragment: the pair of lowest rank is merged first, the leftmost of equals."""
        if data in self.ids and len(data) < 2:
            return (self.ids[data],)
        if len(data) > _LONG:
            return self._merge_long(data)
        rank, parts = self.rank.get, [data[i:i + 1] for i in range(len(data))]
        ranks = [rank(p, 1 << 30) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), 1 << 30)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), 1 << 30)
        return tuple(map(self.ids.__getitem__, parts))

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """As ``_merge`` with a heap of pairs, for fragments where the plain search would take quadratic time."""
        n, rank = len(data), self.rank
        parts = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or len(parts[i]) != a or j >= n or len(parts[j]) != b:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]), len(parts[after[i]])))
            if before[i] >= 0 and (r := rank.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], len(parts[before[i]]), len(parts[i])))
        return tuple(self.ids[p] for p in parts if p is not None)

    def _word(self, word: str) -> tuple[int, ...]:
        pieces = self.fragments_of(word.encode("utf-8", "surrogatepass"))
        if len(pieces) == 1:
            return self._merge(pieces[0])
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, pieces)))

    def _words_of(self, text: str):
        if len(text) < 1 << 20:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, 1 << 17)):
            yield part

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, special tokens in it included."""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        out = [np.zeros(0, np.int32)]
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                for words in self._words_of(part):
                    out.append(np.fromiter(chain.from_iterable(map(self.words.__getitem__, words)), np.int32))
        return np.concatenate(out) if len(out) != 2 else out[1]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, joined."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.start[ids] - (ends - sizes), sizes)
        return self.letters[shift + np.arange(len(shift))]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


_LOADED: dict[int, ForcedCutBpe] = {}


def _loaded(text: str) -> ForcedCutBpe:
    """One encoder per Python worker and vocabulary."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedCutBpe(text)
    return _LOADED[key]


def _read(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    sizes = np.array([0, *map(len, found)], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(found)))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded``: every whole text encoded, and its ids decoded again; a null text is like empty.

    Repeated rows come back as often as given, an empty table gives no rows, further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches):
        bpe = _loaded(held.value)
        for batch in batches:
            for part in slices(batch):
                found = [bpe.encode(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "ids": _id_lists(found),
                    "decoded": pa.array([bpe.decode(f) for f in found], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` of every whole text."""
    return round_trip(docs, vocabulary).select("doc_id", "ids")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids are like none."""
    held = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches):
        bpe = _loaded(held.value)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

