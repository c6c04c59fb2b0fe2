"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Every document ends with an end id.  Whole windows of the longest context are cut off long documents; what remains is
routed to the smallest tier that holds it (256, 512, 1024, 2048).  From the longest tier down, a document opens a
window of its tier, the gap is filled best-fit with whole documents of shorter tiers, and one last document is cut so
that the window is exactly full; its rest goes back to the tier of its new size.  Only the last window of a task can
stay open: it is cut into full windows of the tiers and one remainder.  So nearly every sequence has exactly the size
of its tier and needs no padding.  Sequences of one tier form step groups of equal token counts.

Scale: one scan without a shuffle.  A task packs the documents of its own input partition in chunks of bounded size
and carries an open window on, so padding is at most one sequence per input partition.  Ids are unique through the
partition number, and a retried task gives the same rows because the order of a file split is fixed.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from marrowgrid.llm.bpe_cuts import PATTERN, byte_letters
from marrowgrid.llm.common import slices

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: tokens of one step group
STEP_TOKENS = 64 * 2048
#: tokens that a task packs at once
CHUNK_TOKENS = 4_000_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_group long")


class Encoder:
    """Ids as the tokenizers library gives them.

    The rank encoder of the same vocabulary gives the same ids several times faster; where it fails (its pattern
    matcher has a stack limit on very long runs), the library itself encodes the text.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.text, self.slow = set(special), text, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        except BaseException as error:  # the encoder panics outside Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            self.slow = self.slow or Tokenizer.from_str(self.text)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class _Pool:
    """Pieces by length; finds the longest that fits a gap, or the shortest that exceeds it."""

    def __init__(self, longest: int):
        self.held = [[] for _ in range(longest + 1)]
        self.mask = 0

    def add(self, piece) -> None:
        n = len(piece[2])
        self.held[n].append(piece)
        self.mask |= 1 << n

    def take(self, n: int):
        piece = self.held[n].pop()
        if not self.held[n]:
            self.mask ^= 1 << n
        return piece

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most ``most`` tokens, 0 if there is none."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def shortest_over(self, least: int) -> int:
        above = self.mask >> (least + 1)
        return (above & -above).bit_length() + least if above else 0


class Packer:
    """Packs the pieces ``(doc_id, start, ids, doc_tokens)`` of one task."""

    def __init__(self, part: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.part, self.tiers, self.step_tokens = part, sorted(tiers, reverse=True), step_tokens
        self.sequences, self.made, self.rows, self.open = 0, {}, [], []

    def emit(self, window: list, tier: int) -> None:
        """Write one sequence."""
        sequence = (self.part << 32) + self.sequences
        made = self.made[tier] = self.made.get(tier, 0) + 1
        group = (self.part << 32) + ((made - 1) // max(1, self.step_tokens // tier)) * len(self.tiers) + self.tiers.index(tier)
        self.sequences += 1
        offset = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, tier, group))
            offset += len(ids)

    def pack(self, pieces: list) -> None:
        """Pack these and what the last call left open; the last window may stay open."""
        top = self.tiers[0]
        pool = _Pool(top)
        for piece in self.open + pieces:
            doc_id, start, ids, total = piece
            whole = len(ids) // top * top
            for at in range(0, whole, top):
                self.emit([(doc_id, start + at, ids[at:at + top], total)], top)
            if whole < len(ids):
                pool.add((doc_id, start + whole, ids[whole:], total) if whole else piece)
        self.open = []
        for tier, shorter in zip(self.tiers, [*self.tiers[1:], 0]):
            while (n := pool.longest(tier)) > shorter:
                window, gap = [pool.take(n)], tier - n
                while gap:
                    if fits := pool.longest(min(gap, shorter) if shorter else gap):
                        window.append(pool.take(fits))
                        gap -= fits
                    elif longer := pool.shortest_over(gap) or pool.longest(gap):
                        doc_id, start, ids, total = pool.take(longer)
                        window.append((doc_id, start, ids[:gap], total))
                        if longer > gap:
                            pool.add((doc_id, start + gap, ids[gap:], total))
                        gap -= min(gap, longer)
                    else:
                        break
                if gap:
                    self.open = window
                    return
                self.emit(window, tier)

    def finish(self) -> None:
        """Cut the open window into full windows of the tiers; the remainder is the only sequence to be padded."""
        rest, self.open = self.open, []
        left = sum(len(p[2]) for p in rest)
        while left:
            tier = next((t for t in self.tiers if t <= left), self.tiers[-1])
            window, gap = [], min(tier, left)
            left -= gap
            while gap:
                doc_id, start, ids, total = rest.pop(0)
                window.append((doc_id, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.insert(0, (doc_id, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            self.emit(window, tier)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [field.split()[0] for field in SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)


def pack(docs: DataFrame, vocabulary: str, tiers=TIERS, step_tokens: int = STEP_TOKENS,
         chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece of a document: its ids ``start .. start + length`` lie at ``offset`` of ``sequence_id``.

    A null text is like an empty one: its document is the end id alone.  ``tier`` is the context size of the
    sequence, ``step_group`` the group of sequences trained in one step.  An empty table gives no rows; repeated
    rows are packed as often as given.
    """
    with open(vocabulary, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encode, packer, pieces, tokens = Encoder(held.value), Packer(TaskContext.get().partitionId(), tiers, step_tokens), [], 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(END_ID))
                    pieces.append((doc_id, 0, ids, len(ids)))
                    tokens += len(ids)
                if tokens >= chunk_tokens:
                    packer.pack(pieces)
                    pieces, tokens = [], 0
                    if packer.rows:
                        yield packer.batch()
        packer.pack(pieces)
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
