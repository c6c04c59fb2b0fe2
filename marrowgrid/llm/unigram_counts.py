"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word.  Dynamic programming
keeps, per character, the best score and the number of pieces of the path that has it; no path is traced back.  Ties
follow the tokenizers library: scores are added in double precision from left to right, the first start (so the
longest last piece) keeps its place unless a later one is strictly better, and an unknown character costs ten more
than the worst piece.  Unknown characters become byte pieces if the vocabulary has them all, else a run of them is one
unknown piece.

Scale: one scan, no shuffle.  A task remembers the counts of a bounded number of words; the vocabulary is a fixed file.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from marrowgrid.llm.common import slices

MARK = "▁"
#: words a task remembers
REMEMBERED = 300_000
UNKNOWN_PENALTY = 10.0


class UnigramCounter(dict):
    """Word (without its leading mark) to number of pieces; also the memory of counted words."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        super().__init__()
        automaton = ahocorasick.Automaton()
        last = {piece: score for piece, score in pieces if piece}
        for piece, score in last.items():
            automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self.automaton = automaton
        self.ring = max(map(len, last), default=1) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in last for b in range(256))
        self.known = set(last)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.pieces_of(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n

    def pieces_of(self, word: str) -> int:
        """Pieces of one word; memory does not grow with its length."""
        ring, unknown, n = self.ring, self.unknown, len(word)
        score, count, lost = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        pending = next(matches, None)
        for end in range(n):
            best, pieces, single, was_lost = None, 0, False, False
            while pending is not None and pending[0] == end:
                size, own = pending[1]
                at = (end + 1 - size) % ring
                single = single or size == 1
                value = score[at] + own
                if best is None or value > best:
                    best, pieces = value, count[at] + 1
                pending = next(matches, None)
            if not single:
                at = end % ring
                value = score[at] + unknown
                if best is None or value > best:
                    best, was_lost = value, True
                    if self.bytes:
                        pieces = count[at] + len(word[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[at] + (not lost[at])
            at = (end + 1) % ring
            score[at], count[at], lost[at] = best, pieces, was_lost
        return count[n % ring]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text: blanks become marks, one mark is put before, a word starts at every mark."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        return sum(map(self.__getitem__, (text[1:] if text[0] == " " else text).split(" ")))


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(docs: DataFrame, pieces: Sequence[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text; null and empty texts have 0.

    Repeated rows stay as given, an empty table gives no rows, and columns beyond ``doc_id`` and ``text`` are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def run(batches):
        counter = UnigramCounter(held.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "n_tokens": pa.array(map(counter.count, part["text"].to_pylist()), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
