"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a chunk by where they end; dynamic programming carries, for
each character, the best score up to it and the number of pieces on that best path. No segmentation is kept. Ties go as in
the tokenizer: of equal scores the piece that starts first wins, and an unknown character (score of the worst piece less
10) only wins if it is better. With byte fallback an unknown character counts as many pieces as it has UTF-8 bytes.

The text is prefixed with the word mark, spaces become word marks, and pieces never reach over a word mark to the left or
over a character that no piece contains; so chunks between those are solved alone and remembered, in a bounded memory per
worker. With split, the default, every word mark begins a chunk, as where a pre-tokenizer splits at each of them; without,
a run of word marks stays together, so that pieces that are such runs can be chosen ("two  spaces" takes fewer tokens). The
vocabulary file's path is a parameter; its size is checked before it is sent to the executors.

Defined cases: a null or empty text has 0 tokens and score 0; a text of any length is counted whole, a chunk of any length
with some 17 bytes a character; rows are counted one by one, repeated ones alike; everything else of a row is ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks remembered by a worker; longer ones are not.
REMEMBERED, LONGEST = 400_000, 40
#: Most pieces of a vocabulary that is broadcast.
MOST_PIECES = 2_000_000

COUNTS = "n_tokens long, score double"


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (piece, score); matched as text, whatever their kind, as the tokenizer does."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool


def load(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    if len(p) > MOST_PIECES:
        raise ValueError(f"{len(p)} pieces; at most {MOST_PIECES} are sent to the executors")
    return Vocabulary(tuple((p.id_to_piece(i), p.get_score(i)) for i in range(len(p))), any(p.is_byte(i) for i in range(len(p))))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Counter:
    def __init__(self, vocabulary: Vocabulary, split: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        inside = {c for piece, _ in vocabulary.pieces for c in piece}
        self.lone = [c for c in "\n\t\r" if self.bytes and c not in inside]
        if any(MARK in piece[1:] and piece.strip(MARK) for piece, _ in vocabulary.pieces):
            raise ValueError("a piece reaches over a word mark")
        alone = re.escape("".join(self.lone)) or MARK
        self.chunks = re.compile(f"{MARK}{'' if split else '+'}[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]")
        self.known: dict[str, tuple[int, float]] = {}

    def solve(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of a chunk's best path."""
        n = len(chunk)
        matches = self.automaton.iter(chunk)
        match = next(matches, None)
        best, count, run = array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1))), bytearray(n + 1)
        for end in range(n):
            here = []
            while match and match[0] == end:
                here.append(match[1])
                match = next(matches, None)
            score, pieces, lone, unknown = None, 0, False, False
            for length, s in sorted(here, reverse=True):
                lone = lone or length == 1
                s += best[end + 1 - length]
                if score is None or s > score:
                    score, pieces = s, count[end + 1 - length] + 1
            if not lone:
                s = self.unknown + best[end]
                if score is None or s > score:
                    score, unknown = s, True
                    pieces = count[end] + (len(chunk[end].encode()) if self.bytes else 0 if run[end] else 1)
            best[end + 1], count[end + 1], run[end + 1] = score, pieces, unknown
        return count[n], best[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        known, tokens, score = self.known, 0, 0.0
        for chunk in self.chunks.findall(marked):
            got = known.get(chunk)
            if got is None:
                got = self.solve(chunk)
                if len(chunk) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


_ready: dict[tuple[int, bool], Counter] = {}


def counter(sent, split: bool) -> Counter:
    """The worker's own automaton for a broadcast vocabulary."""
    key = (hash(sent.value), split)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Counter(sent.value, split)
    return _ready[key]


def count(texts: Iterable[str | None], vocabulary: Vocabulary, split: bool = True) -> list[tuple[int, float]]:
    c = Counter(vocabulary, split)
    return [c(t) for t in texts]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", split: bool = True) -> DataFrame:
    """id_col, n_tokens and score (of the best path) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        c = counter(sent, split)
        return pd.DataFrame([c(t) for t in texts], columns=["n_tokens", "score"])

    return docs.select(F.col(id_col), counts(F.col(text_col)).alias("c")).select(id_col, "c.n_tokens", "c.score")
