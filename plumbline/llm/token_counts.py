"""Token counts by greedy longest match over a word-piece vocabulary, without building pieces.

Contract: per document n_words and n_tokens. A text is normalised to NFC and lower case and cut into
words: runs of letters, single digits, runs of other characters, and a few English endings after an
apostrophe. A word is the sequence of its UTF-8 bytes, the last one marked; n_tokens adds up how many
pieces greedy longest match needs for each word. Every byte is a piece, marked and unmarked, so there
is no unknown word. Null text counts as empty; repeated rows stay; an empty table gives no rows.

Method: a trie of the vocabulary with failure links, as for multi-pattern matching. Where a state has
no way on, the failure link pops the pieces that greedy matching has settled by then and leads to the
state of what remains; only the number of popped pieces is stored, computed once per state. A word
costs time linear in its length, however long it is. Documents are counted where they are read; a
worker remembers the counts of at most REMEMBERED short words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches

REMEMBERED = 300_000
SHORT = 48
LAST = 256
#: Fixed values of the vocabulary: the mark of a word's end and the pattern of words.
END_MARK = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def symbols_of(piece: str, letters: dict[str, int]) -> tuple[int, ...] | None:
    """A piece as byte symbols, the last raised by LAST at a word's end; None if it is no byte string."""
    body = piece.removesuffix(END_MARK)
    if not body or any(c not in letters for c in body):
        return None
    symbols = [letters[c] for c in body]
    if body != piece:
        symbols[-1] += LAST
    return tuple(symbols)


class Automaton:
    """Trie with failure links and the number of pieces each link pops."""

    def __init__(self, pieces: Iterator[tuple[int, ...]]) -> None:
        self.steps: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            state = 0
            for symbol in piece:
                if symbol not in self.steps[state]:
                    self.steps[state][symbol] = len(self.steps)
                    self.steps.append({})
                    whole.append(False)
                state = self.steps[state][symbol]
            whole[state] = True
        self.link = [-1] * len(self.steps)
        self.pops = [0] * len(self.steps)
        level = [0]
        while level:
            below = []
            for parent in level:
                for symbol, state in self.steps[parent].items():
                    below.append(state)
                    if whole[state]:
                        self.link[state], self.pops[state] = 0, 1
                        continue
                    popped, rest = self.pops[parent], self.link[parent]
                    while rest >= 0 and symbol not in self.steps[rest]:
                        popped, rest = popped + self.pops[rest], self.link[rest]
                    if rest >= 0:
                        self.link[state], self.pops[state] = self.steps[rest][symbol], popped
            level = below

    def count(self, symbols: list[int]) -> int:
        """Number of pieces of a word."""
        steps, link, pops = self.steps, self.link, self.pops
        state = popped = 0
        for symbol in symbols:
            while symbol not in steps[state]:
                popped += pops[state]
                state = link[state]
            state = steps[state][symbol]
        while state:
            popped += pops[state]
            state = link[state]
        return popped


@lru_cache(maxsize=1)
def automaton(vocabulary_path: str) -> Automaton:
    with open(vocabulary_path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    pieces = {s for s in (symbols_of(name, letters) for name in names) if s}
    pieces |= {(b + mark,) for b in range(256) for mark in (0, LAST)}
    return Automaton(iter(sorted(pieces)))


class WordCounts(dict):
    """Piece count of a word, remembered for short words."""

    def __init__(self, matcher: Automaton) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += LAST
        found = self.matcher.count(symbols)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def word_counts(vocabulary_path: str) -> WordCounts:
    return WordCounts(automaton(vocabulary_path))


def words_of(text: str) -> list[str]:
    return WORDS.findall(unicodedata.normalize("NFC", text).lower())


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Columns doc_id, n_words, n_tokens."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary_path)
        for batch in batches:
            found = np.zeros((2, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(1)):
                words = words_of(text.as_py() or "")
                found[:, row] = len(words), sum(map(counts.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0]), pa.array(found[1])], names=["doc_id", "n_words", "n_tokens"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, n_words long, n_tokens long")
