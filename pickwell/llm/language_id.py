"""Language identification by cross-parsing: longest matches against a suffix automaton per language.

A text is cut into the fewest phrases that each occur in a language's labelled text. The
phrases, times the bits to point at one (log2 of the training length), over the symbols
of the text, is the cross-parsing entropy; the language with the least wins.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.llm.chars import LETTER, classes, code_points, joined
from pickwell.llm.common import over_texts, texts_of

SAMPLE_ROWS, SHORT = 32, 2_048
"""A language's training text: so many distinct texts, taken whole, those of at most ``SHORT`` characters in hash order first and
then the shortest others. This bound on rows bounds the automata; predictions read all rows and whole texts."""
WINDOW = 1_024
"""Symbols of a text that are parsed side by side with others; phrases go on over the ends of windows."""
CHUNK = 1 << 20
"""Characters parsed side by side."""
UNKNOWN, GAP = 0, 1
WIDTH = 256
"""Symbols under this have a column in the tables of transitions; those of rarer letters are searched for."""


class Automaton:
    """Transitions of a suffix automaton over ``width`` symbols; state 0 is the root, and as a target means none."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        steps = _steps(symbols)
        self.width, self.columns = width, min(width, WIDTH)
        self.table = np.zeros((len(steps), self.columns), np.uint16 if len(steps) < 1 << 16 else np.int32)
        rare = []
        for state, moves in enumerate(steps):
            for symbol, to in moves.items():
                if symbol < self.columns:
                    self.table[state, symbol] = to
                else:
                    rare.append((state * width + symbol, to))
        self.table = self.table.ravel()
        # The last key is above all others, so every search ends inside.
        self.keys, self.targets = np.array([*sorted(rare), (len(steps) * width, 0)], np.int64).T.copy()

    def next(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if self.width == self.columns:
            return self.table[states * self.columns + symbols].astype(np.int64)
        to = self.table[states * self.columns + np.minimum(symbols, self.columns - 1)].astype(np.int64)
        rare = np.flatnonzero(symbols >= self.columns)
        wanted = states[rare] * self.width + symbols[rare]
        at = np.searchsorted(self.keys, wanted)
        to[rare] = np.where(self.keys[at] == wanted, self.targets[at], 0)
        return to

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after one symbol, and how many phrases it starts."""
        to = self._one(state, symbol)
        if to:
            return to, 0
        to = self._one(0, symbol)
        return to, 1 + (to == 0)

    def _one(self, state: int, symbol: int) -> int:
        if symbol < self.columns:
            return int(self.table[state * self.columns + symbol])
        at = np.searchsorted(self.keys, state * self.width + symbol)
        return int(self.targets[at]) if self.keys[at] == state * self.width + symbol else 0


def _steps(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        state = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in steps[at]:
            steps[at][c] = state
            at = link[at]
        if at != -1:
            to = steps[at][c]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                twin = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[state] = twin
                while at != -1 and steps[at].get(c) == to:
                    steps[at][c] = twin
                    at = link[at]
        last = state
    return steps


def _over_border(automaton: Automaton, symbols: np.ndarray, state: int, last: int) -> tuple[int, int]:
    """State at the end of a window that is entered in ``state``, and how many phrases more start in it than from the root, where it ends in ``last``."""
    other = more = 0
    for symbol in symbols.tolist():
        if state == other:
            return last, more
        state, mine = automaton.move(state, symbol)
        other, theirs = automaton.move(other, symbol)
        more += mine - theirs
    return state, more


class Languages:
    """Automata of all languages, built from their training texts."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.names = sorted(texts)
        counts = Counter("".join(t.lower() for name in self.names for t in texts[name]))
        letters = sorted((c for c in counts if classes()[ord(c)] == LETTER), key=lambda c: (-counts[c], c))
        self.width = len(letters) + 2
        self.symbol = np.full(len(classes()), UNKNOWN, np.min_scalar_type(self.width))
        self.symbol[classes() != LETTER] = GAP
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 2
        self.automata, self.bits = [], []
        for name in self.names:
            symbols = np.concatenate([self.symbols([t])[0] for t in texts[name]] or [np.zeros(0, np.uint8)])
            self.automata.append(Automaton(symbols, self.width))
            self.bits.append(np.log2(max(2, len(symbols))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, where each text starts, and whether it has letters.
        Letters are lower-cased; what lies between them counts as one gap."""
        full, starts = joined([t.lower() for t in texts], "\n")
        codes = code_points(full)
        letter = classes()[codes] == LETTER
        symbols = self.symbol[codes]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP)
        if len(texts):
            keep[starts[:-1]] = True
        before = np.r_[0, np.cumsum(keep)]
        seen = np.r_[0, np.cumsum(letter)][starts]
        return symbols[keep], before[starts], np.diff(seen) > 0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol, texts by languages, and whether a text has letters.

        Windows of all texts are parsed side by side, one symbol of each at a step, as if each began a phrase. From the second window
        of a text on, the phrase that reaches over its start is followed until both ways of parsing agree, and the count mended.
        """
        symbols, starts, lettered = self.symbols(texts)
        sizes = np.diff(starts)
        windows = np.maximum(1, -(-sizes // WINDOW))
        owner = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = starts[owner] + nth * WINDOW
        length = np.minimum(WINDOW, starts[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        lane = np.argsort(order)  # where each window is among those ordered by length
        ordered, lengths = begin[order], length[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # windows longer than step
        bits = np.zeros((len(texts), len(self.names)))
        steps = [symbols[ordered[:n] + t].astype(np.int64) for t, n in enumerate(active.tolist())]
        root = np.zeros(len(begin), np.int64)
        later = np.flatnonzero(nth > 0)
        for j, automaton in enumerate(self.automata):
            state = np.zeros(len(begin), np.int64)
            started = np.zeros(len(begin), np.int64)
            for symbol in steps:
                n = len(symbol)
                to = automaton.next(state[:n], symbol)
                miss = np.flatnonzero(to == 0)
                again = automaton.next(root[: len(miss)], symbol[miss])
                to[miss] = again
                started[miss] += 1 + (again == 0)
                state[:n] = to
            state, started = state[lane], started[lane]
            for w in later.tolist():
                state[w], more = _over_border(automaton, symbols[begin[w] : begin[w] + length[w]], int(state[w - 1]), int(state[w]))
                started[w] += more
            phrases = 1 + np.bincount(owner, started, len(texts))
            bits[:, j] = phrases * self.bits[j] / np.maximum(1, sizes)
        return bits, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score; the score is how much fewer bits the best needs than the second."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits, lettered = self.entropies(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        score = np.where(lettered, 1 - low / second, 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered)], score


def training_texts(
    docs: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, list[str]]:
    """Training texts by language: at most :data:`SAMPLE_ROWS` distinct ones with letters, whole, from rows with a language that
    meet ``rows`` (on ``doc_id``)."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(rows & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.xxhash64("text", F.lit("sample")).alias("place"), "text")
    # Only hashes and sizes are shuffled; a rank with a limit is cut in every task before that.
    distinct = known.groupBy("lang", "place").agg(F.min(F.length("text")).alias("size"))
    by = Window.partitionBy("lang").orderBy(F.greatest(F.col("size"), F.lit(SHORT)), "place")
    chosen = distinct.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= SAMPLE_ROWS).select("lang", "place", "rank")
    found = known.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted(found.collect()):
        texts.setdefault(row["lang"], []).append(row["text"])
    return texts


_BUILT: dict[int, Languages] = {}


def built(mark: int, texts: dict[str, list[str]]) -> Languages:
    """The automata of ``texts``, kept by the worker for its next tasks."""
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Languages(texts)
    return _BUILT[mark]


def predict(docs: DataFrame, texts: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A null text or one without letters is ``und`` with score 0; so is all when no language was
    learned. Ties go to the language first in the alphabet; with one language the score is 1. Ids are passed
    through. Each Python worker builds the automata from ``texts`` once.
    """
    mark = hash(tuple((k, tuple(v)) for k, v in sorted(texts.items())))

    def predicted(some: list[str]) -> dict[str, Any]:
        names, score = built(mark, texts).predict(some)
        return {"lang_pred": names, "score": score}

    return over_texts(texts_of(docs, id_col, text_col), predicted, {"lang_pred": pa.string(), "score": pa.float64()}, CHUNK)
