"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text.  A document is parsed
into phrases, each the longest match from where the last one ended, and the number of phrases, times the bits that
name a place in the language's text, over the document's length estimates its cross entropy; the language with the
lowest estimate wins.  Parsing steps many segments of texts at once through the automata's transition tables.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.samples import free_prefix

#: Characters of labelled text per language that the model is fitted on.
TRAIN_CHARS = 40_000
#: Documents per language that are read for it, at most about.
TRAIN_DOCS = 60
#: Symbols of a language, the most frequent ones, whose transitions are columns of a table; those of all others are searched
#: for.  With many languages the columns are fewer, so that all tables take about TABLE_BYTES.
COLUMNS, TABLE_BYTES = 62, 512 << 20
#: Symbols of a segment; the segments of long texts are parsed side by side.
SEGMENT = 512
#: No language: a null text, or one without a letter.
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
_FOLDED = np.arange(sys.maxunicode + 1, dtype=np.uint32)
for _c in np.flatnonzero(_LETTER).tolist():
    if len(_lower := chr(_c).lower()) == 1:
        _FOLDED[_c] = ord(_lower)


def normal(text: str) -> tuple[np.ndarray, bool]:
    """The text's lower-cased letters as code points, runs of anything else as one space; whether it has a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[points]
    if not letter.any():
        return np.empty(0, np.uint32), False
    keep = letter | np.concatenate([[True], letter[:-1]])
    return np.where(letter, _FOLDED[points], np.uint32(32))[keep], True


@dataclass
class Automaton:
    """Transitions (-1: none) of the automaton of all substrings of a text of ``size`` symbols' alphabet.

    Those of the first symbols are in ``table`` (state x symbol); the others are ``targets`` of sorted ``keys``, state *
    ``size`` + symbol, of which the last is larger than any.  ``start`` has the root's for all symbols.
    """

    size: int
    table: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    start: np.ndarray

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where symbol ``c`` leads from each state."""
        width, flat = self.table.shape[1], self.table.ravel()
        if self.size == width:
            return flat[state * width + c]
        rare = np.flatnonzero(c >= width)
        to = flat[state * width + np.where(c < width, c, 0)]
        key = state[rare].astype(np.int64) * self.size + c[rare]
        at = np.searchsorted(self.keys, key)
        to[rare] = np.where(self.keys[at] == key, self.targets[at], -1)
        return to

    def parse(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after symbols ``c``, and whether a phrase begins with each: it does in state 0 and where no longer
        match goes on; a symbol that occurs nowhere is a phrase."""
        to = self.step(state, c)
        ended = to < 0
        broken = np.flatnonzero(ended)
        to[broken] = np.maximum(self.start[c[broken]], 0)
        return to, ended | (state == 0)


def suffix_automaton(symbols: np.ndarray, size: int, columns: int = COLUMNS) -> Automaton:
    """The automaton of all substrings of ``symbols`` that do not hold symbol 0, which stands between texts."""
    link, length, go = [-1], [0], [{}]
    last = 0
    for c in symbols.tolist():
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    width = min(size, columns + 1)
    table, rare = np.full((len(go), width), -1, np.int32), []
    for state, edges in enumerate(go):
        for c, to in edges.items():
            if c >= width:
                rare.append((state * size + c, to))
            elif c:  # no match crosses from text to text
                table[state, c] = to
    pairs = np.array([*sorted(rare), (len(go) * size, -1)], np.int64)
    start = np.full(size, -1, np.int32)
    start[:width] = table[0]
    root = pairs[pairs[:, 0] < size]
    start[root[:, 0]] = root[:, 1]
    return Automaton(size, table, pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), start)


@dataclass
class Model:
    """Languages, the number of each code point (0: in no language), and per language the symbol of each number (0: not
    in it), the automaton and the bits of a phrase."""

    languages: list[str]
    number: np.ndarray
    symbols: list[np.ndarray]
    automata: list[Automaton]
    bits: list[float]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each normal text (row) in each language (column).

        Texts are cut into segments that are parsed side by side, each as if a phrase began there.  Where one did not, the
        segment is parsed again from the state that its predecessor ended in, until the two parses are in one state.
        """
        pieces = [(i, a, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        pieces.sort(key=lambda x: -len(x[2]))
        owner = np.array([i for i, _, _ in pieces], np.int64)
        size = np.array([len(t) for _, _, t in pieces])
        out = np.zeros((len(texts), len(self.automata)), np.int64)
        if not len(pieces):
            return out
        place = {(i, a): j for j, (i, a, _) in enumerate(pieces)}
        after = np.array([place.get((i, a + SEGMENT), -1) for i, a, _ in pieces])
        grid = np.zeros((int(size[0]), len(pieces)), self.number.dtype)
        for j, (_, _, t) in enumerate(pieces):
            grid[: len(t), j] = self.number[t]
        open_ = [int(np.searchsorted(-size, -at, "left")) for at in range(int(size[0]))]  # segments longer than at
        states, begins = np.zeros(grid.shape, np.int32), np.zeros(grid.shape, bool)
        for k, (symbol, automaton) in enumerate(zip(self.symbols, self.automata, strict=True)):
            state = np.zeros(len(pieces), np.int32)
            for at, n in enumerate(open_):
                state, begin = automaton.parse(state[:n], symbol[grid[at, :n]])
                states[at, :n], begins[at, :n] = state, begin
            again = np.flatnonzero(after >= 0)
            while len(again):  # segments whose end is new to their successors
                state = states[size[again] - 1, again]
                now, state = after[again][state != 0], state[state != 0]
                every, ends = now, states[size[now] - 1, now]
                for at in range(SEGMENT):
                    live = size[now] > at
                    now, state = now[live], state[live]
                    if not len(now):
                        break
                    to, begins[at, now] = automaton.parse(state, symbol[grid[at, now]])
                    differ = to != states[at, now]
                    states[at, now] = to
                    now, state = now[differ], to[differ]
                again = every[(states[size[every] - 1, every] != ends) & (after[every] >= 0)]
            count = begins.sum(0, where=np.arange(len(grid))[:, None] < size)
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 less the winner's cross entropy over the runner-up's."""
        normals = [normal(t) if t else (np.empty(0, np.uint32), False) for t in texts]
        entropy = self.phrases([x for x, _ in normals]) * np.array(self.bits)
        best = entropy.argmin(1)
        rest = np.sort(entropy, 1)
        second = rest[:, 1] if entropy.shape[1] > 1 else rest[:, 0] * 2
        score = np.where(second > 0, 1 - rest[:, 0] / np.maximum(second, 1e-9), 0.0)
        known = np.array([ok for _, ok in normals], bool)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _level(sizes: list[int], room: int) -> int:
    """The greatest length to which texts of these sizes can all be cut so that they take ``room`` together at most."""
    left = sorted(sizes)
    for at, n in enumerate(left):
        if n * (len(left) - at) > room:
            return room // (len(left) - at)
        room -= n
    return max(left)


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of texts by language; of more than TRAIN_CHARS symbols of a language the longest texts are cut alike."""
    held: dict[str, list[np.ndarray]] = {}
    for language, texts in sorted(samples.items()):
        parts = [points for points, ok in map(normal, texts) if ok]
        if parts:
            most = max(1, _level([len(p) for p in parts], TRAIN_CHARS))
            held[language] = [p[:most] for p in parts][:TRAIN_CHARS]
    columns = int(min(COLUMNS, max(8, TABLE_BYTES // (8 * TRAIN_CHARS * len(held)) - 1)))
    every = np.unique(np.concatenate([p for parts in held.values() for p in parts]))
    number = np.zeros(sys.maxunicode + 1, np.uint16 if len(every) < 1 << 16 else np.uint32)
    number[every] = np.arange(1, len(every) + 1)
    symbols, automata, bits = [], [], []
    for parts in held.values():
        # every letter of the language's text has a symbol, the more frequent the smaller
        points, times = np.unique(np.concatenate(parts), return_counts=True)
        symbol = np.zeros(len(every) + 1, np.int32)
        symbol[number[points[np.lexsort((points, -times))]]] = np.arange(1, len(points) + 1)
        joined = np.concatenate([np.concatenate([symbol[number[p]], np.zeros(1, np.int32)]) for p in parts])
        symbols.append(symbol)
        automata.append(suffix_automaton(joined, len(points) + 1, columns))
        bits.append(math.log2(len(joined) + 1))
    return Model(list(held), number, symbols, automata, bits)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> Model | None:
    """A model of a bounded sample of ``docs`` with a language, a text and an id; None if there is none.

    Of each language about TRAIN_DOCS documents are drawn by a hash of the id; of a long one its first TRAIN_CHARS characters.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = named.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row per language
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r["lang"], min(1.0, TRAIN_DOCS / r["count"])).otherwise(share)
    head = F.substring(text_col, 1, TRAIN_CHARS)
    rows = named.where(draw < share).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("at"), head.alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    samples = {k: v for k, v in samples.items() if any(normal(t)[1] for t in v)}
    return fit(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``lang_pred`` and ``lang_score`` (0 to 1) of its whole texts.

    A null text or one without a letter is ``und`` with score 0, and without a model every text is.  Ties go to the
    language that sorts first.  Repeated rows give equal rows; columns of the
    new names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "lang_score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TABLE_BYTES and a few megabytes a language

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        values, languages, scores = texts.to_pylist(), [], []
        for part in _portions(values):
            a, b = sent.value.predict(part)
            languages += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.concatenate([*scores, np.empty(0)]))], ["lang", "score"])

    made = f"{free_prefix(docs.columns)}guess"
    return docs.withColumn(made, guess(F.col(text_col))).withColumns({"lang_pred": F.col(f"{made}.lang"), "lang_score": F.col(f"{made}.score")}).drop(made)


def _portions(values: list[str | None], chars: int = 1 << 21) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for v in values:
        if held and size + len(v or "") > chars:
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v or "")
    if held:
        yield held
