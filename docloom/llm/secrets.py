"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain.  Texts
are indexed block by block (a block's postings list the documents of each trigram that some rule asks for, A-Z
lower-cased), a rule's query is answered by intersecting and uniting postings, and only the documents found are
matched with the rule itself.  A rule of whose matches no trigram is certain is matched with every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textblocks import LOWER, blocks


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, not overlapping) that ``keep`` accepts."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)


def _longer(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= least


#: The base rules, in the order that ties at one start have.  A run of 24 or more hex digits is found as such: shorter
#: runs, which would be dropped, never overlap one.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _longer(2, 6)),
    Rule("access", r"AKIA[A-Z0-9]+", _longer(0, 20)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Added rules: well-known public formats of keys and tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: None (anything), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
#: Sets of strings beyond this are given up for what they begin and end with.
MANY = 64


def _both(*queries: Query) -> Query:
    real = sorted({q for q in queries if q is not None}, key=str)
    return None if not real else real[0] if len(real) == 1 else ("and", tuple(real))


def _either(*queries: Query) -> Query:
    real = sorted(set(queries), key=str)
    return None if None in queries else real[0] if len(real) == 1 else ("or", tuple(real))


def _contains(strings: frozenset[str]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _either(*(_both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else None


@dataclass(frozen=True)
class _Known:
    """Of an expression's matches: all of them, if few; else their beginnings, their ends, and what they contain."""

    exact: frozenset[str] | None
    head: frozenset[str] = frozenset([""])
    tail: frozenset[str] = frozenset([""])
    query: Query = None

    def opened(self) -> "_Known":
        if self.exact is None:
            return self
        return _Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _contains(self.exact))


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def _after(x: _Known, y: _Known) -> _Known:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MANY:
        return _Known(_cross(x.exact, y.exact))
    p, q = x.opened(), y.opened()
    joint = _contains(_cross(x.exact or p.tail, y.exact or q.head)) if len(x.exact or p.tail) * len(y.exact or q.head) <= MANY * MANY else None
    head = frozenset(s[:2] for s in _cross(x.exact, q.head)) if x.exact is not None else p.head
    tail = frozenset(s[-2:] for s in _cross(p.tail, y.exact)) if y.exact is not None else q.tail
    return _Known(None, head, tail, _both(p.query, q.query, joint))


def _or(x: _Known, y: _Known) -> _Known:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MANY:
        return _Known(x.exact | y.exact)
    p, q = x.opened(), y.opened()
    return _Known(None, p.head | q.head, p.tail | q.tail, _either(p.query, q.query))


_ANY = _Known(None)
_EMPTY = _Known(frozenset([""]))


def _known(nodes) -> _Known:
    out = _EMPTY
    for op, arg in nodes:
        if op is rc.LITERAL:
            one = _Known(frozenset([chr(arg).lower()])) if arg < 128 else _ANY
        elif op is rc.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is rc.LITERAL and value < 128:
                    chars.add(chr(value).lower())
                elif kind is rc.RANGE and value[1] < 128 and value[1] - value[0] < 6:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            one = _Known(frozenset(chars)) if chars and len(chars) <= 6 else _ANY
        elif op is rc.SUBPATTERN:
            one = _known(arg[3])
        elif op is rc.BRANCH:
            one = _known(arg[1][0])
            for part in arg[1][1:]:
                one = _or(one, _known(part))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = arg
            each, one = _known(inner), _EMPTY
            for _ in range(min(least, 4)):
                one = _after(one, each)
            if (least, most) == (0, 1):
                one = _or(_EMPTY, each)
            elif least == 0:
                one = _ANY
            elif most > min(least, 4):
                many = one.opened()
                one = _Known(None, many.head, many.tail, many.query)
        elif op is rc.AT:
            one = _EMPTY
        else:
            one = _ANY
        out = _after(out, one)
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-cased ASCII trigrams that every text with a match satisfies; None: no such."""
    return _known(rp.parse(pattern)).opened().query


def _trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Scanner:
    """Rules with their queries, and the index of the trigrams that the queries ask for."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r.kind, re.compile(r.pattern, re.ASCII), r.keep, trigram_query(r.pattern)) for r in rules]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*(_trigrams(r[3]) for r in self.rules))), 1)}
        self.wanted = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.wanted[int.from_bytes(t.encode("ascii"), "big")] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """Row t, column d: whether document d of the block has trigram t."""
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)].astype(np.uint32)
        found = self.wanted[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, "right")
        out = np.zeros((len(self.number) + 1, len(texts) + 1), bool)
        out[found[at], doc] = True
        return out[:, : len(texts)]

    def _answer(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = [self._answer(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each document the spans (start, number of rule, end), sorted, in code points."""
        postings, out = self.postings(texts), [[] for _ in texts]
        decoded: dict[int, str] = {}
        for number, (_, pattern, keep, query) in enumerate(self.rules):
            for d in np.flatnonzero(self._answer(query, postings)):
                text = decoded.get(d)
                if text is None:
                    text = decoded[d] = texts[d].decode("utf-8", "replace")
                out[d] += [(m.start(), number, m.end()) for m in pattern.finditer(text) if keep(m)]
        return [sorted(x) for x in out]


def secret_spans(docs: DataFrame, more: Sequence[Rule] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end by start, then in the rules' order) of every row of ``docs``.

    Positions are code points, ends exclusive.  The base rules' spans are there whatever ``more`` adds; spans of
    different kinds may overlap.  A null or empty text has no spans; repeated rows give equal rows; other columns
    are ignored; an empty table gives an empty result.  With ``redact`` there is a column ``clean``: the text with every span's characters replaced by
    ``*`` (null stays null).
    """
    rules = [*BASE_RULES, *more]
    kinds = [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made: list[Scanner] = []

    def masked(text: bytes | None, spans: list[tuple[int, int, int]]) -> str | None:
        if text is None or not spans:
            return None if text is None else text.decode("utf-8", "replace")
        chars = list(text.decode("utf-8", "replace"))
        for a, _, b in spans:
            chars[a:b] = "*" * (b - a)
        return "".join(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = made[0] if made else Scanner([*BASE_RULES, *more])
        made[:] = [scanner]
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                spans = scanner.scan(texts)
                column = pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in spans], span)
                columns, names = [batch.column(0).slice(first, len(texts)), column], ["doc_id", "spans"]
                if redact:
                    valid = batch.column(1).slice(first, len(texts)).is_valid().to_pylist()
                    columns.append(pa.array([masked(t if ok else None, x) for t, ok, x in zip(texts, valid, spans, strict=True)], pa.string()))
                    names.append("clean")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>" + ", clean string" * redact
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
