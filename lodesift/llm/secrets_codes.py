"""The features of many tokens at once, as numbers.

``secrets_lexer.feature_keys`` says what the features of a token are; here the same keys are made for whole batches of
statements in numpy. Texts, gaps and words are numbered where they are met first, the parts of a lexeme are remembered, and what
a key weighs is looked up once per distinct key of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from lodesift.llm import crf
from lodesift.llm.secrets_lexer import PART_END, expanded, gap_class, lexemes, name_class, parts, value_class

#: Entries of a table of numbers from which all tables are begun anew, between two batches.
ENTRIES = 1 << 18
#: Characters from which a lexeme's parts aren't remembered.
LONG_LEXEME = 256

_PLAIN_NAMES = frozenset(("none", "other"))
_NO_NAME = frozenset(("urlpw", "path", "host", "private", "public", "data"))
_LINES = ("plain", "pairs", "url")


class _Numbers(dict):
    """Numbers of values in the order in which they are met; ``values`` leads back."""

    def __init__(self, *first: object):
        super().__init__()
        self.values: list = []
        for x in first:
            self[x]

    def __missing__(self, value: object) -> int:
        n = self[value] = len(self.values)
        self.values.append(value)
        return n


class _Grown:
    """Rows of small numbers that are appended one by one and read as an array."""

    def __init__(self, width: int):
        self.rows: list[tuple[int, ...]] = []
        self.array = np.zeros((0, width), dtype=np.int64)

    def read(self) -> np.ndarray:
        if len(self.array) < len(self.rows):
            self.array = np.concatenate([self.array, np.array(self.rows[len(self.array) :], dtype=np.int64)])
        return self.array


class Coder:
    """Scores of the labels for the tokens of statements, by a fitted model."""

    def __init__(self, fitted: crf.Model):
        self.fitted = fitted
        self.clear()

    def clear(self) -> None:
        self.kinds = _Numbers()
        self.strings = _Numbers()  # gaps as features see them, and ends of statements
        self.names = _Numbers("none", "other", "^", "$")
        self.words = _Numbers("")
        self.mains = _Numbers()
        self.heads = _Numbers("")
        # per token text and kind: kind, name, word, main value, length, entropy, head
        self.token_of: dict[tuple[str, str], int] = {}
        self.token_rows = _Grown(7)
        # per gap: as a feature, whether a part ends in it, the end of that part, the gap of the next part's first token
        self.gap_of: dict[str, int] = {}
        self.gap_rows = _Grown(4)
        self.lexemes: dict[tuple[str, str], tuple] = {}
        self.weights: dict[str, dict[int, np.ndarray]] = {}

    def full(self) -> bool:
        return max(len(self.token_of), len(self.gap_of), len(self.lexemes), len(self.strings), len(self.heads), len(self.words), *(len(w) for w in self.weights.values()), 0) > ENTRIES

    def _token(self, text: str, kind: str) -> int:
        n = self.token_of.get((kind, text))
        if n is None:
            name, word = name_class(text) if kind not in _NO_NAME and len(text) <= 60 else ("none", "")
            main, length, entropy = value_class(text) if len(text) <= 500 else value_class.__wrapped__(text)
            n = self.token_of[(kind, text)] = len(self.token_rows.rows)
            self.token_rows.rows.append((self.kinds[kind], self.names[name], self.words[word], self.mains[main], int(length[1:]), int(entropy[1:]), self.heads[text[:12].lower()[:12]]))
        return n

    def _gap(self, gap: str) -> int:
        n = self.gap_of.get(gap)
        if n is None:
            ends, tail, first = 0, 0, 0
            if ";" in gap or "}" in gap:
                m = PART_END.search(gap)
                if m:
                    ends, tail, first = 1, self.strings[gap[: m.end(m.lastindex)][:3] + "$"], self.strings[gap_class(gap[m.end() :].lstrip(" ,;"))]
            n = self.gap_of[gap] = len(self.gap_rows.rows)
            self.gap_rows.rows.append((self.strings[gap_class(gap)], ends, tail, first))
        return n

    def _parts(self, text: str, how: str) -> tuple:
        """The parts of a lexeme: start, end, token and (but for the first) the gap before it."""
        out, at = [], 0
        for a, b, kind in parts(text, how):
            out.append((a, b, self._token(text[a:b], kind), self._gap(text[at:a]) if out else 0))
            at = b
        return tuple(out)

    def add(self, line: str, starts: list[int], ends: list[int], toks: list[int], gaps: list[int]) -> int:
        """Appends the tokens of a statement to the lists; returns the number of the string behind its last token."""
        known, gap_of, at = self.lexemes, self.gap_of, 0
        for base, text, how in lexemes(line):
            if len(text) <= LONG_LEXEME:
                found = known.get((text, how))
                if found is None:
                    found = known[(text, how)] = self._parts(text, how)
            else:
                found = self._parts(text, how)
            first = True
            for a, b, tok, gap in found:
                a += base
                if first:
                    s = line[at:a]
                    g = gap_of.get(s)
                    gap = self._gap(s) if g is None else g
                    first = False
                at = base + b
                starts.append(a)
                ends.append(at)
                toks.append(tok)
                gaps.append(gap)
        return self.strings[line[at : at + 3] + "$"]

    def keys(self, toks: Sequence[int], gaps: Sequence[int], first: np.ndarray, tails: Sequence[int]) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
        """Groups of features: name, number of each token's key, and the tokens that have one (None: all).

        ``first``: positions of the statements' first tokens; ``tails``: the string behind each statement.
        """
        t, g = self.token_rows.read()[toks], self.gap_rows.read()[gaps]
        n = len(t)
        kind, name, word, main, length, entropy, head = t.T
        at = np.arange(n)
        paired = np.array([k.startswith("pair") for k in self.kinds.values], dtype=bool)
        starts = np.zeros(n, dtype=bool)
        starts[first] = True
        inner = (g[:, 1] == 1) & ~paired[kind] & ~starts  # first token of a part within a statement
        gap = np.where(inner, g[:, 3], g[:, 0])
        starts |= inner
        begin = np.maximum.accumulate(np.where(starts, at, 0))
        is_last = np.append(starts[1:], True)
        end = np.minimum.accumulate(np.where(is_last, at, n)[::-1])[::-1]
        tail = np.zeros(n, dtype=np.int64)
        tail[np.append(first[1:], n) - 1] = tails
        tail[np.flatnonzero(inner) - 1] = g[inner, 2]
        behind = np.where(is_last, tail, np.append(gap[1:], 0))
        told = ~np.isin(name, [self.names[x] for x in _PLAIN_NAMES])
        before = np.append(-1, np.maximum.accumulate(np.where(told, at, -1))[:-1])
        has = before >= begin
        left, left_word = np.where(has, name[before], self.names["^"]), np.where(has, word[before], self.words[""])
        after = np.append(np.minimum.accumulate(np.where(told, at, n)[::-1])[::-1][1:], n)
        right = np.where(after <= end, name[np.minimum(after, n - 1)], self.names["$"])
        edges = np.flatnonzero(starts)
        part = np.cumsum(starts) - 1
        of = np.zeros(len(edges), dtype=np.int64)
        for value, k in ((1, "pairval"), (2, "scheme")):
            of[np.logical_or.reduceat(kind == self.kinds[k], edges)] = value
        line = of[part]

        def packed(*columns: tuple[np.ndarray, int]) -> np.ndarray:
            out = np.zeros(len(columns[0][0]), dtype=np.int64)
            for c, bits in columns:
                out = (out << bits) | c
            return out

        yield "own", packed((kind, 5), (main, 5), (length, 4), (entropy, 6), (name, 4), (left, 4), (right, 4), (left_word, 20), (line, 2)), None
        yield "gap", packed((gap, 20), (kind, 5), (behind, 20)), None
        i = np.flatnonzero(at > begin)
        yield "before", packed((name[i - 1], 4), (kind[i - 1], 5), (kind[i], 5), (main[i], 5), (gap[i], 20)), i
        yield "pw", head[i - 1], i
        i = np.flatnonzero(at == begin)
        yield "first", main[i], i
        i = np.flatnonzero(at > begin + 1)
        yield "q", packed((name[i - 2], 4), (main[i], 5)), i
        yield "qw", head[i - 2], i
        i = np.flatnonzero(at < end)
        yield "x", packed((name[i + 1], 4), (main[i], 5)), i
        yield "xw", head[i + 1], i
        i = np.flatnonzero(is_last)
        yield "last", main[i], i

    def key(self, what: str, code: int) -> tuple:
        """The key of ``secrets_lexer.feature_keys`` that a number stands for."""

        def taken(*bits: int) -> list[int]:
            nonlocal code
            out = []
            for b in reversed(bits):
                out.append(code & ((1 << b) - 1))
                code >>= b
            return out[::-1]

        kinds, names, mains, strings = self.kinds.values, self.names.values, self.mains.values, self.strings.values
        if what == "own":
            kind, main, length, entropy, name, left, right, word, line = taken(5, 5, 4, 6, 4, 4, 4, 20, 2)
            return what, kinds[kind], (mains[main], f"n{length}", f"h{entropy}"), names[name], names[left], names[right], self.words.values[word], _LINES[line]
        if what == "gap":
            gap, kind, behind = taken(20, 5, 20)
            return what, strings[gap], kinds[kind], strings[behind]
        if what == "before":
            name, kind, own, main, gap = taken(4, 5, 5, 5, 20)
            return what, names[name], kinds[kind], kinds[own], mains[main], strings[gap]
        if what in ("pw", "qw", "xw"):
            return what, self.heads.values[code]
        if what in ("q", "x"):
            name, main = taken(4, 5)
            return what, names[name], mains[main]
        return what, mains[code]

    def scores(self, toks: Sequence[int], gaps: Sequence[int], first: np.ndarray, tails: Sequence[int]) -> np.ndarray:
        """The sum of the weights of each token's features, by label."""
        emit, known = self.fitted.emit, self.fitted.vocabulary
        out = np.zeros((len(toks), emit.shape[1]), dtype=emit.dtype)
        for what, codes, rows in self.keys(toks, gaps, first, tails):
            seen = self.weights.setdefault(what, {})
            distinct, which = np.unique(codes, return_inverse=True)
            sums = np.empty((len(distinct), emit.shape[1]), dtype=emit.dtype)
            for j, code in enumerate(distinct.tolist()):
                x = seen.get(code)
                if x is None:
                    x = seen[code] = emit[[known[f] for f in expanded(self.key(what, code)) if f in known]].sum(axis=0)
                sums[j] = x
            if rows is None:
                out += sums[which]
            else:
                out[rows] += sums[which]
        return out


def spans(coder: Coder, lines: Sequence[str], decode: Callable[[np.ndarray, np.ndarray], np.ndarray], wanted: int) -> list[tuple[tuple[int, int], ...]]:
    """The spans of the tokens of each line whose label is ``wanted``."""
    starts: list[int] = []
    ends: list[int] = []
    toks: list[int] = []
    gaps: list[int] = []
    tails: list[int] = []
    sizes: list[int] = []
    for line in lines:
        n = len(toks)
        tail = coder.add(line, starts, ends, toks, gaps)
        sizes.append(len(toks) - n)
        if sizes[-1]:
            tails.append(tail)
    out: list[tuple[tuple[int, int], ...]] = [()] * len(lines)
    if not toks:
        return out
    length = np.array(sizes)
    filled = np.flatnonzero(length)
    first = np.cumsum(length[filled]) - length[filled]
    path = decode(coder.scores(toks, gaps, first, tails), length[filled])
    hits = np.flatnonzero(path == wanted)
    owner = filled[np.searchsorted(first, hits, side="right") - 1]
    found: dict[int, list[tuple[int, int]]] = {}
    for i, k in zip(hits.tolist(), owner.tolist(), strict=True):
        found.setdefault(k, []).append((starts[i], ends[i]))
    for k, s in found.items():
        out[k] = tuple(s)
    return out
