"""Word boundaries of whole batches of text by array operations, without regular expressions.

A pre-tokeniser's pattern is written as a finite-state machine over symbols
(code-point classes that already hold the lookahead). Each symbol is a function
from state to state. Composition of such functions is associative, so the states
before all characters come from a scan over function compositions: the functions
that can arise are closed under composition and numbered, and composing two is
one look-up in a square table. Columns of a matrix are scanned side by side.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, BLANK, END = range(6)  # BLANK: U+0020
APOSTROPHE = 39
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
ROWS = 64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, asked of the tokeniser library, so that both have the same Unicode version."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    table = np.zeros(0x110000 + 1, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[32] = BLANK
    return table


@lru_cache(1)
def unknown() -> np.ndarray:
    """Code points that Python's own Unicode tables don't know."""
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


class Machine:
    """step[state][symbol] is the next state, starts[state][symbol] tells whether a token starts there."""

    def __init__(self, step: list[list[int]], starts: list[list[bool]]):
        step_ = np.array(step, np.uint8)
        self.states, self.symbols = step_.shape
        basic = [tuple(step_[:, s]) for s in range(self.symbols)]
        number = {tuple(range(self.states)): 0}
        todo = [tuple(range(self.states))]
        while todo:
            f = todo.pop()
            for g in basic:
                h = tuple(int(g[x]) for x in f)
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
        known = sorted(number, key=number.get)
        self.apply = np.array(known, np.uint8)
        self.compose = np.array([[number[tuple(int(g[x]) for x in f)] for g in known] for f in known], np.uint16)
        self.element = np.array([number[tuple(int(x) for x in f)] for f in basic], np.uint16)
        self.starts = np.array(starts, bool)

    def _scan(self, elements: np.ndarray) -> np.ndarray:
        """Inclusive scan of function compositions."""
        n = len(elements)
        if n <= ROWS:
            out = elements.copy()
            for i in range(1, n):
                out[i] = self.compose[out[i - 1], elements[i]]
            return out
        wide = -(-n // ROWS)
        grid = np.zeros(ROWS * wide, np.uint16)
        grid[:n] = elements
        grid = np.ascontiguousarray(grid.reshape(wide, ROWS).T)
        flat, size = self.compose.ravel(), np.int64(len(self.compose))
        for i in range(1, ROWS):
            np.take(flat, grid[i - 1] * size + grid[i], out=grid[i])
        before = np.zeros(wide, np.uint16)
        before[1:] = self._scan(grid[-1])[:-1]
        return np.take(flat, (before * size)[None, :] + grid).T.reshape(-1)[:n]

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Positions at which tokens start; state 0 holds before the first symbol."""
        if not len(symbols):
            return np.zeros(0, np.int64)
        state = np.zeros(len(symbols), np.uint8)
        state[1:] = self.apply[self._scan(self.element[symbols])[:-1], 0]
        return np.flatnonzero(self.starts.ravel()[state.astype(np.int64) * self.symbols + symbols])


#: Symbols of both machines. A contraction's apostrophe has the letters that follow it looked up; of white space,
#: RUN is followed by more of it or by the end, LAST and LAST_BLANK stand before something else.
L, N, O, ONE, TWO, RUN, LAST, LAST_BLANK, STOP = range(9)


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ends: positions of the separators between texts, the last position among them."""
    kind = classes()[points]
    kind[ends] = END
    after = np.full(len(kind), END, np.uint8)
    after[:-1] = kind[1:]
    out = np.array([O, L, N, LAST, LAST_BLANK, STOP], np.uint8)[kind]
    white = (kind == SPACE) | (kind == BLANK)
    out[white & ((after == SPACE) | (after == BLANK) | (after == END))] = RUN
    at = np.flatnonzero((points == APOSTROPHE) & (kind != END))
    if len(at):
        first = points[at + 1]  # an end follows every text
        one = np.isin(first, [ord(c) for c in ONE_LETTER]) & (kind[at + 1] != END)
        out[at[one]] = ONE
        for pair in TWO_LETTERS:
            two = at[(first == ord(pair[0])) & (kind[at + 1] != END)]
            out[two[(points[two + 2] == ord(pair[1])) & (kind[two + 2] != END)]] = TWO
    return out


@lru_cache(1)
def byte_level() -> Machine:
    """'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before others|white space"""
    fresh, letters, numbers, others, white, blank, one, two = range(8)
    step, starts = [], []
    for s in range(8):
        row, start = [0] * 9, [True] * 9
        for sym, run in ((L, letters), (N, numbers), (O, others), (ONE, others), (TWO, others)):
            row[sym], start[sym] = run, s not in (run, blank)
            if sym in (ONE, TWO) and s not in (others, blank):
                row[sym] = one if sym == ONE else two
        row[RUN], start[RUN] = white, s != white
        row[LAST], row[LAST_BLANK] = fresh, blank
        if s in (one, two):
            row[L], start[L] = (fresh if s == one else one), False
        step.append(row)
        starts.append(start)
    return Machine(step, starts)


@lru_cache(1)
def word_level() -> Machine:
    """'s|'t|'re|'ve|'m|'ll|'d|letters|number|others; white space starts a piece of its own, which is dropped. words() finds the same without stepping and is tested against this."""
    fresh, letters, others, one, two = range(5)
    step, starts = [], []
    for s in range(5):
        row, start = [0] * 9, [True] * 9
        for sym, run in ((L, letters), (O, others), (ONE, others), (TWO, others)):
            row[sym], start[sym] = run, s != run
            if sym in (ONE, TWO) and s != others:
                row[sym] = one if sym == ONE else two
        if s in (one, two):
            row[L], start[L] = (fresh if s == one else one), False
        step.append(row)
        starts.append(start)
    return Machine(step, starts)


def located(machine: Machine, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, joined with a separator after each, where pieces start in that, and which of these are separators.

    Work and memory are in proportion to the texts' length; callers bound it.
    """
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    starts = machine.boundaries(symbols(padded, np.concatenate([ends, [len(points), len(points) + 1]]))[: len(points)])
    return points, starts, np.searchsorted(starts, ends)


#: Code points that are no characters, one of which texts may be cut at.
NONCHARACTERS = (*range(0xFDD0, 0xFDF0), 0xFFFE, 0xFFFF, *(plane << 16 | last for plane in range(1, 17) for last in (0xFFFE, 0xFFFF)))


def cut(points: np.ndarray, starts: np.ndarray) -> list[str]:
    """The pieces as texts. starts: ascending, from 0."""
    mark = next((c for c in NONCHARACTERS if not (points == c).any()), None)
    if mark is None:
        text = points.tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in pairwise([*starts.tolist(), len(text)])]
    marked = np.full(len(points) + len(starts) - 1, mark, np.uint32)
    own = np.ones(len(marked), bool)
    own[starts[1:] + np.arange(len(starts) - 1)] = False
    marked[own] = points
    return marked.tobytes().decode("utf-32-le").split(chr(mark))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of word_level() without white space: their code points, where each starts in these, and how many there are up to the end of each text.

    Neighbours alone tell where they start: an apostrophe begins a contraction unless it stands in a run of others, that is, behind one of them.
    """
    points = np.frombuffer(("\0".join(texts) + "\0\0\0").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes()[points]
    kind[ends] = kind[-2:] = END
    start = kind >= NUMBER
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(points == APOSTROPHE)
    at = at[start[at]]
    first, second = points[at + 1], points[at + 2]  # an end follows every text, and two more the last
    for size, short in ((1, np.isin(first, [ord(c) for c in ONE_LETTER])), (2, np.any([(first == ord(a)) & (second == ord(b)) for a, b in TWO_LETTERS], axis=0))):
        start[at[short] + 1] = False
        start[at[short] + 1 + size] = True
    own = kind < SPACE
    starts = np.flatnonzero(start[own])
    return points[own], starts, np.searchsorted(starts, np.cumsum(own)[ends])


def distinct(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of the different pieces each one is, and these pieces, each the bytes of its code points. starts: as for cut(), or none."""
    places = 4 * np.append(starts, len(points))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(points)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def texts(pieces: pa.Array) -> list[str]:
    """Pieces of distinct() as texts."""
    if not len(pieces):
        return []
    _, places, values = pieces.buffers()
    places = np.frombuffer(places, np.int64, pieces.offset + len(pieces) + 1)[pieces.offset :] // 4
    return cut(np.frombuffer(values, np.uint32, int(places[-1]))[places[0] :], places[:-1] - places[0])


def groups(texts: list[str], most: int = 1 << 20):
    """Runs of texts with at most so many code points together, a longer text alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
