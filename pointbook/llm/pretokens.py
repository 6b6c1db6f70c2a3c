"""Pre-token boundaries without regular expressions.

A text is an array of code points. A class table turns it into symbols, and
the splitting pattern of the rank files becomes an automaton over symbols.
The change that one symbol makes to the state is a function, functions
compose associatively, and the automaton has few distinct compositions. So
the state before every code point comes from a blocked scan: compose within
blocks, compose over blocks, and replay inside blocks, each step over all
blocks at once.

The pattern, in order of choice: a contraction ('s 't 're 've 'm 'll 'd); an
optional space with letters; with digits; with other characters; white space
that no other character follows; white space.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .common import Texts

# Unicode White_Space, a fixed value.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of code points.
LETTER, DIGIT, OTHER, QUOTE, SPACE, BLANK = range(6)

# Symbols: a class and what follows. LAST_*: white space before another
# character; IN_WHITE: before white space or the end; SHORT, LONG: the quote
# of a contraction of one or two letters. FIRST is added at a text's start.
S_LETTER, S_DIGIT, S_OTHER, S_SHORT, S_LONG, LAST_SPACE, LAST_BLANK, IN_WHITE = range(8)
FIRST = 8

# States: FREE, a token has just ended; TWO and ONE, letters of a contraction to come.
FREE, LETTERS, DIGITS, OTHERS, WHITES, JOINING, TWO, ONE = range(8)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else DIGIT
    table[list(WHITE)] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token starts at it."""
    if symbol >= FIRST:
        return _step(FREE, symbol - FIRST)[0], True
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FREE, False
    run = {S_LETTER: LETTERS, S_DIGIT: DIGITS, S_OTHER: OTHERS, S_SHORT: OTHERS, S_LONG: OTHERS, IN_WHITE: WHITES}.get(symbol)
    if symbol == LAST_SPACE:
        return JOINING, True
    if symbol == LAST_BLANK:
        return FREE, True
    if state == run or (state == JOINING and run != WHITES):
        return run, False
    return {S_SHORT: ONE, S_LONG: TWO}.get(symbol, run), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, starts) by symbol and state; (composed with a symbol, composed with another) by composition; state by composition and first state."""
    symbols, states = range(2 * FIRST), range(8)
    after = np.array([[_step(s, x)[0] for s in states] for x in symbols], np.uint8)
    starts = np.array([[_step(s, x)[1] for s in states] for x in symbols])
    known = {tuple(states): 0}
    todo = [tuple(states)]
    for f in todo:
        for x in symbols:
            g = tuple(int(after[x][s]) for s in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    maps = np.array(todo, np.uint8)
    by_symbol = np.array([[known[tuple(int(after[x][s]) for s in f)] for x in symbols] for f in todo], np.int32)
    by_map = np.array([[known[tuple(int(g[s]) for s in f)] for g in todo] for f in todo], np.int32)
    return after, starts, by_symbol, by_map, maps


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The automaton's state before each symbol, from FREE."""
    after, _, by_symbol, by_map, maps = automaton()
    n = len(symbols)
    width = -(-n // block)
    # padding symbols come last and change no state that is read
    grid = np.full((width, block), FIRST, np.int32)
    grid.reshape(-1)[:n] = symbols
    grid = np.ascontiguousarray(grid.T)
    flat, k = by_symbol.reshape(-1), by_symbol.shape[1]
    whole = np.zeros(width, np.int32)
    for row in grid:
        whole = flat[whole * k + row]
    hop = 1  # inclusive scan over blocks: each round composes spans twice as long
    while hop < width:
        whole[hop:] = by_map[whole[:-hop], whole[hop:]]
        hop *= 2
    state = np.full(width, FREE, np.int32)
    state[1:] = maps[whole[:-1], FREE]
    out = np.empty((block, width), np.uint8)
    flat = after.reshape(-1)
    for j, row in enumerate(grid):
        out[j] = state
        state = flat[row * 8 + state].astype(np.int32)
    return out.T.reshape(-1)[:n]


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` marks the first one of each text."""
    kind = classes()[points]
    n = len(points)
    ends = np.append(first[1:], True)
    follows = np.append(points[1:], 0)
    white = kind >= SPACE
    before_other = ~ends & ~np.append(white[1:], True)
    out = np.array([S_LETTER, S_DIGIT, S_OTHER, S_OTHER, LAST_SPACE, LAST_BLANK], np.uint8)[kind]
    out[white & ~before_other] = IN_WHITE
    at = np.flatnonzero((kind == QUOTE) & ~ends)
    if len(at):
        a = follows[at]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = S_SHORT
        two = (at + 2 < n) & ~ends[np.minimum(at + 1, n - 1)]
        b = follows[np.minimum(at + 1, n - 1)]
        pair = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        out[at[two & pair]] = S_LONG
    return out + FIRST * first.astype(np.uint8)


def boundaries(texts: Texts) -> np.ndarray:
    """The byte position of each pre-token's start, over the whole buffer."""
    if not len(texts.data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(texts.raw().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((texts.data & 0xC0) != 0x80)
    first = np.zeros(len(points), bool)
    heads = texts.off[:-1][np.diff(texts.off) > 0]
    first[np.searchsorted(at, heads)] = True
    symbols = symbols_of(points, first)
    return at[automaton()[1][symbols, states_before(symbols)]]
