"""Static range asymmetric numeral system over token ids, on arrays of independent interleaved lanes.

A block of ids is cut into segments of ``SEGMENT`` ids. In a segment, id ``p`` belongs to lane ``p % LANES``; every
lane is a coder of its own with a 64-bit state, and the 32-bit words that lanes give off stand in one stream in the
order in which a decoder wants them. A segment's first states and its place in the stream are its checkpoint, so any
segment decodes alone. Segments are worked on side by side: numpy's width is segments times lanes.
"""

from __future__ import annotations

import numpy as np

#: Frequencies add up to 2**SCALE; a state is kept at or above 2**LOW.
SCALE, LOW = 20, 31
LANES, STEPS = 32, 512
SEGMENT = LANES * STEPS
#: Segments coded at once.
WIDTH = 192
_WORD = 32


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that add up to 2**SCALE; every id that occurs keeps at least one."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    whole = 1 << SCALE
    share = np.where(counts > 0, np.maximum(1, (counts.astype(float) * whole / total).astype(np.int64)), 0)
    over = int(share.sum()) - whole
    for i in np.argsort(-share, kind="stable"):  # the rounding error goes to the most frequent ids
        step = min(over, int(share[i]) - 1) if over > 0 else over
        share[i] -= step
        over -= step
        if not over:
            break
    if over:
        raise ValueError("more ids occur than the table has places")
    return share.astype(np.uint64)


class Table:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.int64)
        self.before = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))
        self.common = int(np.argmax(frequencies)) if len(frequencies) else 0


def _shape(length: int) -> list[int]:
    """Steps of each segment of a block."""
    steps = -(-length // LANES)
    return [min(STEPS, steps - s) for s in range(0, steps, STEPS)]


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (segments x lanes), words per segment, and the stream of words of one block."""
    steps = np.array(_shape(len(ids)), np.int64)
    padded = np.full(int(steps.sum()) * LANES, table.common, np.int64)
    padded[:len(ids)] = ids
    states, sizes, streams = [], [], []
    for s in range(0, len(steps), WIDTH):
        part = steps[s:s + WIDTH]
        symbols = np.full((len(part), STEPS, LANES), table.common, np.int64)
        symbols.reshape(-1)[:int(part.sum()) * LANES] = padded[s * SEGMENT:s * SEGMENT + int(part.sum()) * LANES]
        state, words, given = _encode(symbols, part, table)
        states.append(state)
        for k in range(len(part)):
            stream = words[:, k][given[:, k]]
            sizes.append(len(stream))
            streams.append(stream)
    if not states:
        return np.zeros((0, LANES), np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return np.concatenate(states).astype(np.uint64), np.array(sizes, np.uint32), np.concatenate(streams)


def _encode(symbols: np.ndarray, steps: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count, width, _ = symbols.shape
    state, least = np.full((count, LANES), 1 << LOW, np.int64), int(steps.min())
    words, given = np.zeros((width, count, LANES), np.uint32), np.zeros((width, count, LANES), bool)
    for t in reversed(range(int(steps.max()))):
        at = slice(None) if least > t else np.flatnonzero(steps > t)
        symbol, x = symbols[at, t], state[at]
        f = table.frequency.take(symbol)
        full = (x >> (LOW - SCALE + 32)) >= f
        words[t, at] = x.astype(np.uint32)
        given[t, at] = full
        x = np.where(full, x >> _WORD, x)
        quotient = (x.view(np.uint64) // f.view(np.uint64)).view(np.int64)
        state[at] = (quotient << SCALE) + (x - quotient * f) + table.before.take(symbol)
    return state, words, given


def decode(length: int, states: np.ndarray, sizes: np.ndarray, stream: np.ndarray, table: Table) -> np.ndarray:
    """The ids of one block."""
    steps = np.array(_shape(length), np.int64)
    if len(steps) != len(sizes) or int(sizes.sum()) != len(stream):
        raise ValueError("the block's checkpoints do not fit its length")
    ends = np.cumsum(sizes.astype(np.int64))
    out = [_decode(steps[s:s + WIDTH], states[s:s + WIDTH], (ends - sizes)[s:s + WIDTH], stream, table) for s in range(0, len(steps), WIDTH)]
    return np.concatenate(out)[:length] if out else np.zeros(0, np.uint32)


def decode_segment(number: int, length: int, states: np.ndarray, sizes: np.ndarray, stream: np.ndarray, table: Table) -> np.ndarray:
    """The ids of one segment alone, from its checkpoint."""
    steps = np.array(_shape(length)[number:number + 1], np.int64)
    first = int(sizes[:number].astype(np.int64).sum())
    ids = _decode(steps, states[number:number + 1], np.array([first]), stream, table)
    return ids[:min(SEGMENT, length - number * SEGMENT)]


def _decode(steps: np.ndarray, states: np.ndarray, first: np.ndarray, stream: np.ndarray, table: Table) -> np.ndarray:
    state, place, least = states.astype(np.int64), first.astype(np.int64), int(steps.min())
    out = np.zeros((len(steps), int(steps.max()), LANES), np.uint32)
    stream = np.append(stream, np.uint32(0)).astype(np.int64)
    count = np.arange(len(steps) * LANES)
    for t in range(int(steps.max())):
        at = slice(None) if least > t else np.flatnonzero(steps > t)
        x = state[at]
        slot = x & ((1 << SCALE) - 1)
        symbol = table.symbol.take(slot)
        out[at, t] = symbol
        x = table.frequency.take(symbol) * (x >> SCALE) + slot - table.before.take(symbol)
        # the lanes that want a word, segment by segment
        empty = np.flatnonzero(x < 1 << LOW)
        rows = empty // LANES
        taken = np.bincount(rows, minlength=len(x))
        index = np.minimum((place[at] - np.cumsum(taken) + taken).take(rows) + count[:len(rows)], len(stream) - 1)
        x.reshape(-1)[empty] = (x.take(empty) << _WORD) | stream.take(index)
        state[at] = x
        place[at] += taken
    flat = out.reshape(len(steps), -1)
    return flat.reshape(-1) if len(set(steps.tolist())) == 1 else np.concatenate([flat[k, :n * LANES] for k, n in enumerate(steps)])
