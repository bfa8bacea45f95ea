"""Static range asymmetric numeral systems (rANS) over token ids, vectorised over blocks and lanes.

A block of ids is dealt to ``LANES`` interleaved states of 64 bits with words of 32 bits. All blocks share one static
table of frequencies that add up to 2**bits. Every ``STEPS`` steps the encoder notes the states and the place in the
word stream (a checkpoint), so any stretch between two checkpoints decodes alone, side by side with the others.

Block: header ``<4sIIII`` (magic, ids, segments, words, crc32 of all that follows), then for each segment ``<Q``
* LANES states and ``<I`` first word, then the words ``<u4``. Lanes beyond the last id code nothing.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 16, 512
SEGMENT = LANES * STEPS
MAGIC = b"LRA1"
_HEAD = struct.Struct("<4sIIII")
_LOW = np.uint64(1 << 31)
_W, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


def quantise(counts: np.ndarray, least_bits: int = 16) -> tuple[np.ndarray, int]:
    """Frequencies that add up to 2**bits, at least 1 for each id that occurs."""
    seen = np.flatnonzero(counts)
    bits = max(least_bits, int(len(seen)).bit_length() + 2)
    if bits > 24:
        raise ValueError("more than 4 million different ids")
    freq = np.zeros(len(counts), np.int64)
    if len(seen):
        share = counts[seen] / counts[seen].sum() * ((1 << bits) - len(seen))
        freq[seen] = 1 + np.floor(share).astype(np.int64)
        rest = (1 << bits) - freq.sum()
        # What rounding left goes to the largest remainders, ties to the smaller id.
        order = np.lexsort((seen, -(share - np.floor(share))))
        freq[seen[order[:rest]]] += 1
    return freq, bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - bits)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.low = np.uint64((1 << bits) - 1)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Each block alone; the segments of all blocks are coded side by side."""
        if not blocks:
            return []
        parts = [b[i : i + SEGMENT] for b in blocks for i in range(0, max(len(b), 1), SEGMENT)]
        table = np.zeros((len(parts), SEGMENT), np.int64)
        for row, p in zip(table, parts, strict=True):
            row[: len(p)] = p
        sizes = np.asarray([len(p) for p in parts])
        table = table.reshape(len(parts), STEPS, LANES)
        state = np.full((len(parts), LANES), _LOW, np.uint64)
        lane = np.arange(LANES)
        who, words = [], []
        for step in range(int(-(-sizes.max() // LANES)) - 1, -1, -1):
            live = step * LANES + lane < sizes[:, None]
            ids = table[:, step]
            f, x = self.freq[ids], state
            out = live & (x >= self.most[ids])
            who.append(np.nonzero(out)[0][::-1])
            words.append((x[out] & _MASK).astype("<u4")[::-1])
            x = np.where(out, x >> _W, x)
            f = np.where(live, f, np.uint64(1))
            q, r = np.divmod(x, f)
            state = np.where(live, (q << self.bits) + r + self.start[ids], x)
        who, words = np.concatenate(who)[::-1], np.concatenate(words)[::-1]
        order = np.argsort(who, kind="stable")
        words, per = words[order], np.bincount(who, minlength=len(parts))
        at, first, out = 0, np.concatenate([[0], np.cumsum(per)]), []
        for b in blocks:
            n = max(1, -(-len(b) // SEGMENT))
            place = first[at : at + n] - first[at]
            marks = b"".join(state[at + i].astype("<u8").tobytes() + struct.pack("<I", place[i]) for i in range(n))
            body = marks + words[first[at] : first[at + n]].tobytes()
            out.append(_HEAD.pack(MAGIC, len(b), n, int(first[at + n] - first[at]), zlib.crc32(body)) + body)
            at += n
        return out

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; every segment starts from its own checkpoint. Raises on a damaged block."""
        states, places, words, sizes, heads, base = [], [], [], [], [], 0
        for raw in blocks:
            magic, n, segments, n_words, crc = _HEAD.unpack_from(raw)
            body = memoryview(raw)[_HEAD.size :]
            if magic != MAGIC or zlib.crc32(body) != crc:
                raise ValueError("damaged block")
            mark = 8 * LANES + 4
            for i in range(segments):
                states.append(np.frombuffer(body, "<u8", LANES, i * mark))
                places.append(base + struct.unpack_from("<I", body, i * mark + 8 * LANES)[0])
                sizes.append(min(SEGMENT, n - i * SEGMENT))
            words.append(np.frombuffer(body, "<u4", n_words, segments * mark))
            heads.append((n, segments))
            base += n_words
        if not blocks:
            return []
        x, place, size = np.array(states, np.uint64), np.array(places, np.int64), np.array(sizes)
        stream = np.concatenate([*words, np.zeros(1, "<u4")]).astype(np.uint64)
        table, lane = np.zeros((len(x), STEPS, LANES), np.uint32), np.arange(LANES)
        for step in range(int(-(-size.max() // LANES))):
            live = step * LANES + lane < size[:, None]
            low = x & self.low
            ids = np.where(live, self.slot[low], 0)
            table[:, step] = ids
            y = self.freq[ids] * (x >> self.bits) + low - self.start[ids]
            need = live & (y < _LOW)
            at = place[:, None] + np.cumsum(need, axis=1) - need
            y = np.where(need, y << _W | stream[np.where(need, at, 0)], y)
            x = np.where(live, y, x)
            place = place + need.sum(axis=1)
        if not (x == _LOW).all():
            raise ValueError("damaged block: the states do not end where they began")
        flat, out, at = table.reshape(len(x), SEGMENT), [], 0
        for n, segments in heads:
            out.append(flat[at : at + segments].reshape(-1)[:n])
            at += segments
        return out
