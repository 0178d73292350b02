"""Canonical length-limited Huffman codes over token ids, packed and unpacked by arrays."""

from __future__ import annotations

import numpy as np

#: Greatest code length; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Ids that are packed at a time.
PART = 1 << 15


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length per symbol (0: does not occur), optimal among codes of at most ``max_bits`` (package-merge)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    if n < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    merged, leaf = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        whole = len(merged) // 2 * 2
        packages = merged[0:whole:2] + merged[1:whole:2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaf.append(order < n)
    lengths, wanted = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(leaf):
        singles = int(level[:wanted].sum())
        lengths[:singles] += 1
        wanted = 2 * (wanted - singles)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes that go with the lengths: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        top = int(sizes[-1])
        spans = np.int64(1) << (top - sizes)
        codes[order] = ((np.cumsum(spans) - spans) >> (top - sizes)).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
    """The ids' codes one behind the other, and the bit at which each block of ids starts."""
    if len(ids) and not lengths[ids].all():
        raise ValueError("an id has no code")
    words, starts, total = np.zeros(int(lengths.max(initial=0)) * len(ids) // 32 + 2, np.uint32), [np.zeros(0, np.int64)], 0
    for k in range(0, len(ids), PART):  # arrays that stay in the processor's cache
        some = ids[k : k + PART]
        sizes = lengths[some].astype(np.int64)
        ends = np.cumsum(sizes)
        begin = ends - sizes + total
        total += int(ends[-1])
        word = begin >> 5
        # a code lies in one word of 32 bits or in two
        value = codes[some].astype(np.uint64) << (64 - sizes - (begin & 31)).view(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # the first code that starts in each word
        at = word[first]
        words[at] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
        words[at + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), first)
        starts.append(begin[-k % block :: block])
    return words[: (total + 31) // 32].astype(">u4").tobytes()[: (total + 7) // 8], np.concatenate(starts)


class Table:
    """Table-driven decoder: the next ``top`` bits tell the symbol and its length (0: they are no code)."""

    def __init__(self, lengths: np.ndarray):
        self.top = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = np.int64(1) << (self.top - lengths[order].astype(np.int64))
        self.entry = np.zeros(1 << self.top, np.uint64)  # symbol and, in the last five bits, length
        self.entry[: int(spans.sum())] = np.repeat(order.astype(np.uint64) << np.uint64(5) | lengths[order], spans)

    def unpack(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of blocks that start at the given bits and hold so many ids; all blocks advance together."""
        words = np.frombuffer(data + bytes(8 + -len(data) % 4), ">u4").astype(np.uint64)
        window = words[:-1] << np.uint64(32) | words[1:]  # 64 bits from each 32nd on
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        five, low, short, shift = np.uint64(5), np.uint64(31), np.uint64(31), np.uint64(64 - self.top)
        at, place, left = starts.astype(np.uint64), begins.copy(), counts.astype(np.int64)
        while len(at):
            most = int(left.min())
            found = np.empty((most, len(at)), np.uint64)
            for k in range(most):
                entry = self.entry[(window[at >> five] << (at & low)) >> shift]
                found[k] = entry
                at = at + (entry & short)
            if not (found & short).all():
                raise ValueError("bits that are no code")
            out[place[:, None] + np.arange(most)] = (found >> five).T
            place, left = place + most, left - most
            open_ = left > 0
            at, place, left = at[open_], place[open_], left[open_]
        return out
