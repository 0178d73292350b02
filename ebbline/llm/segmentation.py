"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by perturbed A* search.

The lattice of a text has an edge for every vocabulary piece that fits at a place.  A segmentation's
probability is proportional to the product of its pieces' weights; backward sums over the lattice turn
the weights into the conditional probability of each next piece.  Every segmentation gets a Gumbel
number with its log-probability as location; the k highest are a sample without replacement.  The
search keeps sets of segmentations (a common beginning, or all that leave a path behind a place) with
the highest number in the set, and opens the set with the highest one; a set's number is the bound
for all in it, so the numbers come out in order.

Pieces of these models do not reach across the beginning of a word, so a text's lattice is a chain of
its words' lattices, and a word's lattice is built once.  All texts of a group advance together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import byte_groups

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")
#: Symbols of a character that is no piece: its bytes, each one above all code points.
BYTES_FROM = 0x110000
#: Bytes of lattices that a task remembers between groups, and what an edge and a word take.
LATTICE_BYTES, EDGE_BYTES, WORD_BYTES = 48 << 20, 25, 200
#: Logarithms are multiples of 1 / FINE, some 2e-10.
FINE = 2.0**32
#: Characters of new words whose lattices are built at once.
PART = 30_000
#: Fewer words or places than this are advanced one by one.
FEW = 6
#: Places behind a branch whose alternatives are looked at at once; the rest wait as one set.
AHEAD = 4
SAMPLES = "samples array<struct<rank: int, ids: array<int>, log_prob: double, perturbed: double, inclusion: double, exact: boolean>>"


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that depend on row key and counter alone."""
    bits = spread(keys ^ spread(counters.astype(np.uint64)))
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def draw(streams, turn) -> np.ndarray:
    """Numbers between 0 and 1, the given turns of streams of draws."""
    with np.errstate(over="ignore"):
        bits = spread(streams + np.asarray(turn).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def word_streams(keys: np.ndarray, place: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """A stream of draws for each word of each sample of a row."""
    with np.errstate(over="ignore"):
        return spread(spread(spread(keys) + place.astype(np.uint64)) + sample.astype(np.uint64))


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


class Vocabulary:
    """Pieces of a model as code points, found by their hashes length by length."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {k for k in range(size) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)}
        if len(set(self.bytes)) != 256 or not all(model.is_byte(k) for k in self.bytes):
            raise ValueError("the model has no pieces for single bytes")
        probe = "  a \n b"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts before it splits them")
        pieces = {k: model.id_to_piece(k) for k in range(size) if k not in special}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces.values()):
            raise ValueError("pieces reach across words")
        # Merge ranks stand for frequency ranks: weights by Zipf's law, bytes as the rarest piece.
        rank = {k: n + 1 for n, k in enumerate(sorted(pieces, key=lambda k: -model.get_score(k)))}
        self.weight = np.full(size, -alpha * np.log(len(pieces) + 1.0))
        self.weight[list(rank)] = -alpha * np.log(np.array(list(rank.values()), float))
        texts = [b""] * size
        for k, p in pieces.items():
            texts[k] = p.replace(SPACE, " ").encode()
        for b, k in enumerate(self.bytes):
            texts[k] = bytes([b])
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.longest = max(map(len, pieces.values()))
        self.single = np.zeros(BYTES_FROM, bool)  # characters that are a piece
        self.single[[ord(p) for p in pieces.values() if len(p) == 1]] = True
        found: dict[int, int] = {}
        for k, p in pieces.items():
            h = np.uint64(0)
            for c in p:
                h = self.extend(h, np.uint64(ord(c)))
                found.setdefault(int(h), -1)
            found[int(h)] = k
        # open addressing; a slot that is free ends the search
        bits = max(8, (8 * len(found)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.hashes, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        waiting, values = np.array(list(found), np.uint64), np.array(list(found.values()), np.int32)
        slot = waiting & self.mask
        while len(waiting):
            here = np.unique(slot, return_index=True)[1]
            here = here[self.hashes[slot[here]] == 0]
            self.hashes[slot[here]], self.ids[slot[here]] = waiting[here], values[here]
            left = np.ones(len(waiting), bool)
            left[here] = False
            waiting, values, slot = waiting[left], values[left], (slot[left] + np.uint64(1)) & self.mask

    @staticmethod
    def extend(h, symbol):
        with np.errstate(over="ignore"):
            return spread(np.asarray(h ^ symbol, np.uint64))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for the beginning of longer pieces only, -2 for none."""
        slot = h & self.mask
        there = self.hashes[slot]
        out = self.ids[slot]
        rows = np.flatnonzero((there != h) & (there != 0))
        while len(rows):
            slot[rows] = (slot[rows] + np.uint64(1)) & self.mask
            there = self.hashes[slot[rows]]
            out[rows] = self.ids[slot[rows]]
            rows = rows[(there != h[rows]) & (there != 0)]
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of flat ids, cut at the ends, without the space that was put in front."""
        sizes = self.text_sizes[ids]
        begins = np.cumsum(sizes) - sizes
        data = self.texts[np.repeat(self.text_starts[ids] - begins, sizes) + np.arange(sizes.sum())].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes)])[ends]
        starts = np.concatenate([[0], stops[:-1]])
        return [data[a:b][1:] for a, b in zip(starts.tolist(), stops.tolist())]


class Lattices:
    """Lattices of words: nodes are places, edges of a node lie together, long pieces first.

    Memory is bounded by bytes and by a group's own words.  When the bound is reached, words that only
    one group has held go; the others stay, the most frequent ones first, in half of the room.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = LATTICE_BYTES):
        self.vocabulary, self.limit = vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = self.edges = 0  # how many are in use; the arrays below have room for more
        self.first = np.zeros(1, np.int64)  # node -> first edge; one more at the end
        self.entry = np.zeros(1, np.int64)  # word -> first node; one more at the end
        self.seen = np.zeros(0, np.int64)  # word -> groups that held it
        self.piece, self.step = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.source = np.zeros(0, np.int32)
        self.upto, self.log = np.zeros(0), np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of a group's distinct words; new words get lattices."""
        if EDGE_BYTES * self.edges + 8 * self.nodes + WORD_BYTES * len(self.known) > self.limit:
            self._trim()
        new = [w for w in words if w not in self.known]
        if new:
            self._add(new)
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.seen[found] += 1
        return found

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Values behind the first ``at`` of an array, which grows by a quarter at least when it is full."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            wider = np.empty(max(len(held) * 5 // 4, at + len(values)), held.dtype)
            wider[:at] = held[:at]
            setattr(self, name, held := wider)
        held[at : at + len(values)] = values

    def _trim(self) -> None:
        seen, entry = self.seen[: len(self.known)], self.entry[: len(self.known) + 1]
        edges = self.first[entry[1:]] - self.first[entry[:-1]]
        cost = EDGE_BYTES * edges + 8 * np.diff(entry) + WORD_BYTES
        order = np.argsort(-seen, kind="stable")
        room = np.cumsum(cost[order]) <= self.limit // 2
        keep = np.sort(order[room & (seen[order] > 1)])
        names = list(self.known)  # in order of their numbers
        first, piece, step, source, upto, log = self.first, self.piece, self.step, self.source, self.upto, self.log
        self.clear()
        if not len(keep):
            return
        self.known.update((names[k], j) for j, k in enumerate(keep.tolist()))
        self.seen = np.ones(len(keep), np.int64)
        nodes, some = entry[keep + 1] - entry[keep], edges[keep]
        self.entry = np.concatenate([[0], np.cumsum(nodes)])
        moved = self.entry[:-1] - entry[keep]
        at_node = _ranges(entry[keep], nodes)
        at_edge = _ranges(first[entry[keep]], some)
        begin = np.cumsum(some) - some
        self.first = np.append(first[at_node] + np.repeat(begin - first[entry[keep]], nodes), some.sum())
        self.piece, self.step, self.upto, self.log = piece[at_edge], step[at_edge], upto[at_edge], log[at_edge]
        self.source = (source[at_edge] + np.repeat(moved, some)).astype(np.int32)
        self.nodes, self.edges = len(at_node), len(at_edge)

    def _add(self, words: list[str]) -> None:
        """Lattices of new words, in parts of some 30,000 characters."""
        sizes = np.cumsum([len(w) for w in words])
        cuts = np.flatnonzero(np.diff(sizes // PART, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
            entry, first, source, piece, step, upto, log = self._build(words[a:b])
            number = len(self.known)
            self.known.update(zip(words[a:b], range(number, number + b - a)))
            self._put("seen", number, np.zeros(b - a, np.int64))
            self._put("entry", number, entry + self.nodes)
            self._put("first", self.nodes, first + self.edges)
            self._put("source", self.edges, source + self.nodes)
            for name, values in (("piece", piece), ("step", step), ("upto", upto), ("log", log)):
                self._put(name, self.edges, values)
            self.nodes, self.edges = self.nodes + int(entry[-1]), self.edges + int(first[-1])

    def _build(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """entry, first, source, piece, step, upto, log of these words alone."""
        vocabulary = self.vocabulary
        symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, owner = self._bytes(symbols, owner)
        n, sizes = len(symbols), np.bincount(owner, minlength=len(words))
        ends = np.cumsum(sizes)
        left = ends[owner] - np.arange(n)
        raw = np.flatnonzero(symbols >= BYTES_FROM)
        fitting = [(raw, np.array(vocabulary.bytes, np.int32)[symbols[raw] - BYTES_FROM], 1)]
        at, wide = np.flatnonzero(symbols < BYTES_FROM), symbols.astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for length in range(1, vocabulary.longest + 1):
            if not len(at):
                break
            h = vocabulary.extend(h, wide[at + (length - 1)])
            found = vocabulary.lookup(h)
            whole = np.flatnonzero(found >= 0)
            fitting.append((at[whole], found[whole], length))
            longer = np.flatnonzero((found > -2) & (left[at] > length))
            at, h = at[longer], h[longer]
        # edges go to their places without sorting: places by their distance from the word's end, long pieces first
        counts = np.zeros(n, np.int64)
        for source, _, _ in fitting:
            counts[source] += 1
        by_depth = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        spread_counts = counts[by_depth]
        begin = np.cumsum(spread_counts) - spread_counts
        free = np.empty(n, np.int64)
        free[by_depth] = begin
        low = free.copy()
        piece, step, place = np.empty(counts.sum(), np.int32), np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
        for source, found, length in reversed(fitting):
            spot = free[source]
            piece[spot], step[spot], place[spot] = found, length, source
            free[source] += 1
        # sums over what follows, from the words' ends on; there is a node per symbol and one at each word's end
        node = np.arange(n) + owner
        log, target = vocabulary.weight[piece], node[place] + step
        share, behind = np.empty(len(log)), np.zeros(n + len(words))
        bounds = np.searchsorted(left[by_depth], np.arange(1, left.max(initial=0) + 2)).tolist()
        starts = np.append(begin, len(log))
        for a, b in zip(bounds[:-1], bounds[1:]):
            ea, eb = int(starts[a]), int(starts[b])
            if b - a < FEW:
                for row in range(a, b):
                    self._alone(log, share, target, behind, int(starts[row]), int(starts[row + 1]), int(node[by_depth[row]]))
                continue
            v = log[ea:eb] + behind[target[ea:eb]]
            cut, runs = begin[a:b] - ea, spread_counts[a:b]
            top = np.maximum.reduceat(v, cut)
            e = np.exp(v - np.repeat(top, runs))
            total = np.add.reduceat(e, cut)
            behind[node[by_depth[a:b]]] = sums = top + np.log(total)
            share[ea:eb] = e / np.repeat(total, runs)
            log[ea:eb] = v - np.repeat(sums, runs)
        # back to the order of the places
        order = _ranges(low, counts)
        upto, last = share[order], np.cumsum(counts)
        at = last - counts
        for k in range(1, int(counts.max(initial=0))):
            at = at[counts[counts >= k] > k] if k > 1 else at[counts > 1]
            upto[at + k] += upto[at + k - 1]
        upto[last - 1] = 2.0  # above any draw
        per_node = np.zeros(n + len(words), np.int64)
        per_node[node] = counts
        return (
            np.concatenate([[0], ends + np.arange(1, len(words) + 1)]), np.concatenate([[0], np.cumsum(per_node)]), np.repeat(node, counts),
            piece[order], step[order].astype(np.uint8), upto, np.rint(log[order] * FINE) / FINE,
        )

    def _alone(self, log: np.ndarray, share: np.ndarray, target: np.ndarray, behind: np.ndarray, a: int, b: int, node: int) -> None:
        """One place of a long word, by the same steps as many at once."""
        v = log[a:b] + behind[target[a:b]]
        top = v.max()
        e = np.exp(v - top)
        total = np.add.reduceat(e, [0])[0]
        behind[node] = sums = top + np.log(total)
        share[a:b], log[a:b] = e / total, v - sums

    def _bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece give way to symbols for their bytes."""
        odd = ~self.vocabulary.single[symbols]
        if not odd.any():
            return symbols, owner
        sizes = np.where(odd, 1 + (symbols > 0x7F) + (symbols > 0x7FF) + (symbols > 0xFFFF), 1)
        out = np.repeat(symbols, sizes)
        data = np.frombuffer(symbols[odd].tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(odd, sizes)] = data + np.uint32(BYTES_FROM)
        return out, np.repeat(owner, sizes)

    def sample(self, nodes: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its word's end: how many edges, and all edges in order.

        Each edge is drawn with its probability given the place; the draws follow from the stream alone.
        """
        rows, counts, taken = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
        open_ = self.first[nodes + 1] > self.first[nodes]
        rows, nodes = rows[open_], nodes[open_].copy()
        turn = 0
        while len(rows) >= FEW:
            u = draw(streams[rows], turn)
            edge = self.first[nodes]
            wait = np.flatnonzero(u >= self.upto[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] >= self.upto[edge[wait]]]
            taken.append((rows, edge))
            counts[rows] += 1
            nodes = nodes + self.step[edge]
            open_ = self.first[nodes + 1] > self.first[nodes]
            rows, nodes, turn = rows[open_], nodes[open_], turn + 1
        tails = [self._walk(int(node), streams[row], turn) for row, node in zip(rows, nodes)]
        counts[rows] += np.array([len(t) for t in tails], np.int64)
        begins = np.cumsum(counts) - counts
        edges = np.empty(counts.sum(), np.int64)
        for k, (some, edge) in enumerate(taken):
            edges[begins[some] + k] = edge
        for row, tail in zip(rows.tolist(), tails):
            edges[begins[row] + turn : begins[row] + counts[row]] = tail
        return counts, edges

    def _walk(self, node: int, stream: np.uint64, turn: int) -> list[int]:
        """The same for one word, for the long ones that are left when the others have ended."""
        first, upto, step, out = memoryview(self.first), memoryview(self.upto), memoryview(self.step), []
        draws: list[float] = []
        while first[node + 1] > first[node]:
            if not draws:
                draws = draw(stream, np.arange(turn, turn + 256))[::-1].tolist()
                turn += 256
            u, edge = draws.pop(), first[node]
            while u >= upto[edge]:
                edge += 1
            out.append(edge)
            node += step[edge]
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def split_words(text: str) -> list[str]:
    """Parts that no piece reaches across: before a space that follows other characters, around line ends."""
    return WORDS.findall(SPACE + text.replace(" ", SPACE))


def split_group(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the place of each word among them, and how many words each text has."""
    given = pa.array(texts, pa.string())
    spaced = pc.if_else(pc.equal(given, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(given, " ", SPACE), ""))
    # no plain space is left, so it can mark the cuts; several spaces in a row stay together
    runs = pc.match_substring(spaced, SPACE * 2).to_numpy(zero_copy_only=False)
    cut = pc.replace_substring(pc.replace_substring(spaced, SPACE, " " + SPACE), "\n", " \n ")
    split = pc.split_pattern(cut, " ")
    if runs.any():
        apart = pa.array([split_words(texts[j]) for j in np.flatnonzero(runs)], split.type)
        place = np.where(runs, (~runs).sum() + np.cumsum(runs) - 1, np.cumsum(~runs) - 1)
        split = pa.concat_arrays([split.filter(pa.array(~runs)), apart]).take(pa.array(place))
    flat, many = split.flatten(), np.asarray(split.value_lengths())
    filled = pc.not_equal(flat, "")
    coded = flat.filter(filled).dictionary_encode()
    sizes = np.bincount(np.repeat(np.arange(len(texts)), many)[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices), sizes


class Paths:
    """One segmentation of each of some texts: flat edges with the word of each, and log-probabilities."""

    def __init__(self, lattices: Lattices, texts: np.ndarray, edges: np.ndarray, words: np.ndarray, counts: np.ndarray):
        self.texts, self.edges, self.words, self.counts = texts, edges, words, counts
        self.begins = np.cumsum(counts) - counts
        # whole numbers, so that a sum does not depend on what stands before it in the group
        sums = np.concatenate([[0], np.cumsum((lattices.log[edges] * FINE).astype(np.int64))])
        self.before = (sums[:-1] - np.repeat(sums[self.begins], counts)) / FINE
        self.total = (sums[self.begins + counts] - sums[self.begins]) / FINE


def top_segmentations(lattices: Lattices, flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, k: int):
    """Per text, given its word numbers, up to k segmentations: lists over the rounds of (texts, values, Paths), and each text's (k+1)-th value."""
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(starts, sizes)

    # waiting sets: value, path (round), place in the path, edge (-1: all that leave the path from there on)
    waiting: list[list[tuple[float, int, int, int]]] = [[] for _ in range(n)]
    rounds: list[tuple[np.ndarray, np.ndarray, Paths]] = []
    where = np.full((k, n), -1)
    extra = np.zeros(n, np.uint64)

    def draws(texts: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Gumbel numbers for the search itself, numbered per text."""
        rows = np.repeat(np.arange(len(texts)), repeats)
        number = np.arange(len(rows)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        u = uniform(keys[texts][rows] ^ np.uint64(0x5851F42D4C957F2D), extra[texts][rows] + number.astype(np.uint64))
        extra[texts] += repeats.astype(np.uint64)
        return gumbel(u)

    def look(paths: Paths, rows: np.ndarray, at: np.ndarray, value: np.ndarray, turn: int, reached: bool) -> None:
        """Alternatives of the paths' places from ``at`` on.

        reached: their highest number is ``value``; else they only stay below it.
        """
        texts = paths.texts[rows]
        ahead = np.minimum(AHEAD, paths.counts[rows] - at)
        row = np.repeat(np.arange(len(rows)), ahead)
        spot = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        flat_at = paths.begins[rows][row] + spot
        node = lattices.source[paths.edges[flat_at]]
        low, many = lattices.first[node], lattices.first[node + 1] - lattices.first[node]
        which = np.repeat(np.arange(len(row)), many)
        edge = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        other = edge != paths.edges[flat_at][which]
        which, edge = which[other], edge[other]
        location = paths.before[flat_at][which] + lattices.log[edge]
        # one set more per row: what leaves the path later
        stop = at + ahead
        later = stop < paths.counts[rows]
        rest = paths.before[np.minimum(paths.begins[rows] + stop, max(len(paths.before) - 1, 0))][later] if later.any() else np.zeros(0)
        gap = paths.total[rows][later] - rest
        mass = rest + np.log1p(-np.exp(np.minimum(gap, -1e-12)))
        member = np.concatenate([row[which], np.flatnonzero(later)])
        location = np.concatenate([location, mass])
        spots = np.concatenate([spot[which], stop[later]])
        edges = np.concatenate([edge, np.full(later.sum(), -1)])
        order = np.argsort(member, kind="stable")
        member, location, spots, edges = member[order], location[order], spots[order], edges[order]
        per_row = np.bincount(member, minlength=len(rows))
        numbers = location + draws(texts, per_row)
        bound = value[member]
        if reached:
            filled = per_row > 0
            highest = np.full(len(rows), -np.inf)
            if len(numbers):
                highest[filled] = np.maximum.reduceat(numbers, (np.cumsum(per_row) - per_row)[filled])
            gap = numbers - highest[member]
            with np.errstate(divide="ignore"):
                v = bound - numbers + np.where(gap < 0, np.log1p(-np.exp(np.minimum(gap, -1e-300))), -np.inf)
            numbers = bound - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))
        else:
            numbers = -np.logaddexp(-bound, -numbers)
        # more than k + 1 sets of a text are never opened
        text_of = texts[member].tolist()
        for t, x, s, e in zip(text_of, numbers.tolist(), spots.tolist(), edges.tolist()):
            waiting[t].append((x, turn, s, e))
        for t in set(text_of):
            if len(waiting[t]) > k + 1:
                waiting[t].sort(reverse=True)
                del waiting[t][k + 1 :]

    counts, edges = lattices.sample(lattices.entry[flat], word_streams(keys[owner], place, np.zeros(1)))
    per_text = np.zeros(n, np.int64)
    np.add.at(per_text, owner, counts)
    everyone = np.arange(n)
    value = gumbel(uniform(keys, np.full(n, (1 << 63) + 1, np.uint64)))
    paths = Paths(lattices, everyone, edges, np.repeat(place, counts), per_text)
    rounds.append((everyone, value, paths))
    where[0] = everyone
    look(paths, everyone, np.zeros(n, np.int64), value, 0, False)
    done = np.ones(n, np.int64)

    while True:
        ready, opened = [], []
        for t in np.flatnonzero(done < k).tolist():
            if waiting[t]:
                best = max(range(len(waiting[t])), key=lambda j: waiting[t][j][0])
                item = waiting[t].pop(best)
                (opened if item[3] < 0 else ready).append((t, *item))
            else:
                done[t] = k  # no other segmentation
        if not ready and not opened:
            break
        for turn in sorted({x[2] for x in opened}):
            some = [x for x in opened if x[2] == turn]
            rows = where[turn][[x[0] for x in some]]
            look(rounds[turn][2], rows, np.array([x[3] for x in some]), np.array([x[1] for x in some]), turn, True)
        if ready:
            texts, value, number = np.array([x[0] for x in ready]), np.array([x[1] for x in ready]), len(rounds)
            heads, head_words, joints = [], [], np.empty(len(ready), np.int64)
            for j, (t, _, turn, spot, edge) in enumerate(ready):
                old = rounds[turn][2]
                begin = old.begins[where[turn][t]]
                heads.append(np.append(old.edges[begin : begin + spot], edge))
                head_words.append(old.words[begin : begin + spot + 1])
                joints[j] = old.words[begin + spot]
            remaining = sizes[texts] - joints
            row = np.repeat(np.arange(len(texts)), remaining)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(remaining) - remaining, remaining)
            word = joints[row] + inside
            node = lattices.entry[flat[starts[texts][row] + word]]
            branch = np.array([x[4] for x in ready])
            node[inside == 0] = lattices.source[branch] + lattices.step[branch].astype(np.int64)
            tail_counts, tails = lattices.sample(node, word_streams(keys[texts][row], word, done[texts][row]))
            tail_words = np.repeat(word, tail_counts)
            per = np.zeros(len(texts), np.int64)
            np.add.at(per, row, tail_counts)
            cuts = np.cumsum(per)[:-1]
            edges = [x for pair in zip(heads, np.split(tails, cuts)) for x in pair]
            words_ = [x for pair in zip(head_words, np.split(tail_words, cuts)) for x in pair]
            paths = Paths(lattices, texts, np.concatenate(edges), np.concatenate(words_), per + np.array([len(h) for h in heads]))
            if number >= len(where):
                where = np.vstack([where, np.full((len(where), n), -1)])
            where[number][texts] = np.arange(len(texts))
            rounds.append((texts, value, paths))
            look(paths, np.arange(len(texts)), np.array([len(h) for h in heads]), value, number, False)
            done[texts] += 1
    kappa = np.array([max((x[0] for x in w), default=-np.inf) for w in waiting])
    return rounds, kappa


@lru_cache(maxsize=1)
def vocabulary_of(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


@lru_cache(maxsize=1)
def lattices_of(path: str, alpha: float) -> Lattices:
    """Stay in the worker for its next tasks; their memory has a bound."""
    return Lattices(vocabulary_of(path, alpha))


def encode_group(lattices: Lattices, texts: list[str | None], keys: np.ndarray, k: int, check: bool) -> pa.Array:
    """The samples of each text as an Arrow list; null for null."""
    rows = [j for j, t in enumerate(texts) if t is not None]
    words, place, sizes = split_group([texts[j] for j in rows])
    rounds, kappa = top_segmentations(lattices, lattices.numbers(words)[place], sizes, keys[rows], k)
    owner = np.concatenate([r[0] for r in rounds])
    values = np.concatenate([r[1] for r in rounds])
    totals = np.concatenate([r[2].total for r in rounds])
    counts = np.concatenate([r[2].counts for r in rounds])
    edges = np.concatenate([r[2].edges for r in rounds])
    begins = np.cumsum(counts) - counts
    order = np.lexsort((-values, owner))
    owner, values, totals = owner[order], values[order], totals[order]
    sizes = counts[order]
    pick = np.repeat(begins[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    ids = lattices.piece[edges[pick]]
    per_text = np.bincount(owner, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + 1
    with np.errstate(over="ignore"):
        inclusion = -np.expm1(-np.exp(totals - kappa[owner]))
    exact = np.zeros(len(owner), bool)
    if check:
        plain = [texts[j].replace(SPACE, " ").encode() for j in rows]
        for j, data in enumerate(lattices.vocabulary.decode(ids, np.cumsum(sizes))):
            exact[j] = data == plain[owner[j]]
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids.astype(np.int32)))
    struct = pa.StructArray.from_arrays(
        [pa.array(rank.astype(np.int32)), lists, pa.array(totals), pa.array(values), pa.array(inclusion), pa.array(exact) if check else pa.nulls(len(owner), pa.bool_())],
        names=["rank", "ids", "log_prob", "perturbed", "inclusion", "exact"],
    )
    all_counts = np.zeros(len(texts), np.int64)
    all_counts[rows] = per_text
    offsets = pa.array(np.concatenate([[0], np.cumsum(all_counts)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
    return pa.ListArray.from_arrays(offsets, struct)


def sample_segmentations(
    df: DataFrame, model_path: str, k: int = 2, key: str = "doc_id", keep: Sequence[str] = ("doc_id",), text: str = "text",
    seed: int = 1, alpha: float = 1.0, check: bool = True, group_bytes: int = 1 << 19,
) -> DataFrame:
    """``keep`` with ``samples``: up to k distinct segmentations per row, highest perturbed value first.

    Each sample: rank, ids, log_prob (of the segmentation), perturbed (its Gumbel number), inclusion
    (probability that a segmentation as likely comes above the (k+1)-th number; 1 where there are no
    more), exact (decoding the ids gives the text back; the character U+2581 counts as a space).  The
    numbers follow from ``seed``, the key and the text alone, so repeated rows have equal samples.

    A null text has null samples, an empty one the empty segmentation.  Fewer than k segmentations
    give fewer samples.  A null key is a key like others.  A kept column named samples gives way.
    """
    keep = [c for c in keep if c != "samples"]
    source = df.select(*keep, F.xxhash64(F.lit(seed), key).alias("__key"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *T.StructType.fromDDL(SAMPLES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path, alpha)
        for batch in batches:
            for part in byte_groups(batch, len(keep) + 1, group_bytes):
                keys = np.asarray(part.column(len(keep))).view(np.uint64)
                found = encode_group(lattices, part.column(len(keep) + 1).to_pylist(), keys, k, check)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), alpha: float = 1.0) -> DataFrame:
    """``keep`` with ``decoded``: the text of the ids; null for null ids, bytes that are no UTF-8 replaced."""
    keep = [c for c in keep if c != "decoded"]
    source = df.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model_path, alpha)
        for batch in batches:
            lists = batch.column(len(keep))
            flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths().fill_null(0))
            texts = vocabulary.decode(flat, np.cumsum(sizes))
            decoded = [t.decode(errors="replace") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
