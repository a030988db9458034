"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a .model file into integer arrays:

* the normaliser: a space and U+2581 read as one symbol, the leading one is added; for a model that
  removes extra white space, runs become one and those at the ends go;
* the pieces: a trie over symbols whose final nodes are weighted arcs. A unigram model's arc weighs
  its negative score. For a BPE model states remember the last piece, an arc weighs one, and it
  leaves a state only if the two pieces are *compatible*: undoing their merges, the latest first,
  shows no merge across their border that would have come earlier. Which two pieces a piece was
  merged from is compiled likewise, in order of rank. A sequence is what merging by rank produces
  if and only if all its neighbours are compatible, so the path through the composition is unique;
* byte fallback: a symbol that is no piece passes by an arc that writes its UTF-8 bytes.

An input is composed with them into a lattice over its symbols, and the tropical-semiring shortest
path is found by relaxing all arcs in order of their ends. Where no piece holds two neighbouring
symbols side by side every path passes between them, so lattices are cut there: the units between
cuts are told apart exactly (Arrow's dictionary), and the distinct ones are relaxed together, arrays
over all of them at a time; units above LONG symbols one by one. A task remembers units.

Model types 1 (unigram) and 2 (BPE) are accepted, with user-defined and unused pieces; character
maps of the normaliser, white space as a suffix, word and character models raise. Defined results:
null text gives null ids and null text; empty text gives no ids; texts of any length are done
whole. U+2581 in a text decodes as a space, as in the library.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import prepare, table

MODEL = os.path.join(os.environ.get("LUMENMILL_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
MEMO = 400_000
LONG = 40
#: Bytes of text and keys of a table that are worked on at once: a byte of text takes some 60 of arrays.
BLOCK_BYTES = 1 << 20
SLICE = 1 << 16
SPACE = "▁"
_FAR = 1 << 30


def _fields(data: bytes):
    """(number, value) of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Table:
    """A map from int64 keys (not negative) to int32 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            mine = self.keys[at[left]] == keys[left]
            self.values[at[left[mine]]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        if len(keys) > SLICE:
            return np.concatenate([self.get(keys[i : i + SLICE]) for i in range(0, len(keys), SLICE)])
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        on = np.flatnonzero((there != keys) & (there != -1))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there != -1)]
        return out


class Transducer:
    """A compiled model; encode(text) -> ids and decode(ids) -> text."""

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2) or normaliser.get(2) or trainer.get(24) or not normaliser.get(5, 1):
            raise ValueError("only unigram and BPE models without a character map or white space as suffix are supported")
        self.bpe, self.prefix, self.tidy = kind == 2, bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.size, self.unk = len(pieces), next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte_ids = np.full(256, self.unk, np.int32)
        written = [b""] * self.size
        for i, (text, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(text[3:5], 16)] = i
                written[i] = bytes([int(text[3:5], 16)])
            elif kind == 2:
                written[i] = " ⁇ ".encode()
            elif kind != 3:
                written[i] = text.replace(SPACE, " ").encode()
        self.fallback = any(p[2] == 6 for p in pieces)
        self._written(written)
        self.forced = {p[0]: i for i, p in enumerate(pieces) if p[2] == 4} if self.bpe else {}
        self._finds = re.compile("|".join(map(re.escape, sorted(self.forced, key=len, reverse=True)))) if self.forced else None
        arcs = {text: (i, score, kind) for i, (text, score, kind) in enumerate(pieces) if kind in ((1, 5) if self.bpe else (1, 4))}
        self._compile(arcs)

    def _written(self, written: list[bytes]) -> None:
        self.out_at = np.concatenate([[0], np.cumsum([len(w) for w in written])])
        self.out = np.frombuffer(b"".join(written), np.uint8)

    def _compile(self, arcs: dict[str, tuple[int, float, int]]) -> None:
        """The trie, the pairs of symbols that pieces hold, and weights or merges."""
        symbols = {SPACE: 1}
        for text in arcs:
            for char in text:
                symbols.setdefault(char, len(symbols) + 1)
        self.points = np.array([ord(c) for c in symbols], np.int64)
        self.n = len(symbols) + 1
        # Arcs of single symbols come first, also of those that are no piece; the last stands for any other symbol.
        index = {c: arcs[c][0] if c in arcs else self.size + i for i, c in enumerate(symbols)}
        self.other = self.size + len(symbols)
        nodes, ends, keys, pairs = 1, {}, {}, set()
        for text, (i, *_) in arcs.items():
            index[text], at, before = i, 0, 0
            for char in text:
                s = symbols[char]
                if at:
                    pairs.add(before * self.n + s)
                before = s
                if (go := keys.get(at * self.n + s)) is None:
                    go = keys[at * self.n + s] = nodes
                    nodes += 1
                at = go
            ends[at] = i
        for char, s in symbols.items():
            if s not in keys:  # the root's keys are the symbols
                keys[s] = nodes
                nodes += 1
            ends.setdefault(keys[s], index[char])
        self.deepest = max(map(len, arcs), default=1)
        self.trie = Table(np.array(list(keys), np.int64), np.array(list(keys.values()), np.int32))
        self.final = np.full(nodes, -1, np.int32)
        self.final[np.array(list(ends), np.int64)] = np.array(list(ends.values()), np.int32)
        self.pairs = Table(np.array(sorted(pairs), np.int64), np.ones(len(pairs), np.int32))
        self.weight = np.ones(self.other + 1, np.float32)
        if self.bpe:
            self._merges(arcs, index)
        else:
            normal = [score for _, score, kind in arcs.values() if kind == 1] or [0.0]
            self.weight[:] = 10 - np.float32(min(normal))  # the library's penalty below the worst piece
            for text, (i, score, kind) in arcs.items():
                self.weight[i] = 0.1 - len(text.encode()) * max(0.0, max(normal)) if kind == 4 else -np.float32(score)
        self._plain = None

    def _merges(self, arcs: dict[str, tuple[int, float, int]], index: dict[str, int]) -> None:
        """Each piece's rank and the two it is merged from; pieces that merging can't reach lose
        their arcs."""
        ranks = {s: r for r, s in enumerate(sorted({a[1] for t, a in arcs.items() if len(t) > 1}, reverse=True))}
        rank, left, right, joins = [-1] * (self.other + 1), [0] * (self.other + 1), [0] * (self.other + 1), {}
        reached = {t for t in index if len(t) == 1}
        for text, (i, score, _) in sorted(((t, a) for t, a in arcs.items() if len(t) > 1), key=lambda x: (-x[1][1], len(x[0]))):
            r = ranks[score]
            halves = [(index[text[:k]], index[text[k:]]) for k in range(1, len(text)) if text[:k] in reached and text[k:] in reached]
            found = next((h for h in halves if _compatible(*h, r, rank, left, right, joins, self.n_arcs)), None)
            for a, b in halves:
                joins[a * self.n_arcs + b] = r
            if found:
                reached.add(text)
                rank[i], (left[i], right[i]) = r, found
        lost = [a[0] for t, a in arcs.items() if len(t) > 1 and t not in reached]
        self.final[np.isin(self.final, lost)] = -1
        self.rank, self.left, self.right = (np.array(x, np.int32) for x in (rank, left, right))
        # joins may name pieces as neighbours whose own halves came later: all pairs, once all are known
        for text, (_, score, _) in arcs.items():
            for k in range(1, len(text)):
                if text[:k] in reached and text[k:] in reached:
                    joins[index[text[:k]] * self.n_arcs + index[text[k:]]] = ranks[score]
        self.joins = Table(np.array(list(joins), np.int64), np.array(list(joins.values()), np.int32))
        self.parts = {}  # unused pieces are written as what they were merged from
        unused = {a[0] for a in arcs.values() if a[2] == 5}
        for i in unused:
            todo, done = [i], []
            while todo:
                p = todo.pop()
                if p in unused and rank[p] >= 0:
                    todo += [right[p], left[p]]
                else:
                    done.append(p)
            self.parts[i] = done

    @property
    def n_arcs(self) -> int:
        return self.other + 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays what _compatible is for two pieces; a of -1 is the start."""
        fine = np.ones(len(a), bool)
        on = np.flatnonzero(a >= 0)
        a, b, limit = a[on], b[on], np.full(len(on), _FAR, np.int32)
        while len(on):
            joined = self.joins.get(a.astype(np.int64) * self.n_arcs + b)
            bad = (joined >= 0) & (joined < limit)
            fine[on[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            on, a, b, ra, rb = on[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine

    # Composition and shortest path

    def _arcs(self, symbols: np.ndarray, end_of: np.ndarray):
        """(start, end, arc) of the lattice: every way through the trie from every place. end_of:
        where the unit of each place ends."""
        at = np.arange(len(symbols))
        node = np.where(symbols > 0, self.trie.get(symbols.astype(np.int64)), 0)
        out = [(at[symbols == 0], at[symbols == 0] + 1, np.full((symbols == 0).sum(), self.other, np.int32))]
        at, node = at[symbols > 0], node[symbols > 0]
        for depth in range(1, self.deepest + 1):
            found = self.final[node]
            hit = found >= 0
            out.append((at[hit], at[hit] + depth, found[hit]))
            on = at + depth < end_of[at]
            at, node = at[on], node[on]
            node = self.trie.get(node.astype(np.int64) * self.n + symbols[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def paths(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit (n + 1 firsts) its shortest path: arcs of all units, and where they end.
        Ends are places before which a unit has been read."""
        sizes = np.diff(firsts)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        start, end, arc = self._arcs(symbols, firsts[1:][unit])
        local = end - firsts[:-1][unit[start]]
        # a unit of s symbols has s + 1 states
        start, end = start + unit[start], end + unit[start]
        order = np.argsort(local, kind="stable")
        start, end, arc, local = start[order], end[order], arc[order], local[order]
        states = len(symbols) + len(sizes)
        cost, last, back = np.full(states, np.inf, np.float32), np.full(states, -1, np.int32), np.full(states, -1, np.int64)
        cost[firsts[:-1] + np.arange(len(sizes))] = 0
        cuts = np.searchsorted(local, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, p = start[a:b], end[a:b], arc[a:b]
            fine = cost[s] < np.inf
            if self.bpe:
                fine[fine] = self.compatible(last[s[fine]], p[fine])
            s, e, p = s[fine], e[fine], p[fine]
            length = cost[s] + self.weight[p]
            best = np.lexsort((-s, -length, e))  # of equal ones the last written stays: the least length, the earliest start
            e = e[best]
            cost[e], last[e], back[e] = length[best], p[best], s[best]
        on_path, now = np.zeros(states, bool), firsts[1:] + np.arange(len(sizes))
        now = now[sizes > 0]
        while len(now):
            on_path[now] = True
            now = back[now]
            now = now[back[now] >= 0]
        ends = np.flatnonzero(on_path)
        owner = np.searchsorted(firsts[1:] + np.arange(len(sizes)), ends)
        return last[ends], ends - owner

    def _one(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same for one unit of any length, place by place."""
        if self._plain is None:
            merges = [x.tolist() for x in (self.rank, self.left, self.right)] if self.bpe else None
            there = [dict(zip(t.keys[t.keys >= 0].tolist(), t.values[t.keys >= 0].tolist(), strict=True)) for t in (self.trie, *([self.joins] if self.bpe else []))]
            self._plain = there, self.final.tolist(), self.weight, merges
        there, final, weight, merges = self._plain
        n, trie = len(symbols), there[0]
        cost, last, back = [np.float32(np.inf)] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        cost[0] = np.float32(0)
        for at in range(n):
            if back[at] < 0 and at:
                continue
            node, k = 0, at
            ways = []
            while k < n and symbols[k] and (node := trie.get(node * self.n + symbols[k], -1)) >= 0:
                k += 1
                if final[node] >= 0:
                    ways.append((k, final[node]))
            for end, arc in ways if symbols[at] else [(at + 1, self.other)]:
                length = cost[at] + weight[arc]
                if length < cost[end] and (not self.bpe or last[at] < 0 or _compatible(last[at], arc, _FAR, *merges, there[1], self.n_arcs)):
                    cost[end], last[end], back[end] = length, arc, at
        out, ends, at = [], [], n
        while at > 0:
            out.append(last[at])
            ends.append(at)
            at = back[at]
        return out[::-1], ends[::-1]

    def ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units (binary, normalised), and where each unit's begin (n + 1)."""
        text = units.cast(pa.large_string())
        sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
        symbols, firsts = self.symbols(points), np.concatenate([[0], np.cumsum(sizes)])
        known = np.array([self.forced.get(u.replace(" ", SPACE), -1) for u in text.to_pylist()], np.int32) if self.forced else np.full(len(sizes), -1, np.int32)
        short = (sizes <= LONG) & (known < 0)
        place = np.repeat(short, sizes)
        arcs, ends = self.paths(symbols[place], np.concatenate([[0], np.cumsum(sizes[short])]))
        ends = np.flatnonzero(place)[ends - 1] + 1  # the unit's last symbol read
        some = [(arcs, ends)]
        for i in np.flatnonzero(~short):
            if known[i] >= 0:
                some.append((np.array([known[i]], np.int32), firsts[i + 1 : i + 2]))
            elif sizes[i]:
                arcs, ends = self._one(symbols[firsts[i] : firsts[i + 1]].tolist())
                some.append((np.array(arcs, np.int32), np.array(ends) + firsts[i]))
        arcs, ends = map(np.concatenate, zip(*some, strict=True))
        order = np.argsort(ends, kind="stable")
        arcs, ends = arcs[order], ends[order]
        owner = np.searchsorted(firsts, ends, side="left") - 1
        return self._emit(arcs, points[ends - 1], owner, len(sizes))

    def _emit(self, arcs: np.ndarray, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What arcs write: their id, the bytes of a symbol that is no piece, the parts of an
        unused piece."""
        if self.bpe and self.parts:
            wide = [self.parts.get(a, [a]) for a in arcs.tolist()]
            count = np.array([len(w) for w in wide])
            arcs, points, owner = np.array([p for w in wide for p in w], np.int32), np.repeat(points, count), np.repeat(owner, count)
        loose = arcs >= self.size
        if self.fallback:
            count = np.where(loose, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        else:
            arcs = np.where(loose, self.unk, arcs)
            loose, count = np.zeros(len(arcs), bool), np.ones(len(arcs), np.int64)
        out = np.repeat(arcs, count)
        if loose.any():
            at = np.cumsum(count) - count
            for size in (1, 2, 3, 4):
                some = np.flatnonzero(loose & (count == size))
                for k in range(size):
                    lead = (0, 0, 0xC0, 0xE0, 0xF0)[size] if k == 0 else 0x80
                    bits = points[some].astype(np.int64) >> (6 * (size - 1 - k))
                    out[at[some] + k] = self.byte_ids[lead | (bits & (0x7F if size == 1 else 0x3F))]
        return out, np.concatenate([[0], np.cumsum(np.bincount(owner, count, n).astype(np.int64))])

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Code points as the transducer's symbols; 0 for those in no piece."""
        if not hasattr(self, "_symbol"):
            self._symbol = np.zeros(0x110000, np.int32)
            self._symbol[self.points] = np.arange(1, len(self.points) + 1)
            self._symbol[ord(" ")] = 1
        return self._symbol[points]

    def normalise(self, texts: pa.Array) -> pa.Array:
        """The normaliser's output, U+2581 written as a space."""
        if self.tidy:
            texts = pc.utf8_ltrim(pc.replace_substring_regex(texts, " +", " "), " ")
        texts = pc.replace_substring(texts, SPACE, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        if self.tidy:
            texts = pc.utf8_rtrim(texts, " ")
        return texts

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units of the texts, one after another, and where each text's begin (n + 1)."""
        data, offsets = textkit.text_buffer(texts)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        symbols = self.symbols(points)
        cut = np.ones(len(points), bool)
        for i in range(1, len(points), SLICE):
            there = symbols[i - 1 : i + SLICE].astype(np.int64)
            cut[i : i + SLICE] = self.pairs.get(there[:-1] * self.n + there[1:]) < 0
        places = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        cut[np.searchsorted(places, offsets[offsets < len(data)])] = True
        if self._finds:
            first = np.searchsorted(places, offsets)
            for i, text in enumerate(texts.to_pylist()):
                for m in self._finds.finditer(text.replace(" ", SPACE)):
                    cut[first[i] + m.start()] = True
                    if first[i] + m.end() < len(cut):
                        cut[first[i] + m.end()] = True
                    cut[first[i] + m.start() + 1 : first[i] + m.end()] = False
        at = np.concatenate([places[:-1][cut], [len(data)]])
        if len(data) < 1 << 31:
            units = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        else:
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
        return units, np.searchsorted(at[:-1], offsets)

    def encode_all(self, texts: pa.Array, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large strings without nulls) and where each text's begin (n + 1)."""
        memo = memo or Memo(self)
        units, firsts = self.units(self.normalise(texts))
        coded = units.dictionary_encode()
        start, size = memo.find(coded.dictionary)
        which = coded.indices.to_numpy()
        start, size = start[which], size[which]
        ends = np.cumsum(size)
        flat = memo.store[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        of = np.concatenate([[0], ends])[firsts]
        if not self.fallback and len(flat):  # the library writes a run of unknown symbols once
            again = np.concatenate([[False], (flat[1:] == self.unk) & (flat[:-1] == self.unk)])
            again[of[:-1][of[:-1] < len(flat)]] = False
            of = of - np.concatenate([[0], np.cumsum(again)])[of]
            flat = flat[~again]
        return flat, of

    def decode_all(self, flat: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each text's begin (n + 1)."""
        start, size = self.out_at[flat], np.diff(self.out_at)[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.out[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        of = ends[firsts]
        if self.prefix and len(data):
            lead = of[:-1][np.diff(of) > 0]
            gone = np.zeros(len(data), bool)
            gone[lead[data[lead] == 0x20]] = True
            data, of = data[~gone], of - np.concatenate([[0], np.cumsum(gone)])[of]
        return data, of

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes().decode(errors="replace")


def _compatible(a: int, b: int, limit: int, rank, left, right, joins: dict, n: int) -> bool:
    """Whether merging by rank leaves a and b as neighbours, looking at merges below limit. The
    merges inside them are undone, the latest first (of equal ranks the right one): one across
    their border that ranks before those still undone would have come first."""
    while True:
        if joins.get(a * n + b, _FAR) < limit:
            return False
        if rank[a] > rank[b]:
            limit, a = rank[a], right[a]
        elif rank[b] >= 0:
            limit, b = rank[b] + 1, left[b]
        else:
            return True


class Memo:
    """A task's known units; emptied when full."""

    def __init__(self, fst: Transducer):
        self.fst, self.known = fst, {}
        self.store, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def find(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of each unit begin, and how many they are."""
        if len(self.known) > MEMO:
            self.__init__(self.fst)
        names = units.to_pylist()
        got = [self.known.get(u, -1) for u in names]
        new = [i for i, k in enumerate(got) if k < 0]
        if new:
            flat, firsts = self.fst.ids(units.take(pa.array(new)))
            for k, i in enumerate(new, len(self.known)):
                self.known[names[i]] = got[i] = k
            self.starts = np.concatenate([self.starts, firsts[1:] + len(self.store)])
            self.store = np.concatenate([self.store, flat])
        got = np.array(got, np.int64)
        return self.starts[got], self.starts[got + 1] - self.starts[got]


def load(path: str = MODEL) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def _encoder(fst: Transducer):
    def run(batches):
        memo = Memo(fst)
        for whole in batches:
            for batch in textkit.blocks(whole, "text", BLOCK_BYTES):
                column = batch.column("text").cast(pa.large_string())
                nulls = column.is_null().to_numpy(zero_copy_only=False)
                texts = column.fill_null("")
                flat, of = fst.encode_all(texts, memo)
                back, at = fst.decode_all(flat, of)
                data, offsets = textkit.text_buffer(texts)
                same = np.diff(at) == np.diff(offsets)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    same = np.array([s and (back[a:b] == data[c:d]).all() for s, a, b, c, d in zip(same, at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)], bool)
                ids = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(flat), mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(np.diff(of), mask=nulls), pa.array(same, mask=nulls)], ["id", "ids", "n_pieces", "round_trip"])

    return run


def _decoder(fst: Transducer):
    def run(batches):
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: the id, ids, n_pieces, round_trip (decoding gives the text)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(_encoder(load(model)), "id long, ids array<int>, n_pieces long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: the id and text."""
    source = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(_decoder(load(model)), "id long, text string").withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
