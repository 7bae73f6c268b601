"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

Encoding gives the ids of the SentencePiece library for files of both common kinds. For a unigram file that is the
segmentation of highest total score. A BPE file merges the best pair of neighbours again and again instead, which no
scores of single pieces can express as a best path; so the lattice of a text holds, for such a file, only the pieces
that its merges leave, and its best path is the file's own segmentation. Text is normalized the identity way: a space
becomes ``▁``, one ``▁`` goes in front; files that ask for another normalization, or hold user-defined or unused pieces,
are refused. A character that no piece covers becomes its UTF-8 byte pieces (or the unknown id if the model has none).

A document longer than ``CHUNK`` characters is cut into chunks. The state at a chunk's edge is the number of
characters by which a piece hangs over it. Each chunk gives a matrix of best scores from entry to exit state, in
the max-plus algebra; products of these are associative, so they are formed over groups of ``FAN`` chunks, then
groups of groups, until one group is left. Solving that fixes the states at its edges, which fixes those inside each group
below, down to the chunks, and every chunk is then backtraced alone.

No piece spans the place where a run of ``▁`` begins after another character, nor the place beside a control character,
so a text falls into short units; a cache bounded in bytes keeps the ids of units seen before. Merges depend on the whole
unit. So the chunks of a BPE file carry the unit at each edge, and an edge inside a unit above ``LONG_UNIT`` characters
moves to the end of the unit.

Null text is kept as empty text and gives no ids. Ties between equally good unigram segmentations depend only on text and
chunk length. ``▁`` in a text decodes to a space; all else comes back as it was. Equal rows stay apart. An empty table
gives no rows. The row's other columns stay together in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema
from panelloom.session import checkpointed

CHUNK = 1 << 15
FAN = 64
#: Bytes of unit ids, keys and bookkeeping that a worker keeps.
CACHE_BYTES = 64 << 20
LONG_UNIT = 1 << 10
AT_ONCE = 8000
WINDOW = 1 << 20
_SPACE = "▁"
_UNK_PENALTY = 10.0
# Field numbers and kinds in a model file.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_TYPE_OF_PIECE, _TYPE_OF_MODEL, _CHARSMAP, _REMOVES_SPACES = 3, 3, 2, 4
_UNIGRAM, _BPE = 1, 2
_USER_DEFINED, _UNUSED = 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a message in protocol-buffer format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def model_kind(path: str) -> int:
    """Whether a model file is of the unigram or the BPE kind; a file that is encoded in other ways is refused."""
    with open(path, "rb") as file:
        fields = list(_fields(file.read()))
    kinds = {dict(_fields(piece)).get(_TYPE_OF_PIECE, 1) for number, piece in fields if number == _PIECE}
    specs = {number: dict(_fields(value)) for number, value in fields if number in (_TRAINER, _NORMALIZER)}
    kind, normalizer = specs.get(_TRAINER, {}).get(_TYPE_OF_MODEL, _UNIGRAM), specs.get(_NORMALIZER, {})
    if kind not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and BPE files are supported")
    if normalizer.get(_CHARSMAP) or normalizer.get(_REMOVES_SPACES, 1):
        raise ValueError("only files that normalize text the identity way are supported")
    if kinds & {_USER_DEFINED, _UNUSED}:
        raise ValueError("files with user-defined or unused pieces are not supported")
    return kind


class _Cache(dict):
    """What was made for keys seen before. When it passes a number of bytes, it starts afresh beside the ``older`` one, and
    what is not added again until the next time is forgotten."""

    def __init__(self, most: int):
        self.most, self.held, self.older = most // 2, 0, {}

    def add(self, made: dict[str, bytes]) -> None:
        self.update(made)
        self.held += 200 * len(made) + 4 * sum(map(len, made)) + sum(map(len, made.values()))
        if self.held > self.most:
            self.older = dict(self) if self.held <= 2 * self.most else {}
            self.clear()
            self.held = 0


class PieceModel:
    """The pieces and scores of a model file, with what encoding needs of them."""

    def __init__(self, path: str):
        import sentencepiece

        self.kind = model_kind(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte_ids)
        self.unk_id = sp.unk_id()
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = {sp.id_to_piece(i): (float(sp.get_score(i)), i) for i in normal}
        self.unk_score = min(s for s, _ in self.pieces.values()) - _UNK_PENALTY
        self.longest = max(map(len, self.pieces))
        # places that no piece spans
        long = {p for p in self.pieces if len(p) > 1}
        alone = "".join(c for c in map(chr, range(32)) if not any(c in p for p in long))
        spans = any(_SPACE in p.lstrip(_SPACE) for p in long)
        lone = re.escape(alone)
        self.units = re.compile(rf"[{lone}]|[^{lone}]+" if spans else rf"{_SPACE}*[^{lone}{_SPACE}]+|{_SPACE}+|[{lone}]")
        self.id_scores, self.id_chars = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        self.id_scores[self.unk_id], self.id_chars[self.unk_id] = self.unk_score, 1
        for b, i in enumerate(self.byte_ids if self.has_bytes else ()):  # an uncovered character counts once
            first = b & 0xC0 != 0x80
            self.id_scores[i], self.id_chars[i] = self.unk_score if first else 0.0, first
        for piece, (score, i) in self.pieces.items():
            self.id_scores[i], self.id_chars[i] = score, len(piece)
        if self.kind == _BPE:
            self._number_pairs()
        else:
            self._number_trie()
        self.unit_ids = _Cache(CACHE_BYTES)

    def _number_trie(self) -> None:
        """The pieces as a trie in arrays: node ``k + 1`` is reached by the ``k``-th edge, a pair of node and character."""
        edges: dict[int, int] = {}
        gains, ids = [-np.inf], [-1]
        for piece, (score, i) in self.pieces.items():
            node = 0
            for char in piece:
                node = edges.setdefault(node << 21 | ord(char), len(edges) + 1)
                if node == len(gains):
                    gains.append(-np.inf)
                    ids.append(-1)
            gains[node], ids[node] = score, i
        self.edge_of, self.edges = edges, pd.Index(np.fromiter(edges, np.int64, len(edges)))
        self.gains, self.node_ids = np.array(gains), np.array(ids, "<i4")

    def uncovered(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.has_bytes else [self.unk_id]

    # ---- BPE files

    def _number_pairs(self) -> None:
        """Neighbours that form a piece, as numbers: a symbol is the id of a piece or, beyond all ids, a character."""
        n = len(self.id_scores)
        self.symbol_of = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, (_, i) in self.pieces.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        pairs: dict[int, int] = {}

        def symbol(part: str) -> int | None:
            return int(self.symbol_of[ord(part)]) if len(part) == 1 else self.pieces[part][1] if part in self.pieces else None

        for piece, (_, i) in self.pieces.items():
            for at in range(1, len(piece)):
                left, right = symbol(piece[:at]), symbol(piece[at:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = i
        self.pairs = pd.Index(np.fromiter(pairs, np.int64, len(pairs)))
        self.formed = np.append(np.fromiter(pairs.values(), np.int64, len(pairs)), -1)
        self.costs = np.append(-self.id_scores, np.inf)  # of an id; -1 forms nothing

    def merged_many(self, units: list[str]) -> list[bytes]:
        """:meth:`merged` for many units, one merge in each of them at a time."""
        sizes = np.array([len(u) for u in units], np.int64)
        symbols = self.symbol_of[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)

        def formed_by(at: np.ndarray, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(symbols) - 1)
            found = self.formed[self.pairs.get_indexer(symbols[at] << 24 | symbols[after])]
            found[(after == at) | (owner[after] != owner[at])] = -1
            return found

        forms = formed_by(np.arange(len(symbols)), symbols, owner)
        costs = self.costs[forms]
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(costs, starts)
            lowest = np.repeat(low, np.diff(np.append(starts, len(owner))))
            open_ = lowest < np.inf
            if not open_.all():
                done.append((owner[~open_], symbols[~open_]))
                symbols, owner, forms, costs, lowest = (v[open_] for v in (symbols, owner, forms, costs, lowest))
                if not len(symbols):
                    break
            at = np.flatnonzero(costs == lowest)
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the first of equals
            symbols[at] = forms[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, owner, forms, costs = (v[kept] for v in (symbols, owner, forms, costs))
            at -= np.arange(len(at))  # one symbol less for each merge before
            changed = np.concatenate([at, np.maximum(at - 1, 0)])
            forms[changed] = formed_by(changed, symbols, owner)
            costs[changed] = self.costs[forms[changed]]
        owner, symbols = (np.concatenate(part) for part in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return self._split(owner[order], symbols[order], len(units))

    def _split(self, owner: np.ndarray, symbols: np.ndarray, n: int) -> list[bytes]:
        """Ids of the symbols of each of ``n`` texts; a character that no piece covers becomes several."""
        lost = np.flatnonzero(symbols >= len(self.id_scores))
        if len(lost):
            several = [self.uncovered(chr(s)) for s in (symbols[lost] - len(self.id_scores)).tolist()]
            repeats = np.ones(len(symbols), np.int64)
            repeats[lost] = list(map(len, several))
            symbols, owner = np.repeat(symbols, repeats), np.repeat(owner, repeats)
            symbols[symbols >= len(self.id_scores)] = [i for found in several for i in found]
        ends = (np.cumsum(np.bincount(owner, minlength=n)) * 4).tolist()
        joined = symbols.astype("<i4").tobytes()
        return [joined[low:high] for low, high in zip([0, *ends[:-1]], ends, strict=True)]

    def merged(self, unit: str) -> bytes:
        """Ids of a unit after merging, of all neighbours that form a piece, the pair of best score, the first of equals."""
        if len(unit) <= LONG_UNIT:
            return self.merged_many([unit])[0]
        ids: list[int] = []
        for part in self._merged_long(unit):
            found = self.pieces.get(part)
            ids += [found[1]] if found else self.uncovered(part)
        return np.array(ids, "<i4").tobytes()

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a queue of pairs, in time that grows like a sort."""
        parts: list[str | None] = list(unit)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))

        def cost(piece: str) -> float | None:
            found = self.pieces.get(piece)
            return -found[0] if found else None

        queue = [(c, i, a + b) for i, (a, b) in enumerate(pairwise(unit)) if (c := cost(a + b)) is not None]
        heapq.heapify(queue)

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (c := cost(both)) is not None:
                heapq.heappush(queue, (c, i, both))

        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j == len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two was merged with another
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _boundaries(self, lead: str, part: str, ahead: str) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids of the units of a chunk, where each starts, and the states of the one path at both edges."""
        ids = self.encode(lead + part + ahead)
        ends = np.cumsum(self.id_chars[ids])
        starts = ends - np.maximum(self.id_chars[ids], 1)
        edges = np.append(0, ends)
        left, right = len(lead), len(lead) + len(part)
        enter, leave = (int(edges[np.searchsorted(edges, at)]) - at for at in (left, right))
        return ids, starts, enter, leave

    # ---- unigram files

    def arcs(self, text: str, at: int, stop: int) -> Iterator[tuple[int, float]]:
        """Ends and scores of the pieces that start at a place; one that ends past ``stop`` is left out."""
        single, node = False, 0
        for end, char in enumerate(text[at : min(at + self.longest, stop)], at + 1):
            if (node := self.edge_of.get(node << 21 | ord(char), 0)) == 0:
                break
            if self.node_ids[node] >= 0:
                single |= end == at + 1
                yield end, float(self.gains[node])
        if not single and at < stop:
            yield at + 1, self.unk_score

    def best_of_many(self, texts: list[str]) -> list[bytes]:
        """Ids of the best segmentations of short texts that are not empty, all taken one character further at a time."""
        sizes = np.array([len(t) for t in texts], np.int64)
        which = np.arange(len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(which, sizes)
        stop = (begin + sizes)[owner]
        # arcs: the pieces that start at each character
        at, node, depth, arcs = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        while len(at):
            node = self.edges.get_indexer(node << 21 | chars[at + depth]) + 1
            at, node = at[node > 0], node[node > 0]
            depth += 1
            spelt = self.node_ids[node] >= 0
            arcs.append((at[spelt], np.full(spelt.sum(), depth), node[spelt]))
            inside = at + depth < stop[at]
            at, node = at[inside], node[inside]
        lone = np.ones(len(chars), bool)
        lone[arcs[0][0]] = False
        single = np.flatnonzero(lone)
        arcs.append((single, np.ones(len(single), np.int64), np.zeros(len(single), np.int64)))
        source, length, node = (np.concatenate(part) for part in zip(*arcs, strict=True))
        gain = np.where(node > 0, self.gains[node], self.unk_score)
        offset = source - begin[owner[source]]
        order = np.argsort(offset, kind="stable")
        # a text of n characters has n + 1 edges between and around them
        source = (source + owner[source])[order]
        target, gain, node = source + length[order], gain[order], node[order]
        first = begin + which
        score = np.full(len(chars) + len(texts), -np.inf)
        score[first] = 0.0
        back = np.zeros(len(score), np.int64)
        bounds = np.searchsorted(offset[order], np.arange(sizes.max() + 1))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            reached = score[source[low:high]] + gain[low:high]
            better = np.flatnonzero(reached > score[target[low:high]])
            ends = target[low + better]
            score[ends], back[ends] = reached[better], low + better
        here, open_, path = first + sizes, which, []
        while len(open_):
            arc = back[here]
            path.append(arc)
            here = source[arc]
            further = here > first[open_]
            open_, here = open_[further], here[further]
        taken = np.concatenate(path)
        taken = taken[np.argsort(source[taken])]
        by_text = np.searchsorted(first, source[taken], "right") - 1
        symbols = self.node_ids[node[taken]].astype(np.int64)
        lost = symbols < 0
        symbols[lost] = len(self.id_scores) + chars[source[taken[lost]] - by_text[lost]]
        return self._split(by_text, symbols, len(texts))

    # ---- both

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are already normalized."""
        units = [self.units.findall(t) for t in texts]
        every, known = list(set().union(*units)), self.unit_ids
        here = dict(zip(every, map(known.get, every), strict=True))
        lost = [u for u, ids in here.items() if ids is None]
        again = {u: known.older[u] for u in lost if u in known.older}
        here.update(again)
        fresh, made = [], {}
        for unit in lost:
            if unit in again:
                continue
            if len(unit) <= LONG_UNIT:
                fresh.append(unit)
            else:
                here[unit] = self.merged(unit) if self.kind == _BPE else self.best_of_many([unit])[0]
        for i in range(0, len(fresh), AT_ONCE):
            some = fresh[i : i + AT_ONCE]
            made.update(zip(some, self.merged_many(some) if self.kind == _BPE else self.best_of_many(some), strict=True))
        here.update(made)
        known.add(again | made)
        return [np.frombuffer(b"".join(map(here.__getitem__, found)), "<i4") for found in units]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def cut(self, text: str, chunk: int) -> list[tuple[str, str, str]]:
        """``lead, part, ahead`` of the chunks of a text: what stands around a part as far as its edges depend on it."""
        places = range(chunk, len(text), chunk)
        if self.kind == _UNIGRAM:
            edges = [0, *places, len(text)]
            return [("", text[a:b], text[b : b + self.longest - 1]) for a, b in pairwise(edges)]
        edges, wanted = [(0, 0, 0)], iter(places)
        place = next(wanted, None)
        for unit in self.units.finditer(text):
            low, high = unit.span()
            while place is not None and place < high:
                if place <= low:
                    cut = (low, low, low)
                else:
                    cut = (low, place, high) if high - low <= LONG_UNIT else (high, high, high)
                if edges[-1][1] < cut[1] < len(text):
                    edges.append(cut)
                place = next(wanted, None)
        edges.append((len(text),) * 3)
        return [(text[low:a], text[a:b], text[b:high]) for (low, a, _), (_, b, high) in pairwise(edges)]

    def transfer(self, lead: str, part: str, ahead: str) -> np.ndarray:
        """Best score of ``part`` from each entry state to each exit state."""
        n, most = len(part), self.longest
        out = np.full((most, most), -np.inf)
        if self.kind == _BPE:
            ids, starts, enter, leave = self._boundaries(lead, part, ahead)
            own = (starts >= len(lead) + enter) & (starts < len(lead) + n + leave)
            out[enter, leave] = self.id_scores[ids[own]].sum()
            return out
        full = part + ahead[: most - 1]
        cuts = [m.start() for m in self.units.finditer(full) if 0 < m.start() <= n]
        if not cuts:
            # no place that all paths share: carry a score for every entry state
            score = np.full((len(full) + 1, most), -np.inf)
            for state in range(min(most, n + 1)):
                score[state, state] = 0.0
            for at in range(n):
                for end, s in self.arcs(full, at, len(full)):
                    np.maximum(score[end], score[at] + s, out=score[end])
            for state in range(min(most, len(full) - n + 1)):
                out[:, state] = score[n + state]
            for state in range(n + 1, most):  # a piece that hangs over the whole chunk
                out[state, state - n] = 0.0
            return out
        first, last = cuts[0], cuts[-1]
        into = np.full(first + 1, -np.inf)
        into[first] = 0.0
        for at in range(first - 1, -1, -1):
            into[at] = max(s + into[end] for end, s in self.arcs(full, at, first))
        middle = self.id_scores[self.encode(full[first:last])].sum()
        onward = np.full(len(full) + 1, -np.inf)
        onward[last] = 0.0
        for at in range(last, n):
            for end, s in self.arcs(full, at, len(full)):
                onward[end] = max(onward[end], onward[at] + s)
        a, b = into[:most], onward[n : n + most]
        out[: len(a), : len(b)] = a[:, None] + middle + b
        return out

    def trace(self, lead: str, part: str, ahead: str, enter: int, leave: int) -> np.ndarray:
        """Ids of a chunk between two states."""
        if self.kind == _UNIGRAM:
            return self.encode((part + ahead)[enter : len(part) + leave])
        ids, starts, *_ = self._boundaries(lead, part, ahead)
        return ids[(starts >= len(lead) + enter) & (starts < len(lead) + len(part) + leave)]


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=1)
def surfaces(path: str) -> list[bytes]:
    """The text that each id stands for; all that decoding needs of a model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        out.append(b"" if sp.is_control(i) else bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return out


def decode_ids(ids: np.ndarray, surface: list[bytes]) -> bytes:
    return b"".join([surface[i] for i in ids.tolist()])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def states_along(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at all edges of a row of chunks, on a best path from one state to another."""
    score = np.full(len(matrices[0]), -np.inf)
    score[enter] = 0.0
    back = []
    for m in matrices:
        steps = score[:, None] + m
        back.append(steps.argmax(axis=0))
        score = steps.max(axis=0)
    states = [leave]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m).reshape(math.isqrt(len(m) // 8), -1) for m in pdf.sort_values("chunk")["matrix"]]


def _solve(pdf: pd.DataFrame, enter: int, leave: int) -> pd.DataFrame:
    states = states_along(_matrices(pdf), enter, leave)
    ordered = pdf.sort_values("chunk")
    return pd.DataFrame({"giant": ordered["giant"], "chunk": ordered["chunk"], "enter": states[:-1], "leave": states[1:]})


def edge_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """``giant, chunk, enter, leave`` for the chunk matrices of ``giant, chunk, matrix``: up by products, down by solving."""
    solved = "giant long, chunk long, enter int, leave int"
    top = matrices.agg(F.max("chunk")).first()[0]
    if top is None or top < fan:
        return matrices.groupBy("giant").applyInPandas(lambda pdf: _solve(pdf, 0, 0), solved)
    grouped = matrices.withColumn("part_of", F.floor(F.col("chunk") / fan).cast("long"))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = _matrices(pdf)
        out = whole[0]
        for m in whole[1:]:
            out = product(out, m)
        return pd.DataFrame({"giant": pdf["giant"][:1], "chunk": pdf["part_of"][:1], "matrix": [out.tobytes()]})

    above = checkpointed(grouped.groupBy("giant", "part_of").applyInPandas(joined, "giant long, chunk long, matrix binary"))
    edges = edge_states(above, fan).withColumnRenamed("chunk", "part_of")

    def inside(pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        return _solve(pdf, int(edge["enter"].iloc[0]), int(edge["leave"].iloc[0]))

    keys = ["giant", "part_of"]
    return grouped.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(inside, solved)


def _mapped(df: DataFrame, consumed: list[str], fields: str, rows) -> DataFrame:
    """Replace the ``consumed`` columns by ``fields``.

    ``rows`` takes the values of some rows, a tuple each, and gives for each row a list of lists of field values.
    """
    kept = [c for c in df.columns if c not in consumed]
    spark_schema, arrow = arrow_schema(df.select(*kept), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(c) for c in consumed]
            made: list = []
            source: list[int] = []
            held = 0
            for window in _windows(given, batch.num_rows):
                for i, outs in zip(window, rows([tuple(_value(g[i]) for g in given) for i in window]), strict=True):
                    for values in outs:
                        made.append(values)
                        source.append(i)
                        held += sum(len(v) for v in values if hasattr(v, "__len__"))
                        if held > 1 << 22:
                            yield _batch(batch, kept, made, source, arrow)
                            made, source, held = [], [], 0
            if made:
                yield _batch(batch, kept, made, source, arrow)

    return df.select(*kept, *consumed).mapInArrow(run, spark_schema)


def _each(row: Callable) -> Callable:
    return lambda rows: [row(*values) for values in rows]


def _value(scalar: pa.Scalar):
    return scalar.values.to_numpy(zero_copy_only=False) if isinstance(scalar, pa.ListScalar) else scalar.as_py()


def _windows(columns: list[pa.Array], n: int) -> Iterator[range]:
    """Row numbers in runs of at most ``WINDOW`` bytes or list elements, or of one row."""
    sizes = np.zeros(n, np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > WINDOW:
            yield range(start, i)
            start, held = i, 0
        held += size
    if n:
        yield range(start, n)


def _batch(batch: pa.RecordBatch, kept: list[str], made: list, source: list[int], arrow: pa.Schema) -> pa.RecordBatch:
    same = [batch.column(c).take(pa.array(source)) for c in kept]
    fresh = []
    for values, field in zip(zip(*made, strict=True), list(arrow)[len(kept) :], strict=True):
        if pa.types.is_list(field.type):  # arrays of numbers, put end to end
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            fresh.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), field.type.value_type)))
        else:
            fresh.append(pa.array(values, field.type))
    columns = [c.cast(f.type) for c, f in zip([*same, *fresh], arrow, strict=True)]
    return pa.record_batch(columns, schema=arrow)


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``row, giant, chunk, n_chunks, ids``: a row per document and chunk; ``row`` holds all columns but ``text``.

    ``chunk`` counts the chunks of a document from 0; ``giant`` tells the rows of giant documents apart.
    """
    single, several = encode_parts(docs, model_path, chunk, fan)
    return single.unionByName(several)


def encode_parts(docs: DataFrame, model_path: str, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`encode` in two tables: documents of one chunk, and the chunks of giant documents."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    whole = {"giant": F.lit(None).cast("long"), "chunk": F.lit(0).cast("long"), "n_chunks": F.lit(1).cast("long")}
    short = rows.filter(F.length("text") <= chunk).withColumns(whole)

    def normalized(value: str) -> str:
        return _SPACE + value.replace(" ", _SPACE) if value else ""

    def code(texts: list[tuple[str]]):
        return [[[ids]] for ids in piece_model(model_path).encode_all([normalized(value) for (value,) in texts])]

    coded = _mapped(short, ["text"], "ids array<int>", code)

    def cut(value: str):
        parts = piece_model(model_path).cut(normalized(value), chunk)
        return [[i, len(parts), *part] for i, part in enumerate(parts)]

    giant = rows.filter(F.length("text") > chunk).withColumn("giant", F.monotonically_increasing_id())
    chunks = checkpointed(_mapped(giant, ["text"], "chunk long, n_chunks long, lead string, part string, ahead string", _each(cut)))

    def transfer(lead: str, part: str, ahead: str):
        return [[piece_model(model_path).transfer(lead, part, ahead).tobytes()]]

    # chunks of a document go to many tasks
    around = ["lead", "part", "ahead"]
    spread = chunks.select("giant", "chunk", *around).repartition("giant", "chunk")
    matrices = checkpointed(_mapped(spread, around, "matrix binary", _each(transfer)))
    placed = chunks.join(edge_states(matrices, fan), ["giant", "chunk"])

    def trace(lead: str, part: str, ahead: str, enter: int, leave: int):
        return [[piece_model(model_path).trace(lead, part, ahead, enter, leave)]]

    traced = _mapped(placed, [*around, "enter", "leave"], "ids array<int>", _each(trace))
    return coded, traced.select(*coded.columns)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The documents of ``encode`` again: ``row, n_chunks, text, n_tokens, ids_crc32``.

    The chunks of a document are put together by ``giant``; they hold no more than its text did.
    """
    return decode_parts(encoded.filter("n_chunks = 1"), encoded.filter("n_chunks > 1"), model_path)


def decode_parts(single: DataFrame, several: DataFrame, model_path: str) -> DataFrame:
    """:func:`decode` for the two tables of :func:`encode_parts`, so that neither is worked out for the other."""
    import zlib

    def plain(ids: np.ndarray):
        text = decode_ids(ids, surfaces(model_path))
        return [[text[1:].decode("utf-8", "replace"), len(ids), zlib.crc32(ids.astype("<u4").tobytes())]]

    in_order = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda s: s["ids"])
    whole = several.groupBy("giant").agg(F.flatten(in_order).alias("ids"), F.first("row").alias("row"), F.first("n_chunks").alias("n_chunks"))
    both = single.select("row", "n_chunks", "ids").unionByName(whole.select("row", "n_chunks", "ids"))
    return _mapped(both, ["ids"], "text string, n_tokens long, ids_crc32 long", _each(plain))
