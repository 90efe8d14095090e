"""Sub-word models as weighted transducers, and their encoding as the tropical shortest path.

The model file holds pieces with scores.  Four machines are compiled from it, as arrays of arcs:

* the normaliser: a space or visible space becomes the space mark, one of which is put before the text;
* the pieces: a trie whose arcs (state, character, next state) lead to states that may give a piece, at a weight;
* byte fallback: a character that is no piece becomes its bytes;
* the acceptor of neighbours: one state for each last piece, whose arcs weigh what the next piece costs after it.

Composed with an input the first three give a lattice of arcs (start, end, piece, weight), and with the acceptor its paths
have the weights that the shortest path minimises, position by position, for many inputs at once.  In a unigram model a
piece weighs its negative score and every neighbour nothing.  In a model of ranked merges pieces weigh nothing, and a pair
weighs nothing if merging its characters by rank gives the pair again, else infinity; a sequence whose neighbours all agree
is what the merges give, so every position has exactly one path of finite weight.

Whether a pair agrees is read off the merges of its two pieces, from the last back to the first: at every moment the pieces
that then touched must not have merged before either was used up.  That needs pieces whose own merges rise in rank, which
is checked for every piece; pairs with others are merged outright.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rushes.llm.words import text_bytes

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i, n = 0, len(b)

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            x = b[i]
            i += 1
            v |= (x & 127) << shift
            shift += 7
            if x < 128:
                return v

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, b[i : i + size]
            i += size


class Model:
    """A compiled model.  Supports identity normalisation, byte fallback, and unigram or merge segmentation."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        self.kind, self.unknown, dummy = UNIGRAM, 0, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                i = len(self.texts)
                self.texts.append(piece)
                self.scores.append(score)
                self.bytes_of.append(b"" if kind == _CONTROL else piece.replace(SPACE, " ").encode())
                if kind == _BYTE:
                    byte_ids[int(piece[3:5], 16)] = i
                    self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                elif kind == _NORMAL:
                    self.ids[piece] = i
                elif kind == _UNKNOWN:
                    self.unknown = i
                elif kind == _USER:
                    raise ValueError("user-defined pieces are not supported")
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("only identity normalisation is supported")
                    if n == 3:
                        dummy = bool(v)
                    if n == 4 and v:
                        raise ValueError("removal of extra spaces is not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        self.dummy = dummy
        self.fallback = np.array([byte_ids.get(b, self.unknown) for b in range(256)], np.int32)
        self.is_byte = np.zeros(len(self.texts), bool)
        self.is_byte[self.fallback] = True
        self._compile()

    # --- the machines -----------------------------------------------------------------------------------------------
    def _compile(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        chars = sorted(set("".join(self.ids)) | {SPACE})
        if any(c not in self.ids for c in chars if c != SPACE):
            raise ValueError("a piece has a character that is no piece")
        self.label = np.full(0x110000, -1, np.int32)
        self.label[[ord(c) for c in chars]] = np.arange(len(chars))
        self.n_labels = len(chars)
        arcs: dict[tuple[int, int], int] = {}
        gives = [-1]
        for text, piece in self.ids.items():
            state = 0
            for c in text:
                key = state, int(self.label[ord(c)])
                if key not in arcs:
                    arcs[key] = len(gives)
                    gives.append(-1)
                state = arcs[key]
            gives[state] = piece
        self.arc_state, self.arc_label = (np.array([k[i] for k in arcs], np.int64) for i in (0, 1))
        self.arc_next, self.gives = np.array(list(arcs.values()), np.int32), np.array(gives, np.int32)
        self.arcs = Table(self.arc_state * self.n_labels + self.arc_label, self.arc_next)
        self.cost = np.zeros(len(self.texts)) if self.kind == BPE else -np.array(self.scores)
        self.lost = max(0.0, -min(self.scores, default=0.0)) + 10.0  # a character that is no piece weighs more than any piece
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.inner = Table(np.array([self.label[ord(x[0])] * self.n_labels + self.label[ord(x[1])] for x in inner], np.int64), np.ones(len(inner), np.int32))
        # Where a text may be cut on its bytes: around ASCII characters of no piece, and before spaces that follow other characters.
        self.alone = np.array([chr(b) not in self.ids and chr(b) != " " for b in range(128)] + [False] * 128)
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if self.kind == BPE:
            self._compile_pairs()

    def _compile_pairs(self) -> None:
        n = len(self.texts)
        by_score = sorted(self.ids.values(), key=lambda i: -self.scores[i])
        self.rank, rank = np.full(n + 1, -1, np.int64), {}
        for r, i in enumerate(by_score):  # characters are there from the start
            rank[i] = r if not r or self.scores[i] != self.scores[by_score[r - 1]] else rank[by_score[r - 1]]
            self.rank[i] = -1 if len(self.texts[i]) == 1 else rank[i]
        self.part = np.full((2, n + 1), -1, np.int64)
        self.stands = np.zeros(n + 1, bool)  # merging the characters of the piece gives it
        self.plain = np.zeros(n + 1, bool)  # and the merges rise in rank
        self.first, self.last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        keys, ranks = [], []
        for text, i in self.ids.items():
            self.first[i], self.last[i] = self.label[ord(text[0])], self.label[ord(text[-1])]
            parts, done = list(text), []
            while len(parts) > 1 and (step := self._next_merge(parts)):
                at, piece = step
                done.append(rank[piece])
                self.part[:, i] = self.ids[parts[at]], self.ids[parts[at + 1]]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.stands[i] = parts == [text]
            self.plain[i] = self.stands[i] and all(x <= y for x, y in zip(done, done[1:]))
            for k in range(1, len(text)):
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank[i])
        self.merged = Table(np.array(keys, np.int64), np.array(ranks, np.int32))
        self.odd: dict[tuple[int, int], bool] = {}

    def _next_merge(self, parts: list[str]) -> tuple[int, int] | None:
        best = None
        for at in range(len(parts) - 1):
            piece = self.ids.get(parts[at] + parts[at + 1])
            if piece is not None and (best is None or self.scores[piece] > self.scores[best[1]]):
                best = at, piece
        return best

    def _merges_to(self, left: int, right: int) -> bool:
        """The definition of agreement, for pieces whose merges don't rise in rank."""
        if (left, right) not in self.odd:
            parts = list(self.texts[left] + self.texts[right])
            while len(parts) > 1 and (step := self._next_merge(parts)):
                parts[step[0] : step[0] + 2] = [parts[step[0]] + parts[step[0] + 1]]
            if len(self.odd) > 1_000_000:
                self.odd.clear()
            self.odd[left, right] = parts == [self.texts[left], self.texts[right]]
        return self.odd[left, right]

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which arcs of the acceptor, from the state of ``left`` by ``right``, weigh nothing; negative pieces have no merges."""
        if self.kind != BPE:
            return np.ones(len(left), bool)
        out = self.stands[right] | (right < 0)
        n, never = len(self.texts), np.iinfo(np.int64).max
        at = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[self.inner.get(self.last[left[at]] * self.n_labels + self.first[right[at]]) >= 0]
        odd = at[~(self.plain[left[at]] & self.plain[right[at]])]
        for i in odd.tolist():
            out[i] = self._merges_to(int(left[i]), int(right[i]))
        at = np.setdiff1d(at, odd, assume_unique=True) if len(odd) else at
        x, y = left[at].astype(np.int64), right[at].astype(np.int64)
        used_x, used_y = np.full(len(at), never), np.full(len(at), never)  # the rank at which each is merged with what it doesn't touch
        while len(at):
            r = self.merged.get(x * n + y)
            clash = (r >= 0) & (r < used_x) & (r <= used_y)
            out[at[clash]] = False
            back_x = self.rank[x] > self.rank[y]
            used_x, used_y = np.where(back_x, self.rank[x], used_x), np.where(back_x, used_y, self.rank[y])
            whole = np.where(back_x, self.rank[x], self.rank[y]) < 0
            x, y = np.where(back_x, self.part[1, x], x), np.where(back_x, y, self.part[0, y])
            go = ~clash & ~whole
            at, x, y, used_x, used_y = at[go], x[go], y[go], used_x[go], used_y[go]
        return out

    # --- composition and shortest paths -----------------------------------------------------------------------------
    def _lattice(self, labels: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece that an arc of that length gives from each position, -1 for none."""
        state, at = np.zeros(len(labels), np.int64), np.arange(len(labels))
        limit, out = np.repeat(ends, np.diff(ends, prepend=0)), [np.zeros(0, np.int32)]
        for size in range(1, self.longest + 1):
            found = np.full(len(labels), -1, np.int32)
            at = at[at + size <= limit[at]]
            label = labels[at + size - 1]
            at, label = at[label >= 0], label[label >= 0]
            nxt = self.arcs.get(state[at] * self.n_labels + label)
            at, nxt = at[nxt >= 0], nxt[nxt >= 0]
            state[at] = nxt
            found[at] = self.gives[nxt]
            out.append(found)
            if not len(at):
                break
        return out

    def lattice(self, text: str) -> list[tuple[int, int, int, float]]:
        """The arcs of the composed machines for one text: start, end, piece (-1 for byte fallback), weight."""
        codes = _codes(self.normal(text))
        labels = self.label[codes]
        arcs = self._lattice(labels, np.array([len(codes)]))
        out = [(i, i + size, int(p), float(self.cost[p])) for size, found in enumerate(arcs) if size for i, p in enumerate(found.tolist()) if p >= 0]
        single = arcs[1] if len(arcs) > 1 else np.full(len(codes), -1)
        return sorted(out + [(i, i + 1, -1, self.lost) for i in np.flatnonzero(single < 0).tolist()])

    def _shortest(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cheapest paths of many short inputs, one after the other, and the number of ids of each."""
        labels, starts = self.label[codes], np.concatenate([[0], ends[:-1]])
        arcs = self._lattice(labels, ends)
        single = arcs[1] if len(arcs) > 1 else np.full(len(codes), -1, np.int32)
        cost, piece, size_of = np.full(len(codes), np.inf), np.full(len(codes), -1, np.int32), np.ones(len(codes), np.int32)
        sizes = ends - starts
        by_size = np.argsort(-sizes, kind="stable")
        starts_by, sizes_by = starts[by_size], sizes[by_size]
        merges = self.kind == BPE
        for p in range(1, int(sizes.max(initial=0)) + 1):
            first = starts_by[: np.searchsorted(-sizes_by, -p, "right")]
            end = first + p - 1
            open_ = np.arange(len(end))
            for size in range(min(len(arcs) - 1, p), 0, -1):
                found = arcs[size][end[open_] - size + 1]
                some = np.flatnonzero(found >= 0)
                if not len(some):
                    continue
                who, found = open_[some], found[some]
                before = end[who] - size
                held = np.zeros(len(who)) if size == p else cost[before]
                left = np.full(len(who), -1) if size == p else piece[before]
                fits = self.agree(left, found)
                new = held + self.cost[found]
                fits &= new < cost[end[who]]
                won = who[fits]
                cost[end[won]], piece[end[won]], size_of[end[won]] = new[fits], found[fits], size
                if merges:  # no second path has a finite weight
                    open_ = np.setdiff1d(open_, won, assume_unique=True)
                    if not len(open_):
                        break
            lost = end[single[end] < 0]
            new = (np.zeros(len(lost)) if p == 1 else cost[lost - 1]) + self.lost
            less = new < cost[lost]
            cost[lost[less]], piece[lost[less]], size_of[lost[less]] = new[less], -1, 1
        on_path, now, first = np.zeros(len(codes), bool), ends - 1, starts
        while len(now):
            on_path[now] = True
            now = now - size_of[now]
            now, first = now[now >= first], first[now >= first]
        return self._spelt(codes, piece, on_path, ends)

    def _spelt(self, codes, piece, on_path, ends):
        at = np.flatnonzero(on_path)
        ids, n = piece[at], np.ones(len(at), np.int64)
        lost = np.flatnonzero(ids < 0)
        kinds, which = np.unique(codes[at[lost]], return_inverse=True)
        spelt = [self.fallback[list(chr(c).encode())] for c in kinds.tolist()]
        n[lost] = np.array([len(x) for x in spelt], np.int64)[which] if len(lost) else n[lost]
        out = np.repeat(ids, n)
        if len(lost):
            first = (np.cumsum(n) - n)[lost]
            flat, begin = np.concatenate(spelt), np.cumsum([0, *map(len, spelt)])[which]
            step = np.arange(n[lost].sum()) - np.repeat(np.cumsum(n[lost]) - n[lost], n[lost])
            out[np.repeat(first, n[lost]) + step] = flat[np.repeat(begin, n[lost]) + step]
        total = np.concatenate([[0], np.cumsum(n)])
        return out.astype(np.int32), np.diff(total[np.searchsorted(at, ends, "left")], prepend=0)

    def normal(self, text: str) -> str:
        """What the normaliser gives for a text."""
        return ((SPACE if self.dummy else "") + text.replace(" ", SPACE)) if text else ""

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, the number of ids of each text, and whether they spell it.

        Texts are cut where no piece can lie across, and each distinct cut of the column is encoded once.
        """
        column = pc.fill_null(column, "").cast(pa.large_string())
        marked = pc.match_substring(column, SPACE)
        plain = pc.replace_substring(column, SPACE, " ") if pc.any(marked).as_py() else column
        if self.dummy:
            plain = pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string())))
        data, offsets = text_bytes(plain)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            alone, space = self.alone[data], data == 32
            cut[1:-1] = alone[1:] | alone[:-1]
            if self.cut_spaces:
                cut[1:-1] |= space[1:] & ~space[:-1]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        ids, sizes, spelt = self._encode_chunks(chunks.dictionary)
        code = chunks.indices.to_numpy().astype(np.int64)
        of_text = np.searchsorted(at, offsets)
        n = sizes[code]
        begin = (np.cumsum(sizes) - sizes)[code]
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        wrong = np.concatenate([[0], np.cumsum(~spelt[code])])[of_text]
        return out, np.diff(total[of_text]), (np.diff(wrong) == 0) & ~marked.to_numpy(zero_copy_only=False)

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text_data, offsets = text_bytes(chunks)
        text_data = text_data[offsets[0] : offsets[-1]]
        codes = _codes(text_data.tobytes().decode().replace(" ", SPACE))
        chars = np.concatenate([[0], np.cumsum((text_data & 0xC0) != 0x80)])[offsets - offsets[0]]
        # Cut again wherever no piece has the two characters next to each other.
        label = self.label[codes].astype(np.int64)
        cut = np.ones(len(codes) + 1, bool)
        if len(codes) > 1:
            cut[1:-1] = (label[1:] < 0) | (label[:-1] < 0) | (self.inner.get(label[:-1] * self.n_labels + label[1:]) < 0)
        cut[chars] = True
        ends = np.flatnonzero(cut)[1:]
        sizes = np.diff(ends, prepend=0)
        # Inputs of like length together, in groups of bounded size.
        order = np.argsort(sizes, kind="stable")
        group = np.cumsum(sizes[order]) // _GROUP
        made, counts = [np.zeros(0, np.int32)], np.zeros(len(ends), np.int64)
        for g in np.unique(group):
            own = order[group == g]
            span = np.repeat(ends[own] - sizes[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            ids, counts[own] = self._shortest(codes[span], np.cumsum(sizes[own]))
            made.append(ids)
        made, begin = np.concatenate(made), np.zeros(len(ends), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = made[np.repeat(begin - total[:-1], counts) + np.arange(total[-1])]
        n = np.diff(total[np.searchsorted(ends, chars[1:], "right")], prepend=0)
        spelt = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        size = np.array([len(x) for x in self.bytes_of], np.int64)[ids]
        length = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])])
        same = length == np.diff(offsets)
        if spelt != text_data.tobytes():
            where, a, b = np.flatnonzero(same), np.cumsum(length) - length, offsets - offsets[0]
            raw = text_data.tobytes()
            same[where] = [spelt[a[i] : a[i] + length[i]] == raw[b[i] : b[i + 1]] for i in where.tolist()]
        return ids, n, same

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids) -> str:
        """The text of the ids, less the space that the normaliser put before it."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy and out.startswith(" ") else out


#: Characters that share one pass over the positions.
_GROUP = 1 << 17


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class Table:
    """Whole numbers by key, looked up many at a time; -1 for keys that aren't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out
