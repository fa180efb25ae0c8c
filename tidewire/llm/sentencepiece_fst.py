"""SentencePiece encoding and decoding as weighted transducers.

Three transducers are compiled from a model file and composed with each input:

* the *normaliser* has the arc ``start: -> U+2581`` (the dummy prefix of a text that is not
  empty), the arcs of its table (space ``-> U+2581``) and the identity for all other
  characters (the models served here have the identity character map);
* the *piece* transducer is a trie that reads characters and writes piece ids, with the
  negated piece score as tropical weight; a character of no piece takes the *byte
  fallback* arc, which writes one byte piece for each UTF-8 byte;
* the *adjacency* acceptor reads piece ids and has an arc from piece a to piece b where the
  model's merge order could have left them side by side: ``merge(a + b) == [a, b]``.

The states of the composed machine are (position, last piece).  :meth:`PieceTransducer.shortest_path`
relaxes them in the tropical semiring: weights add along a path, the smallest sum of each state
is kept with its arc, and the best final state is followed back.  Scores of a merge-based (BPE)
model are merge ranks, so without the acceptor the lightest path would not be the model's
segmentation; with it one path is accepted and its weight is the sum of its ranks.

An input is cut where no piece of the vocabulary can cross (before a run of spaces that
follows something else, and around line breaks).  The different parts of a slice of rows are
found with numpy, each is encoded once (many at a time by :meth:`PieceTransducer.shortest_paths`,
the same relaxation over arrays), and paths are kept in tables of bounded size.

Null and empty texts have no pieces.  Decoding joins the pieces, turns byte pieces into
bytes (invalid sequences into U+FFFD), U+2581 into a space and drops the dummy prefix; a text
that holds U+2581 itself does not come back as it was.  Null ids stay null; repeated rows are
encoded one by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import BASE, BASE_INVERSE, handing_back, powers, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
OUT = "doc_id bigint, n_pieces bigint, ids array<int>, decoded_sha256 string, round_trip boolean"
KEPT_PATHS, KEPT_PAIRS, PAIR_BITS, SLICE = 100_000, 300_000, 20, 1 << 19


def vocabulary(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte or control."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class PieceTransducer:
    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.text = [p for p, _, _ in pieces]
        self.weight = [-s for _, s, _ in pieces]
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        #: nested by character; the id of a piece stands under ""
        self.trie: dict = {}
        for p, i in self.id.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        #: pairs of characters that some piece holds side by side
        self.crossing = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.out = [bytes([int(p[1:-1], 16)]) if kind == "byte" else b"" if kind == "control" else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        space_cut = not any(b[1] == SPACE and b[0] != SPACE for b in self.crossing)
        lone = "".join(c for c in "\n\r\t" if not any(c in b for b in self.crossing))
        cut = re.escape(lone)
        self.parts = re.compile(rf"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+|[{cut}]" if cut else rf"{SPACE}*[^{SPACE}]+|{SPACE}+") if space_cut else re.compile(r"(?s).+")
        # the trie as sorted edges: node and character, and the node they lead to
        edges, pieces_at, stack = [], [-1], [(0, self.trie)]
        while stack:
            k, node = stack.pop()
            for c, below in node.items():
                if c == "":
                    pieces_at[k] = below
                else:
                    edges.append((k << 21 | ord(c), len(pieces_at)))
                    stack.append((len(pieces_at), below))
                    pieces_at.append(-1)
        self.edge, self.edge_to = np.array(sorted(edges), np.int64).reshape(-1, 2).T.copy()
        self.node_piece = np.array(pieces_at, np.int64)
        self.weights = np.array(self.weight)
        self.is_whole = np.full(len(pieces), -1, np.int8)
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.normaliser = str.maketrans({" ": SPACE})
        self.by_slice = space_cut
        self.lone = np.zeros(256, bool)
        self.lone[[ord(c) for c in lone]] = True
        self.out_bytes, self.out_size = np.frombuffer(b"".join(self.out), np.uint8), np.array([len(x) for x in self.out])
        self._adjacent: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._paths: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def merge(self, s: str) -> list[str]:
        """Segmentation by merges: the best-scored pair first, the leftmost of equal ones."""
        parts = list(s)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.weight[i] < best[0]):
                    best = (self.weight[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the acceptor has the arc from piece a to piece b (compiled when first met)."""
        known = self._adjacent.get(a << 32 | b)
        if known is None:
            if len(self._adjacent) > KEPT_PAIRS:
                self._adjacent.clear()
            x, y = self.text[a], self.text[b]
            known = x[-1] + y[0] not in self.crossing or self.merge(x + y) == [x, y]
            self._adjacent[a << 32 | b] = known
        return known

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [0]

    def shortest_path(self, part: str) -> tuple[int, ...]:
        """Ids on the path of least weight through input, piece trie and adjacency acceptor."""
        n, root, weight, known = len(part), self.trie, self.weight, self._adjacent
        # for each position: last piece -> (weight so far, where the piece starts, piece before)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
        best[0][-1] = (0.0, -1, -1)
        for at in range(n):
            reached = best[at]
            if not reached:
                continue
            lasts = [(last, last << 32, state[0]) for last, state in reached.items()]
            node, end = root, at
            while end < n and (node := node.get(part[end])) is not None:
                end += 1
                piece = node.get("")
                if piece is None:
                    continue
                ends, w = best[end], weight[piece]
                for last, pair, sofar in lasts:
                    if last >= 0:
                        ok = known.get(pair | piece)
                        if not (self.adjacent(last, piece) if ok is None else ok):
                            continue
                    elif not self.whole(piece):
                        continue
                    have = ends.get(piece)
                    if have is None or sofar + w < have[0]:
                        ends[piece] = (sofar + w, at, last)
            if part[at] not in self.id:  # byte fallback, named by its position
                best[at + 1][-2 - at] = min((sofar, at, last) for last, _, sofar in lasts)
        if not best[n]:
            raise ValueError(f"the acceptor has no path for {part!r}")
        at, piece = n, min(best[n], key=lambda i: best[n][i][0])
        path: list[int] = []
        while at > 0:
            _, start, before = best[at][piece]
            path += [piece] if piece >= 0 else self.fallback(part[start])[::-1]
            at, piece = start, before
        return tuple(path[::-1])

    def _arcs(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of all arcs of the trie over code points; ``left`` is how many
        characters of its part each has from itself on.  A character of no piece has the arc -2."""
        start, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        found, size = [], 0
        while len(start):
            size += 1
            key = node << 21 | text[start + size - 1]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            if size == 1:
                lone = start[~hit]
            start, node = start[hit], self.edge_to[at[hit]]
            piece = self.node_piece[node]
            ends = piece >= 0
            if size == 1:
                lone = np.concatenate([lone, start[~ends]])
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -2)))
            found.append((start[ends], np.full(np.count_nonzero(ends), size), piece[ends]))
            more = left[start] > size
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _allowed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The acceptor's answer for pairs of arcs; -1 is the start, -2 a byte fallback."""
        ok = np.ones(len(last), bool)
        first = (last < 0) & (piece >= 0)
        fresh = np.unique(piece[first])
        fresh = fresh[self.is_whole[fresh] < 0]
        self.is_whole[fresh] = [self.whole(i) for i in fresh.tolist()]
        ok[first] = self.is_whole[piece[first]] > 0
        both = np.flatnonzero((last >= 0) & (piece >= 0))
        key = last[both] << 32 | piece[both]
        slot = (key.astype(np.uint64) * np.uint64(BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        miss = self.pair_key[slot] != key
        if miss.any():
            for k, at in zip(*(x.tolist() for x in np.unique(np.stack([key[miss], slot[miss]]), axis=1)), strict=True):
                known = self._adjacent.get(k)
                self.pair_key[at], self.pair_ok[at] = k, self.adjacent(k >> 32, k & 0xFFFFFFFF) if known is None else known
            again = self.pair_key[slot] != key  # pushed out by another pair of the same slot
            ok[both] = self.pair_ok[slot]
            ok[both[again]] = [self.adjacent(k >> 32, k & 0xFFFFFFFF) for k in key[again].tolist()]
        else:
            ok[both] = self.pair_ok[slot]
        return ok

    def shortest_paths(self, parts: list[bytes]) -> list[bytes]:
        """The shortest path of each part (UTF-8, spaces as they are) as packed 32-bit ids: the
        relaxation of :meth:`shortest_path` for many parts at once, position by position.  An arc
        is the state (its end, its piece), as a piece that ends somewhere can only have started
        in one place."""
        data = b"".join(parts)
        text = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        text[text == 32] = ord(SPACE)  # the normaliser's arc
        begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        off = begins[np.concatenate([[0], np.cumsum([len(x) for x in parts])])]
        size = np.diff(off)
        part = np.repeat(np.arange(len(parts)), size)
        start, length, piece = self._arcs(text, off[part + 1] - np.arange(len(text)))
        order = np.argsort(start - off[part[start]], kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        local = start - off[part[start]]
        end = start + part[start] + length  # each part has one position more than characters
        weight = np.where(piece >= 0, self.weights[piece], 0.0)
        best, before = np.full(len(start), np.inf), np.full(len(start), -1)
        ends_at: list[list[np.ndarray]] = [[] for _ in range(size.max(initial=0) + 1)]
        cuts = np.searchsorted(local, np.arange(len(ends_at) + 1))
        for t, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a == b:
                continue
            arcs = np.arange(a, b)
            if t == 0:
                ok = self._allowed(np.full(b - a, -1), piece[a:b])
                best[a:b] = np.where(ok, weight[a:b], np.inf)
            else:
                if not ends_at[t]:
                    continue
                states = np.concatenate(ends_at[t])
                states = states[np.argsort(end[states], kind="stable")]
                at = start[a:b] + part[start[a:b]]
                lo, hi = np.searchsorted(end[states], at, "left"), np.searchsorted(end[states], at, "right")
                n = hi - lo
                arcs, lo, n = arcs[n > 0], lo[n > 0], n[n > 0]
                if not len(arcs):
                    continue
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                arc = np.repeat(arcs, n)
                state = states[np.arange(len(arc)) - np.repeat(first - lo, n)]
                cost = np.where(self._allowed(piece[state], piece[arc]), best[state], np.inf)
                least = np.minimum.reduceat(cost, first)
                winner = np.flatnonzero(cost == np.repeat(least, n))
                before[arc[winner[::-1]]] = state[winner[::-1]]
                best[arcs] = least + weight[arcs]
            arcs = arcs[np.isfinite(best[arcs])]
            stop = t + length[arcs]
            by_end = np.argsort(stop, kind="stable")
            stop, arcs = stop[by_end], arcs[by_end]
            for k, m in zip(*np.unique(stop, return_index=True), strict=True):
                ends_at[int(k)].append(arcs[m : np.searchsorted(stop, k, "right")])
        last = np.flatnonzero(np.isfinite(best) & (end == off[part[start] + 1] + part[start]))
        last = last[np.lexsort((best[last], part[start[last]]))]
        owner, first = np.unique(part[start[last]], return_index=True)
        if len(owner) < len(parts):
            raise ValueError(f"the acceptor has no path for {parts[int(np.setdiff1d(np.arange(len(parts)), owner)[0])]!r}")
        state, steps = last[first], []
        while (state >= 0).any():
            steps.append(state)
            state = np.where(state >= 0, before[state], -1)
        grid = np.stack(steps[::-1], axis=1)
        there = grid >= 0
        ids = piece[grid[there]].astype(np.int32)
        at = 4 * np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        packed = ids.tobytes()
        rows = [packed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for m in np.unique(part[start[piece == -2]]).tolist():
            path = [i for s in grid[m][there[m]].tolist() for i in ([int(piece[s])] if piece[s] >= 0 else self.fallback(chr(text[start[s]])))]
            rows[m] = np.array(path, np.int32).tobytes()
        return rows

    def whole(self, piece: int) -> bool:
        """Whether the merge order builds this piece when it stands alone."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.merge(self.text[piece]) == [self.text[piece]]
        return known

    def normalise(self, text: str) -> str:
        return SPACE + text.translate(self.normaliser) if text else ""

    def path(self, part: str) -> tuple[int, ...]:
        """The shortest path of a part; long parts are cut at character pairs that no piece contains."""
        if len(part) <= 200:
            return self.shortest_path(part)
        cuts = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.crossing), len(part)]
        return tuple(i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.shortest_path(part[a:b]))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts.findall(self.normalise(text)) for i in self.path(part)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def _kept(self, parts: list[bytes]) -> list[bytes]:
        """The packed paths of different parts; those met last stay in two tables, of which the older is dropped when the newer is full."""
        new, old = self._paths, self._older
        paths = [new.get(x) or old.get(x) for x in parts]
        missing = [k for k, path in enumerate(paths) if path is None]
        short = [k for k in missing if len(parts[k]) <= 64]
        for a in range(0, len(short), 20_000):
            group = short[a : a + 20_000]
            for k, path in zip(group, self.shortest_paths([parts[k] for k in group]), strict=True):
                paths[k] = new[parts[k]] = path
        for k in missing:
            if paths[k] is None:
                paths[k] = np.array(self.path(parts[k].decode().translate(self.normaliser)), np.int32).tobytes()
        if len(new) >= KEPT_PATHS:
            self._older, self._paths = new, {}
        return paths

    def encode_slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows of a slice and where each row's begin; decoded bytes (with the prefix) and where each row's begin.

        Rows with U+2581 in the text are not for this form, nor are models whose pieces cross spaces.
        """
        size = np.diff(off)
        filled = (size > 0).astype(np.int64)
        row_at = off + np.concatenate([[0], np.cumsum(filled)])
        data = np.full(row_at[-1], 32, np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.cumsum(filled), size)] = raw
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64), data, row_at
        lone, space = self.lone[data], data == 32
        starts = lone | space
        starts[1:] &= lone[1:] | ~space[:-1]
        starts[1:] |= lone[:-1]
        starts[row_at[:-1][filled > 0]] = True
        at = np.flatnonzero(starts)
        length = np.diff(np.append(at, len(data)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(data.astype(np.uint64) + np.uint64(1), powers(BASE, len(data)), out=sums[1:])
        np.cumsum(sums, out=sums)
        h = (sums[at + length] - sums[at]) * powers(BASE_INVERSE, len(data) + 1)[at]
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        same = np.arange(len(data)) + np.repeat(at[first][kind] - at, length)
        if (length != length[first][kind]).any() or (data[same] != data).any():  # two parts of one hash
            whole = data.tobytes()
            names = {whole[a : a + n]: None for a, n in zip(at.tolist(), length.tolist(), strict=True)}
            number = {x: k for k, x in enumerate(names)}
            kind = np.array([number[whole[a : a + n]] for a, n in zip(at.tolist(), length.tolist(), strict=True)])
            paths = self._kept(list(names))
        else:
            whole = data.tobytes()
            paths = self._kept([whole[a : a + n] for a, n in zip(at[first].tolist(), length[first].tolist(), strict=True)])
        ids, part_at = _gather(np.frombuffer(b"".join(paths), np.int32), np.array([len(x) // 4 for x in paths]), kind)
        row_ids = part_at[np.searchsorted(at, row_at)]
        back, id_at = _gather(self.out_bytes, self.out_size, ids)
        return ids, row_ids, back, id_at[row_ids]


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named ones of parts that lie one after the other, and where each begins (with the end)."""
    begin = np.concatenate([[0], np.cumsum(size)])
    n = size[which]
    at = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(at[-1]) + np.repeat(begin[which] - at[:-1], n)], at


_compiled: dict[str, PieceTransducer] = {}


def encode_documents(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """Per row: doc_id, ids, their number, digest of the decoded text, exact round trip."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))  # one model file: tens of thousands of pieces

    @handing_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled.get(model_file) or _compiled.setdefault(model_file, PieceTransducer(pieces.value))
        mark = SPACE.encode()
        for batch in batches:
            done = 0
            for rows, raw, off in slices([batch], size=SLICE):
                own = batch.column("doc_id").slice(done, len(rows))
                done += len(rows)
                text = raw.tobytes()
                if fst.by_slice and mark not in text:
                    ids, at, back, back_at = fst.encode_slice(raw, off)
                    back = back.tobytes()
                    decoded = [back[a + (b > a) : b] for a, b in zip(back_at[:-1].tolist(), back_at[1:].tolist(), strict=True)]
                else:
                    lists = [fst.encode(text[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    ids, at = np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])
                    decoded = [fst.decode(x).encode("utf-8", "replace") for x in lists]
                same = [x == text[a:b] for x, a, b in zip(decoded, off[:-1].tolist(), off[1:].tolist(), strict=True)]
                col = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(at)), col, pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), pa.array(same)], names=["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, OUT)
