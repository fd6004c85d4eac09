"""SentencePiece encoding into the N best segmentations, and decoding.

All segmentations of a text are the paths through a lattice whose arcs are
pieces. A forward Viterbi pass gives the best score from the start to every
position. Those scores are exact heuristics for an A* search from the end
backwards: the first N paths that reach the start are the N best, in order. No
position is left more than N times, so the search is linear in the length even
where all paths are equally good, as in a long run of one character.

No piece continues over a blank mark that follows another character, nor over a
line end if no piece of the model holds one. So the lattice of a text is a chain
of lattices of its units (a word with the blank or line end before it), and its
N best paths combine those of its units. Units are analysed once for a memo of
bounded size: their best path, and by how much their second path is worse. Only
the N - 1 units of least loss in a text can differ from their best path in its N
best; these are searched by A*, and their paths combined best-first. Texts with
runs of blanks are cut at those runs only.

Characters that are no piece are arcs of one character, scored below all usual
pieces; they are encoded as byte pieces.

All N segmentations are returned: the best as ids, each as the spans of those
ids that it replaces (`segmentations` writes them out). round_trip says whether
every one of them decodes to the text.

Null and empty texts: no ids, one path of score 0, decoded to the empty text.
Equal scores: the order of paths is the same for the same text. Repeated rows:
each encoded. Empty table: no rows. Extra columns are ignored. A text that holds
the blank mark itself decodes to a blank there, and round_trip is false. Null
ids decode to a null text.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nearfold.llm.common import table, to_python

N_BEST = 4
MARK = "▁"
#: Scores at or below are sentinels, not of usual pieces.
SENTINEL = -1e8
BELOW = 10.0
#: Units of one generation of a worker's memo.
MEMO_UNITS = 160_000
#: Characters of the longest unit that is analysed together with others.
LONGEST = 48


class Transitions:
    """Child nodes of a trie by (node, letter): an open table of edges, with a further one for those that met a taken slot."""

    def __init__(self, keys: np.ndarray, children: np.ndarray, odd: int = 0x9E3779B97F4A7C15):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.odd, self.shift = np.uint64(odd), np.uint64(64 - bits)
        slot = self._slot(keys)
        first = np.unique(slot, return_index=True)[1]
        self.keys, self.children = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.keys[slot[first]], self.children[slot[first]] = keys[first], children[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.more = np.zeros(1 << bits, bool)
        self.more[slot[rest]] = True
        self.next = Transitions(keys[rest], children[rest], (odd * 5 + 2) % (1 << 64) | 1) if len(rest) else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.odd) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The child of each edge, or -1."""
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.children[slot], -1)
        if self.next:
            other = np.flatnonzero(self.more[slot] & (found < 0))
            if len(other):
                found[other] = self.next.find(keys[other])
        return found


class Pieces:
    """The pieces of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.piece = [model.id_to_piece(i) for i in ids]
        self.score = [model.get_score(i) for i in ids]
        usual = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unknown = min((self.score[i] for i in usual if self.score[i] > SENTINEL), default=0.0) - BELOW
        # Every prefix of a piece, with the piece's id or -1.
        self.prefixes: dict[str, int] = {}
        for i in usual:
            p = self.piece[i]
            for j in range(1, len(p)):
                self.prefixes.setdefault(p[:j], -1)
            self.prefixes[p] = i
        self.byte_ids = {int(self.piece[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.ascii_ids = np.array([self.byte_ids.get(b, -1) for b in range(128)])
        self.lines_apart = not any("\n" in self.piece[i] for i in usual if len(self.piece[i]) > 1)
        values = {i: b for b, i in self.byte_ids.items()}
        self.bytes_of = [bytes([values[i]]) if i in values else b"" if model.is_control(i) or model.is_unknown(i) else self.piece[i].replace(MARK, " ").encode() for i in ids]
        self._build_trie()

    def _build_trie(self) -> None:
        """Nodes are prefixes, the root is 0. Letters are the characters of pieces, from 1 on; no edge has letter 0."""
        letters = {c: k for k, c in enumerate(sorted(set(chain.from_iterable(self.prefixes))), 1)}
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        node = {"": 0} | {p: k for k, p in enumerate(self.prefixes, 1)}
        edges = np.array([node[p[:-1]] * self.letters + letters[p[-1]] for p in self.prefixes], np.int64)
        self.edges = Transitions(edges, np.arange(1, len(node), dtype=np.int32))
        self.piece_at = np.array([-1, *self.prefixes.values()], np.int64)
        self.scores = np.array(self.score)
        self.longest = max(map(len, self.prefixes), default=1)

    def arcs(self, s: str) -> list[list[tuple[int, float, int]]]:
        """For each position, the arcs that end there: start, score, id (-1: a character that is no piece)."""
        n, get, score = len(s), self.prefixes.get, self.score
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            j = i + 1
            k = get(s[i:j])
            if k is None or k < 0:
                ends[j].append((i, self.unknown, -1))
            while k is not None:
                if k >= 0:
                    ends[j].append((i, score[k], k))
                j += 1
                if j > n:
                    break
                k = get(s[i:j])
        return ends

    def ids(self, s: str, path: list[tuple[int, int]]) -> list[int]:
        """path: start and id of each arc."""
        out: list[int] = []
        for i, k in path:
            out += [k] if k >= 0 else [self.byte_ids[b] for b in s[i].encode()]
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """Scores and ids of the n best paths through the lattice of s (blanks already marked), best first."""
        ends = self.arcs(s)
        forward = [0.0] * len(ends)
        for j in range(1, len(ends)):
            forward[j] = max(forward[i] + x for i, x, _ in ends[j])
        out: list[tuple[float, list[int]]] = []
        left = [n] * len(ends)  # the n best paths leave no position more than n times
        pushed = 0
        heap: list = [(-forward[-1], len(s), 0, 0.0, None)]
        while heap and len(out) < n:
            _, at, _, so_far, path = heapq.heappop(heap)  # of equal paths the one nearest to the start
            if not left[at]:
                continue
            left[at] -= 1
            if not at:
                arcs = []
                while path:
                    arc, path = path
                    arcs.append(arc)
                out.append((so_far, self.ids(s, arcs)))
                continue
            for i, x, k in ends[at]:
                if left[i]:
                    pushed += 1
                    heapq.heappush(heap, (-(so_far + x + forward[i]), i, pushed, so_far + x, ((i, k), path)))
        return out

    def analyse(self, s: str) -> tuple[bytes, float, float]:
        """Ids of the best path (int32), its score, and how much the second path loses."""
        n, get, score, unknown = len(s), self.prefixes.get, self.score, self.unknown
        first, second = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1)
        chosen = [(0, -1)] * (n + 1)
        for i in range(n):
            f, g, j = first[i], second[i], i + 1  # g is not above f
            k = get(s[i:j])
            if k is None or k < 0:
                if f + unknown > first[j]:
                    first[j], second[j], chosen[j] = f + unknown, max(first[j], g + unknown), (i, -1)
                elif f + unknown > second[j]:
                    second[j] = f + unknown
            while k is not None:
                if k >= 0:
                    x = f + score[k]
                    if x > first[j]:
                        second[j] = first[j] if first[j] > g + score[k] else g + score[k]
                        first[j] = x
                        chosen[j] = (i, k)
                    elif x > second[j]:
                        second[j] = x
                j += 1
                if j > n:
                    break
                k = get(s[i:j])
        ids, j = [], n
        while j:
            i, k = chosen[j]
            ids += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(s[i].encode())]
            j = i
        ids.reverse()
        return array("i", ids).tobytes(), first[n], first[n] - second[n]

    def _arcs_of(self, letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and ids of the pieces of each length, from 1 on, within letters."""
        out = []
        at, node = np.flatnonzero(letters), np.zeros(1, np.int64)
        for size in range(self.longest):
            node = self.edges.find(node * self.letters + letters[at + size]).astype(np.int64)
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive]
            piece = self.piece_at[node]
            hit = np.flatnonzero(piece >= 0)
            out.append((at[hit], piece[hit]))
            if not len(at):
                break
        return out

    def _analyse_short(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """analyse for units of at most LONGEST characters at once. Their places are laid out one after another, a unit's last place being its end."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(size + 1) - size - 1
        places = int(start[-1] + size[-1] + 1)
        within = np.arange(places) - np.repeat(start, size + 1)
        inner = np.ones(places, bool)
        inner[start + size] = False
        points = np.zeros(places + self.longest, np.int64)
        points[:places][inner] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[points]
        letters[:places][~inner] = 0
        letters[places:] = 0
        arcs = self._arcs_of(letters)
        unknown = inner.copy()
        if arcs:
            unknown[arcs[0][0]] = False
        lone = np.flatnonzero(unknown)
        singles = arcs[0] if arcs else (lone[:0], lone[:0])
        arcs[:1] = [(np.concatenate([singles[0], lone]), np.concatenate([singles[1], np.full(len(lone), -1)]))]
        longest = int(size.max())
        by_start = []
        for at, piece in arcs:
            order = np.argsort(within[at].astype(np.int16), kind="stable")
            at, piece = at[order], piece[order]
            gain = np.where(piece >= 0, self.scores[piece], self.unknown)
            by_start.append((at, piece, gain, np.searchsorted(within[at], np.arange(longest + 1))))
        first, second = np.full(places, -np.inf), np.full(places, -np.inf)
        first[start] = 0.0
        chosen, back = np.full(places, -1), np.zeros(places, np.int64)
        for j in range(1, longest + 1):
            for m in range(min(j, len(by_start)), 0, -1):  # of equal paths the longest last piece
                at, piece, gain, cut = by_start[m - 1]
                lo, hi = cut[j - m], cut[j - m + 1] if j - m < longest else len(at)
                if lo == hi:
                    continue
                i = at[lo:hi]
                e = i + m
                x, y = first[i] + gain[lo:hi], second[i] + gain[lo:hi]
                f = first[e]
                better = x > f
                second[e] = np.where(better, np.maximum(f, y), np.maximum(second[e], x))
                won = np.flatnonzero(better)
                e = e[won]
                first[e], chosen[e], back[e] = x[won], piece[lo:hi][won], m
        end = start + size
        path, count = np.zeros((len(units), longest), np.int32), np.zeros(len(units), np.int64)
        odd = np.zeros(len(units), bool)
        row, at = np.flatnonzero(size), end[size > 0]
        while len(row):
            piece = chosen[at]
            single = np.flatnonzero(piece < 0)
            if len(single):
                code = points[at[single] - 1]
                odd[row[single[code >= 128]]] = True
                piece[single] = self.ascii_ids[np.minimum(code, 127)]
            count[row] += 1
            path[row, longest - count[row]] = piece
            at = at - back[at]
            more = np.flatnonzero(at > start[row])
            row, at = row[more], at[more]
        ids = path[np.arange(longest) >= (longest - count)[:, None]]
        score, loss = first[end], first[end] - second[end]
        odd = np.flatnonzero(odd)
        if not len(odd):
            return ids, count, score, loss
        split = np.split(ids, np.cumsum(count)[:-1])
        for k in odd.tolist():  # of characters that are several bytes
            split[k] = np.frombuffer(self.analyse(units[k])[0], np.int32)
            count[k] = len(split[k])
        return np.concatenate(split), count, score, loss

    def analyse_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """analyse of each unit: ids of all, their number, score and loss by unit."""
        parts = []
        held: list[str] = []

        def flush():
            if held:
                parts.append(self._analyse_short(held))
                held.clear()

        for u in units:
            if len(u) > LONGEST:
                flush()
                ids, score, loss = self.analyse(u)
                found = np.frombuffer(ids, np.int32)
                parts.append((found, np.array([len(found)]), np.array([score]), np.array([loss])))
            else:
                held.append(u)
                if len(held) == 16384:
                    flush()
        flush()
        return tuple(np.concatenate(x) for x in zip(*parts))

    def decode(self, ids: list[int]) -> bytes:
        """The text, without the blank that encoding puts before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ")


def lattice_of(unit: str) -> str:
    return unit if unit[:1] == MARK or unit[:1] == "\n" else MARK + unit


def surface(lattice: str) -> bytes:
    """What a lattice stands for in the text."""
    return lattice.replace(MARK, " ").encode()


#: Runs of blanks with what follows up to the next blank, without and with line ends as starts of units.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
LINES = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


class Memo:
    """Analyses by unit, each in a row of arrays."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss, self.sound = np.zeros(0), np.zeros(0), np.zeros(0, bool)

    def add(self, units: list[str], ids, size, score, loss, sound) -> None:
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        for name, new in (("ids", ids), ("size", size), ("score", score), ("loss", loss), ("sound", sound)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        """Ids of the units at these rows, one after another."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """N-best encoding of whole texts with a memo of units: two generations, of which the older is dropped when the younger is full."""

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n = pieces, n
        self.memo, self.older = Memo(), Memo()
        self.paths: dict[str, list[tuple[float, list[int]]]] = {}

    def split(self, text: str) -> list[str]:
        """The units of a text: one that begins with neither a blank mark nor a line end has one mark before it in the lattice."""
        marked = text.replace(" ", MARK)
        apart = marked.replace("\n", MARK + "\n")
        if MARK * 2 in apart or marked[:1] == MARK or (len(apart) > len(marked) and not self.pieces.lines_apart):
            return self._split_slow(marked)
        return apart.split(MARK)

    def _split_slow(self, marked: str) -> list[str]:
        found = (LINES if self.pieces.lines_apart else CHUNK).findall(MARK + marked)
        return [c if c[:1] == "\n" or c[1:2] in (MARK, "\n") else c[1:] for c in found]

    def _places(self, units: list[str]) -> np.ndarray:
        """Rows of the memo of all units; the new ones are analysed first."""
        if len(self.memo.index) > MEMO_UNITS:
            self.memo, self.older = Memo(), self.memo
        memo, older = self.memo, self.older
        at = np.fromiter(map(memo.index.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        names = [units[i] for i in missing.tolist()]
        fresh = set(names)
        again = [w for w in fresh if w in older.index]
        if again:
            rows = np.fromiter(map(older.index.__getitem__, again), np.int64, len(again))
            memo.add(again, older.ids_of(rows), older.size[rows], older.score[rows], older.loss[rows], older.sound[rows])
            fresh.difference_update(again)
        if fresh:
            new = sorted(fresh, key=len)
            lattices = list(map(lattice_of, new))
            ids, size, score, loss = self.pieces.analyse_many(lattices)
            memo.add(new, ids, size, score, loss, self._sound(lattices, ids, size))
        at[missing] = np.fromiter(map(memo.index.__getitem__, names), np.int64, len(names))
        return at

    def _sound(self, lattices: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ids of each unit decode to it."""
        decoded = list(map(self.pieces.bytes_of.__getitem__, ids.tolist()))
        if b"".join(decoded) == surface("".join(lattices)):
            return np.ones(len(lattices), bool)
        ends = np.cumsum(size).tolist()
        return np.array([b"".join(decoded[b - n : b]) == surface(x) for x, b, n in zip(lattices, ends, size.tolist())], bool)

    def encode_all(self, texts: list[str]):
        """Of each text: ids of the best path (all texts' in one array) and their number; the n best scores, each with the changes
        (place in the best ids, ids dropped there, ids instead); whether all of them decode to the text."""
        split = [self.split(t) if t else [] for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        units = list(chain.from_iterable(split))
        at = self._places(units)
        memo = self.memo
        size, loss, sound = memo.size[at], memo.loss[at], memo.sound[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        total = np.bincount(np.repeat(np.arange(len(count)), count), memo.score[at], len(count))
        best, trips, lo = [], [], 0
        for k, n in enumerate(count.tolist()):
            hi = lo + n
            least = [lo + int(c) for c in self._least(loss[lo:hi])]
            options = [(c, self._nbest(units[c], memo.ids_of(at[c : c + 1]))) for c in least]
            paths = self._combine(float(total[k]), options)
            first = ends[lo]
            best.append([(score, [(int(ends[c] - first), int(size[c]), ids) for c, ids in sorted(other.items())]) for score, other in paths])
            fits = sound[lo:hi].all() and MARK not in texts[k] if n else True
            trips.append(bool(fits and all(b"".join(map(self.pieces.bytes_of.__getitem__, ids)) == surface(lattice_of(units[c])) for _, other in paths for c, ids in other.items())))
            lo = hi
        bounds = np.concatenate([[0], np.cumsum(count)])
        return memo.ids_of(at), ends[bounds[1:]] - ends[bounds[:-1]], best, trips

    def _nbest(self, unit: str, best: np.ndarray) -> list[tuple[float, list[int]]]:
        found = self.paths.get(unit)
        if found is None:
            if len(self.paths) > MEMO_UNITS // 8:
                self.paths.clear()
            found = self.pieces.nbest(lattice_of(unit), self.n)
            # Of equal paths the one that the analysis chose comes first.
            chosen = best.tolist()
            found = self.paths[unit] = [(found[0][0], chosen), *(x for x in found if x[1] != chosen)][: self.n]
        return found

    def _least(self, loss: np.ndarray) -> list[int]:
        """The n - 1 units of least loss, of those that have a second path."""
        if len(loss) > 64:
            bound = np.partition(loss, self.n - 2)[self.n - 2]
            near = np.flatnonzero(loss <= bound)
            near = near[np.argsort(loss[near], kind="stable")][: self.n - 1]
        else:
            near = np.argsort(loss, kind="stable")[: self.n - 1]
        return [k for k in near.tolist() if loss[k] < np.inf]

    def _combine(self, total: float, options: list[tuple[int, list[tuple[float, list[int]]]]]) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best choices of one path for each chunk, best-first."""
        start = (0,) * len(options)
        heap, seen, out = [(-total, start)], {start}, []
        while heap and len(out) < self.n:
            score, choice = heapq.heappop(heap)
            out.append((-score, {options[k][0]: options[k][1][i][1] for k, i in enumerate(choice) if i}))
            for k, i in enumerate(choice):
                paths = options[k][1]
                if i + 1 < len(paths) and (more := (*choice[:k], i + 1, *choice[k + 1 :])) not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (score + paths[i][0] - paths[i + 1][0], more))
        return out


CHANGE = "struct<at:int,drop:int,ids:array<int>>"
FIELDS = f"n_ids long, ids array<int>, nbest_scores array<double>, nbest_sizes array<long>, nbest_changes array<array<{CHANGE}>>, round_trip boolean"
NAMES = ["n_ids", "ids", "nbest_scores", "nbest_sizes", "nbest_changes", "round_trip"]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, n: int) -> Encoder:
    """One for each Python worker, which keeps its memo over many tasks."""
    return Encoder(Pieces(path), n)


def _nested(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _changes(best: list) -> pa.Array:
    """nbest_changes as nested arrays."""
    paths = [changes for text in best for _, changes in text]
    flat = [c for changes in paths for c in changes]
    ids = _nested([len(c[2]) for c in flat], pa.array([i for c in flat for i in c[2]], pa.int32()))
    each = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), ids], names=["at", "drop", "ids"])
    return _nested([len(text) for text in best], _nested([len(changes) for changes in paths], each))


def _encode(path: str, n: int):
    def run(batches):
        encoder = _encoder(path, n)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, sizes, best, trips = encoder.encode_all([t or "" for t in part.column("text").to_pylist()])
                scores = [[s for s, _ in text] for text in best]
                counts = [[k + sum(len(c[2]) - c[1] for c in changes) for _, changes in text] for k, text in zip(sizes.tolist(), best)]
                columns = [pa.array(sizes, pa.int64()), _nested(sizes, pa.array(ids)), pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())), _changes(best), pa.array(trips, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *NAMES])

    return run


def encode_nbest(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """For each row of docs: doc_id; n_ids and ids of the best segmentation; scores, sizes and changes of the n best, the best first; round_trip.

    A change replaces `drop` of the best ids from place `at` on by `ids`; the best segmentation has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return to_python(docs.select("doc_id", "text")).mapInArrow(_encode(model_path, n), f"doc_id {kind}, {FIELDS}")


def segmentations(encoded: DataFrame) -> DataFrame:
    """doc_id, place (0 is the best), score, ids: a row for each of the n best segmentations of encode_nbest."""
    none = F.array().cast("array<int>")
    each = encoded.select("doc_id", F.col("ids").alias("best"), F.posexplode(F.arrays_zip("nbest_scores", "nbest_changes")).alias("place", "path"))

    def step(acc, c):
        return F.struct((c["at"] + c["drop"]).alias("at"), F.concat(acc["out"], F.slice("best", acc["at"] + 1, c["at"] - acc["at"]), c["ids"]).alias("out"))

    def end(acc):
        return F.concat(acc["out"], F.slice("best", acc["at"] + 1, F.greatest(F.size("best") - acc["at"], F.lit(0))))

    ids = F.aggregate("path.nbest_changes", F.struct(F.lit(0).alias("at"), none.alias("out")), step, end)
    return each.select("doc_id", "place", F.col("path.nbest_scores").alias("score"), ids.alias("ids"))


def _decode(path: str):
    def run(batches):
        pieces = _encoder(path, N_BEST).pieces
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with the text of its ids as decoded. Bytes that are no UTF-8 become U+FFFD; an id that the model lacks is an error."""
    fields = [f for f in encoded.columns if f != "decoded"]
    kept = encoded.select(*(F.col(f"`{f}`") for f in fields))
    return to_python(kept).mapInArrow(_decode(model_path), StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """encode_nbest of all documents: null and empty texts have no ids, repeated rows are each returned, an empty table gives no rows."""
    import public_tokenizers

    return encode_nbest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
