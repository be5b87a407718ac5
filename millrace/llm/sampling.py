"""Sampled segmentations of a SentencePiece vocabulary: Gumbel top-k without replacement by a perturbed A-star search.

The lattice of a text has a node before and behind each character and an edge for each piece. Pieces weigh 1 / (rank +
SMOOTH) by their rank in the vocabulary (BPE models rank pieces by merge order, about by frequency), characters without
a piece fall back to bytes. A segmentation is a path, its probability the product of its weights, normalised over the
lattice. No piece holds a space behind another character, so the lattice falls apart at the words, and each distinct
word's lattice is built once a batch: backward sums give at each node the exact probability of each edge, and a path is
drawn edge by edge.

The search: the largest of all perturbed log-probabilities (log p + Gumbel noise) is a Gumbel number at 0, and the path
that has it is a random one. All other paths leave it at some node by another edge; those that leave at one node are a
region, whose largest perturbed log-probability is a Gumbel number at the log of the region's mass, truncated at the
former. The region with the largest one is opened next, its path drawn and its rest split alike. The k first paths are
a sample without replacement.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, tidy
from millrace.llm.ngrams import STEP, mix

#: Added to a piece's rank; larger numbers make samples more alike in probability.
SMOOTH = 10.0
#: Nodes of a path whose regions are told apart at once; the paths that leave later are one region until it is opened.
AHEAD = 12
#: Random numbers of a text that are drawn at once.
DRAWN = 64
#: Words whose lattices are kept between batches.
FREQUENT = 60_000
#: Characters of one batch.
AT_ONCE = 4_000_000
SPACE = "▁"
#: What a lattice falls apart into: at spaces always, and between Latin letters and all else where no piece spans them.
_LETTERS = "A-Za-z\xaa\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WORDS = re.compile(" *[^ ]+| +")
_FINER = re.compile(f" *[{_LETTERS}]+| *[^{_LETTERS} ]+| +")
_SPANS = re.compile(f"[{_LETTERS}][^{_LETTERS}{SPACE}]|[^{_LETTERS}{SPACE}][{_LETTERS}]")


def uniform(*keys) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys alone."""
    h = np.zeros(np.broadcast(*keys).shape, np.uint64)
    for k in keys:
        h = mix(h * np.uint64(STEP) + np.asarray(k).astype(np.uint64) + np.uint64(1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def truncated(location, bound: float, u):
    """A Gumbel number at location, given that it is at most bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class _Numbers(dict):
    """Word to number, numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """Pieces of a SentencePiece model file with byte fallback and identity normalisation, and their weights."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        self.size = n
        self.frequent: dict[str, int] = {}
        self.lattice: Lattice | None = None
        self.byte_ids = {int(p.id_to_piece(i)[3:-1], 16): i for i in range(n) if p.is_byte(i)}
        kept = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        texts = {i: p.id_to_piece(i) for i in kept}
        self.weight = np.full(n, -np.inf)
        by_score = sorted(kept, key=lambda i: (-p.get_score(i), i))
        self.weight[by_score] = -np.log(np.arange(len(by_score)) + SMOOTH)
        self.byte_weight = -float(np.log(len(by_score) + SMOOTH))
        self.longest = max(map(len, texts.values()))
        if any(SPACE in t.lstrip(SPACE) for t in texts.values()):
            raise ValueError("a piece holds a space behind another character")
        self.words = _WORDS if any(map(_SPANS.search, texts.values())) else _FINER
        #: By length: sorted hashes, and the ids.
        self.by_length = []
        for length in range(1, self.longest + 1):
            own = [i for i in kept if len(texts[i]) == length]
            h = np.zeros(len(own), np.uint64)
            points = np.array([[ord(c) for c in texts[i]] for i in own], np.uint64).reshape(len(own), length)
            for k in range(length):
                h = h * np.uint64(STEP) + points[:, k]
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
            there = np.zeros(1 << 20, bool)  # most strings are no piece: found out without a search
            there[h >> np.uint64(44)] = True
            self.by_length.append((h[order], np.array(own, np.int64)[order], there))
        self.bytes = [b""] * n
        for i in kept:
            self.bytes[i] = texts[i].encode("utf-8").replace(SPACE.encode(), b" ")
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, n)
        self.flat, self.begins = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.lengths) - self.lengths

    def remember(self, numbers: dict[str, int], counts: np.ndarray) -> None:
        """Keeps the lattices of the words met most often, to build them once only."""
        often = np.argsort(-counts, kind="stable")[:FREQUENT]
        words = list(numbers)
        self.frequent = {words[i]: k for k, i in enumerate(often.tolist())}
        self.lattice = Lattice(self, list(self.frequent))

    def decode(self, ids) -> str:
        """The text of ids: their bytes, without the space that encoding puts before the text."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


    def decoded(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids, with the space before the text; all rows at once."""
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = self.flat[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends[:-1], lengths)].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Lattice:
    """Lattices of the distinct words of a batch. A place is a character; an edge is its place and its length."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.v = vocabulary
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points[points == 32] = ord(SPACE)  # the vocabulary's mark of a space
        n, longest = len(points), vocabulary.longest
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.end_of = np.repeat(self.ends, lengths)
        left = self.end_of - np.arange(n)
        found_at, found_len, found_id = [], [], []
        h = np.zeros(n, np.uint64)
        at = np.arange(n)
        for k, (hashes, ids, there) in enumerate(vocabulary.by_length):
            if k:
                on = left[at] > k
                at, h = at[on], h[on]
            if not len(at):
                break
            h = h * np.uint64(STEP) + points[at + k]
            maybe = np.flatnonzero(there[h >> np.uint64(44)])
            if len(maybe):
                f = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                real = hashes[f] == h[maybe]
                found_at.append(at[maybe[real]])
                found_id.append(ids[f[real]])
                found_len.append(np.full(int(real.sum()), k + 1))
        single = np.zeros(n, bool)
        if found_at:
            single[found_at[0][found_len[0] == 1]] = True
        #: Characters without a piece: their bytes' ids stand behind the vocabulary.
        self.fallback: list[list[int]] = []
        none, weights = np.flatnonzero(~single), [vocabulary.weight]
        for c in np.unique(points[none]).tolist():
            ids = [vocabulary.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            mine = none[points[none] == c]
            found_at.append(mine)
            found_len.append(np.ones(len(mine), np.int64))
            found_id.append(np.full(len(mine), vocabulary.size + len(self.fallback)))
            weights.append(np.array([vocabulary.byte_weight * len(ids)]))
            self.fallback.append(ids)
        # Edges by place; a place's edges are those from first to first of the next. Each length has a place once.
        n_edges = np.zeros(n, np.int64)
        for at in found_at:
            n_edges[at] += 1
        self.first = np.concatenate([[0], np.cumsum(n_edges)])
        self.place = np.repeat(np.arange(n), n_edges)
        self.size, self.ids, free = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64), self.first[:-1].copy()
        for at, size, ids in zip(found_at, found_len, found_id, strict=True):
            slot = free[at]
            self.size[slot], self.ids[slot] = size, ids
            free[at] += 1
        score = np.concatenate(weights)[self.ids]
        # Backward sums, for all words at once by the distance from the end.
        node = np.arange(n) + np.repeat(np.arange(len(words)), lengths)
        target = node[self.place] + self.size if len(self.place) else self.place
        below = np.zeros(n + len(words) + 1)
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, (left.max() if n else 0) + 2))
        self.log_p = np.zeros(len(score))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = by_left[a:b]
            if not len(at):
                continue
            m = n_edges[at]
            starts = np.cumsum(m) - m
            edges = np.arange(m.sum()) + np.repeat(self.first[at] - starts, m)
            s = score[edges] + below[target[edges]]
            top = np.maximum.reduceat(s, starts)
            below[node[at]] = total = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, m)), starts))
            self.log_p[edges] = s - np.repeat(total, m)
        # The likeliest edge of a place first, so that a draw has few to look at.
        if n:
            best = np.flatnonzero(self.log_p == np.repeat(np.maximum.reduceat(self.log_p, self.first[:-1]), n_edges))
            here, there = self.first[self.place[best]], best
            for x in (self.size, self.ids, self.log_p):
                x[here], x[there] = x[there], x[here]
        self.p = np.exp(self.log_p)
        #: Edges that are the only one at their place.
        self.alone = np.repeat(n_edges, n_edges) == 1
        #: Shares of the edges of a place up to each, added up place by place; 2 at the last, which takes what rounding leaves.
        self.upto = self.p.copy()
        for k in range(1, int(n_edges.max(initial=0))):
            edge = self.first[:-1][n_edges > k] + k
            self.upto[edge] += self.upto[edge - 1]
        self.upto[self.first[1:] - 1] = 2

    def with_(self, other: Lattice) -> Lattice:
        """Both lattices in one: the words of this one, then those of the other."""
        out = object.__new__(Lattice)
        out.v = self.v
        n, e, f = len(self.end_of), len(self.place), len(self.fallback)
        ids = np.where(other.ids >= self.v.size, other.ids + f, other.ids) if f and other.fallback else other.ids
        shift = {"starts": n, "end_of": n, "place": n, "size": 0, "log_p": 0, "p": 0, "alone": 0, "upto": 0}
        for name, by in shift.items():
            x = getattr(other, name)
            setattr(out, name, np.concatenate([getattr(self, name), x + by if by else x]))
        out.ids = np.concatenate([self.ids, ids])
        out.first = np.concatenate([self.first[:-1], other.first + e])
        out.fallback = self.fallback + other.fallback
        return out

    def paths(self, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random way from each place to its word's end: its edges, and their number."""
        n = np.zeros(len(starts), np.int64)
        active, at, steps = np.arange(len(starts)), starts.copy(), []
        end = self.end_of[starts] if len(starts) else starts
        while len(active):
            u = (mix(keys[active] + np.uint64(len(steps))) >> np.uint64(11)).astype(np.float64) / 2.0**53
            edge = self.first[at]
            on = np.flatnonzero(u >= self.upto[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.upto[edge[on]]]
            steps.append((active, edge))
            n[active] += 1
            at = at + self.size[edge]
            more = at < end[active]
            active, at = active[more], at[more]
        first = np.cumsum(n) - n
        edges = np.zeros(n.sum(), np.int64)
        for k, (a, e) in enumerate(steps):
            edges[first[a] + k] = e
        return edges, n

    def tokens(self, edges: np.ndarray) -> np.ndarray:
        """Ids of edges; fallbacks become their bytes."""
        ids = self.ids[edges]
        bad = np.flatnonzero(ids >= self.v.size) if self.fallback else ()
        if not len(bad):
            return ids
        out, at = [], 0
        for k in bad.tolist():
            out += [ids[at:k], np.array(self.fallback[ids[k] - self.v.size], np.int64)]
            at = k + 1
        return np.concatenate([*out, ids[at:]])


class _Path:
    """A drawn path of one text: edges, the numbers of their words, and the logarithms of their probabilities added up."""

    __slots__ = ("edges", "upto", "word")

    def __init__(self, lattice: Lattice, edges: np.ndarray, word: np.ndarray):
        self.edges, self.word = edges, word
        self.upto = np.concatenate([[0.0], np.cumsum(lattice.log_p[edges])])


class _Search:
    """Open regions of one text, by the largest perturbed log-probability."""

    def __init__(self, lattice: Lattice, key: int, numbers: np.ndarray):
        self.lattice, self.key, self.heap, self.drawn, self.numbers, self.serial = lattice, key, [], 0, numbers, 0

    def _u(self, n: int) -> np.ndarray:
        while self.drawn + n > len(self.numbers):
            k = len(self.numbers)
            self.numbers = np.append(self.numbers, uniform(np.uint64(self.key), np.arange(k, k + DRAWN) + (1 << 40)))
        self.drawn += n
        return self.numbers[self.drawn - n : self.drawn]

    def _push(self, values: np.ndarray, path: _Path, what: list) -> None:
        """Regions of one path, as one entry that gives them one by one."""
        order = np.argsort(-values)
        self._put((values[order].tolist(), order.tolist(), path, what), 0)

    def _put(self, bundle: tuple, k: int) -> None:
        self.serial += 1
        heapq.heappush(self.heap, (-bundle[0][k], self.serial, bundle, k))

    def regions(self, path: _Path, begin: int) -> tuple[list, np.ndarray]:
        """((node, edges left out), ...), log masses of the paths that leave ``path`` at node begin or later."""
        end = min(begin + AHEAD, len(path.edges))
        edges = path.edges[begin:end]
        other = 1.0 - self.lattice.p[edges]
        other[self.lattice.alone[edges]] = 0.0
        with np.errstate(divide="ignore"):
            mass = path.upto[begin:end] + np.log(other)
        what: list = [(k, (e,)) for k, e in zip(range(begin, end), edges.tolist(), strict=True)]
        if end < len(path.edges):
            rest = path.upto[-1] - path.upto[end]
            mass = np.append(mass, path.upto[end] + (np.log(-np.expm1(rest)) if rest < 0 else -np.inf))
            what.append((end, ()))
        return what, mass

    def add(self, path: _Path, begin: int, bound: float) -> None:
        what, mass = self.regions(path, begin)
        real = np.flatnonzero(np.isfinite(mass))
        if len(real):
            self._push(truncated(mass[real], bound, self._u(len(real))), path, [what[k] for k in real.tolist()])

    def next(self) -> tuple[float, _Path, int, tuple[int, ...]] | None:
        """The best region, as (value, path, node, edges left out); a region of several nodes is opened first."""
        while self.heap:
            value, _, bundle, k = heapq.heappop(self.heap)
            value = -value
            if k + 1 < len(bundle[0]):
                self._put(bundle, k + 1)
            path = bundle[2]
            node, without = bundle[3][bundle[1][k]]
            if without:
                return value, path, node, without
            what, mass = self.regions(path, node)
            real = np.flatnonzero(np.isfinite(mass))
            mass = mass[real]
            # One of its parts has its largest value; the others stay below.
            share = np.cumsum(np.exp(mass - mass.max()))
            u = self._u(len(mass) + 1)
            values = truncated(mass, value, u[:-1])
            values[min(int(np.searchsorted(share / share[-1], u[-1])), len(mass) - 1)] = value
            self._push(values, path, [what[k] for k in real.tolist()])
        return None

    def branch(self, path: _Path, node: int, without: tuple[int, ...], bound: float) -> int:
        """Draws another edge at a node of a path, and opens the region of the edges still left; gives the edge."""
        here = self.lattice.place[path.edges[node]]
        first = int(self.lattice.first[here])
        p = self.lattice.p[first : self.lattice.first[here + 1]].copy()
        p[[e - first for e in without]] = 0
        u = self._u(2)
        edge = min(int(np.searchsorted(np.cumsum(p) / p.sum(), u[0], side="right")), int(np.flatnonzero(p)[-1]))
        p[edge] = 0
        if p.sum() > 0:
            self._push(truncated(np.array([path.upto[node] + np.log(p.sum())]), bound, u[1]), path, [(node, (*without, first + edge))])
        return first + edge


def sample_batch(vocabulary: Vocabulary, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best first: (ids, log-probability, perturbed one, inclusion probability)."""
    numbers = _Numbers(vocabulary.frequent)
    per_text = [np.fromiter(map(numbers.__getitem__, vocabulary.words.findall(" " + t.replace(SPACE, " "))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    lattice = Lattice(vocabulary, list(islice(numbers, len(vocabulary.frequent), None)))
    if vocabulary.lattice:
        lattice = vocabulary.lattice.with_(lattice)
    elif len(numbers) > FREQUENT // 8:
        vocabulary.remember(numbers, np.bincount(np.concatenate(per_text), minlength=len(numbers)))
    n = len(texts)
    out: list[list] = [[] for _ in texts]
    key_of = np.array(keys, np.uint64)
    drawn = uniform(key_of[:, None], np.arange(DRAWN) + (1 << 40))
    searches = [_Search(lattice, key, u) for key, u in zip(keys, drawn, strict=True)]
    begin = [0] * n  # node from which the rest of a path is drawn
    prefix: list = [None] * n  # (path, node, edge taken there)
    bound = [float(-np.log(-np.log(uniform(key_of[i : i + 1], 1 << 41)[0]))) for i in range(n)]
    doing = list(range(n))
    for round_ in range(k):
        if not doing:
            break
        # What is left to draw: in each text the rest of the word of the branch, and all words behind it.
        starts, owners, serial = [], [], []
        for i in doing:
            if prefix[i] is None:
                w, place = 0, np.zeros(0, np.int64)
            else:
                path, node, edge = prefix[i]
                w = int(path.word[node]) + 1
                after = lattice.place[edge] + lattice.size[edge]
                place = np.array([after] if after < lattice.end_of[lattice.place[edge]] else [], np.int64)
            rest = lattice.starts[per_text[i][w:]]
            starts.append(np.concatenate([place, rest]))
            owners.append(np.full(len(place) + len(rest), i))
            serial.append(np.arange(w - len(place), len(per_text[i])))
        owner, serial_ = np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(serial) if serial else np.zeros(0, np.int64)
        draws = mix(key_of[owner] + mix(serial_.astype(np.uint64) * np.uint64(1024) + np.uint64(round_ + 1))) if len(owner) else np.zeros(0, np.uint64)
        edges, count = lattice.paths(np.concatenate(starts) if starts else np.zeros(0, np.int64), draws)
        word = np.repeat(serial_, count)
        at = np.concatenate([[0], np.cumsum(count)])
        cuts = at[np.concatenate([[0], np.cumsum([len(s) for s in starts])])]
        left = []
        for i, a, b in zip(doing, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e, w = edges[a:b], word[a:b]
            if prefix[i] is not None:
                old, node, edge = prefix[i]
                e, w = np.concatenate([old.edges[:node], [edge], e]), np.concatenate([old.word[: node + 1], w])
            path = _Path(lattice, e, w)
            out[i].append((path, bound[i]))
            searches[i].add(path, begin[i], bound[i])
            found = searches[i].next()
            if found is None:
                bound[i] = -np.inf
                continue
            value, base, node, without = found
            bound[i] = value
            if round_ + 1 < k:
                prefix[i], begin[i] = (base, node, searches[i].branch(base, node, without, value)), node + 1
                left.append(i)
        doing = left
    return [[(lattice.tokens(p.edges), float(p.upto[-1]), g, float(-np.expm1(-np.exp(min(p.upto[-1] - bound[i], 700.0))))) for p, g in out[i]] for i in range(n)]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of that file; read once a process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def samples(texts: list[str | None], keys: list[int], path: str, k: int) -> Iterator[tuple[int, list]]:
    """(place, samples) of each text, in batches of some AT_ONCE characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        yield from zip(range(at, end), sample_batch(vocabulary(path), texts[at:end], keys[at:end], k), strict=True)
        at = end


def row_keys(ids: list[int | None], seed: int) -> list[int]:
    return [xxhash.xxh64_intdigest(b"" if i is None else str(i).encode(), seed) for i in ids]


def encode(docs: DataFrame, path, k: int = 2, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, sample, n_tokens, ids_crc32, log_p, perturbed, inclusion, decoded[, ids]) of up to k samples of every text.

    Rows are seeded by doc_id, so results don't depend on how rows are dealt. A text with fewer segmentations has all of
    them, with inclusion 1; a null or empty text has one of no tokens. inclusion is the probability that a segmentation
    is among the sampled ones given the perturbed log-probability that comes next. decoded: whether the ids give the
    text back; only a text that holds the space mark itself or lone surrogates doesn't come back. Repeated rows get
    equal samples; other columns are ignored. path: of the model file, or a function that gives it on an executor.
    """
    schema = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_p double, perturbed double, inclusion double, decoded boolean" + ", ids array<int>" * with_ids

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path() if callable(path) else path
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                doc_ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                rows, of, all_ids = [], [], []
                for i, found in samples(texts, row_keys(doc_ids, seed), where, k):
                    for j, (ids, log_p, perturbed, inclusion) in enumerate(found):
                        of.append(i)
                        all_ids.append(ids)
                        rows.append((doc_ids[i], j + 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log_p, perturbed, inclusion))
                back = vocabulary(where).decoded(all_ids)
                given = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
                rows = [(*r, b == given[i], *[ids.astype(np.int32)] * with_ids) for r, b, i, ids in zip(rows, back, of, all_ids, strict=True)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
                    names = ["doc_id", "sample", "n_tokens", "ids_crc32", "log_p", "perturbed", "inclusion", "decoded", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[: len(rows[0])])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
