"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

All segmentations of a text are the paths of a lattice over its characters; a path's probability is the product of its
pieces' probabilities, normalised over all paths. Giving every path a Gumbel-perturbed log-probability and taking the k
largest draws k distinct paths without replacement. The search is best-first over sets of paths, each bounded by the
exact maximum of its perturbed values (which is again a Gumbel variable), so the first k complete paths it pops are the
k largest: popping a set draws one complete path with the set's value, and the paths that leave it at each of its pieces
become new sets with truncated Gumbel values. Every random number is a hash of the row's key, the draw and the place in
the text: a row gives the same samples in any batch, task or run.

No piece reaches over the start of a word, so lattices are built per word and kept in a bounded cache of the worker.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import bound_batches

SPACE = "▁"
SAMPLES = 2
#: Exponent on piece probabilities: below 1 flattens the choice between segmentations.
ALPHA = 0.5
#: Characters that are searched together, and lattice nodes that a worker keeps.
GROUP_CHARS = 600_000
CACHE_NODES = 2_200_000
EDGES_OF_NODE = 6

_NONE = -1
#: No -log(-log(u)) of a uniform number as made below is larger, and the depth of sets that are looked at first.
HIGHEST = 38.0
DEPTH = 80.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def draws(seed: np.ndarray, draw: int) -> np.ndarray:
    """The starting point of a row's random numbers for one draw."""
    with np.errstate(over="ignore"):
        return _mixed(seed + np.uint64(0x9E3779B97F4A7C15) * np.uint64(draw + 1))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def uniform(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) for places of rows."""
    with np.errstate(over="ignore"):
        bits = _mixed(start + _STEP * place.astype(np.uint64))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def shifted(start: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The starting points for places that are counted from ``by`` places later on."""
    with np.errstate(over="ignore"):
        return start + _STEP * by.astype(np.uint64)


def extended(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that grow by one code point each."""
    with np.errstate(over="ignore"):
        return _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1))


SLOT_BITS = 16


def hashed_table(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, ids, first entry of each slot): sorted hashes under their leading bits; ids are -1 for mere beginnings."""
    slots = np.searchsorted(hashes >> np.uint64(64 - SLOT_BITS), np.arange(1 << SLOT_BITS, dtype=np.uint64)).astype(np.int32)
    # An entry after the last ends every search.
    return np.append(hashes, ~np.uint64(0)), np.append(ids, np.int32(_NONE)), slots


def looked_up(table: tuple[np.ndarray, ...], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether known) of hashes: a slot holds few entries, which are stepped through."""
    hashes, ids, slots = table
    at = slots[(wanted >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    more = np.flatnonzero(hashes[at] < wanted)
    while len(more):
        at[more] += 1
        more = more[hashes[at[more]] < wanted[more]]
    return ids[at], hashes[at] == wanted


class PieceModel:
    """The pieces of a model file with probabilities, and their byte strings for decoding."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Whether normalising only marks the spaces, which is then done here.
        probe = "  A ﬁ\t\u00a0Å e\u0301\n Ⅳ\u3000x  "
        self.plain = p.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        n = p.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        scores = np.array([p.get_score(i) for i in range(n)])
        raw: list[bytes] = []
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                raw.append(b"")
            else:
                self.ids[piece] = i
                raw.append(piece.replace(SPACE, " ").encode())
        self.raw = pa.array(raw, pa.large_binary())
        #: BPE scores are ranks; by Zipf's law a piece of rank r has a probability in proportion to 1 / (r + 10).
        ranks = scores[list(self.ids.values())]
        logs = -np.log(10 - scores) if (ranks == np.round(ranks)).all() and ranks.min() < -100 else scores
        logs[list(self.byte_ids.values())] = logs[list(self.ids.values())].min()
        used = [*self.ids.values(), *self.byte_ids.values()]
        self.logs = (alpha * (logs - np.log(np.exp(logs[used]).sum()))).tolist()
        self.longest = max(map(len, self.ids))
        self._log_array = np.array(self.logs)
        #: By length: all pieces' beginnings of that length.
        self.tables: list[tuple[np.ndarray, ...]] = []
        for size in range(1, self.longest + 1):
            starts = sorted({piece[:size] for piece in self.ids if len(piece) >= size})
            codes = np.frombuffer("".join(starts).encode("utf-32-le"), np.uint32).reshape(len(starts), size)
            hashes = np.zeros(len(starts), np.uint64)
            for i in range(size):
                hashes = extended(hashes, codes[:, i])
            order = np.argsort(hashes)
            assert len(np.unique(hashes)) == len(starts)
            self.tables.append(hashed_table(hashes[order], np.array([self.ids.get(x, _NONE) for x in starts], np.int32)[order]))

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.processor.normalize(text) if text else ""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> list[str]:
        """The texts of runs of ids; ``offsets`` bound the runs."""
        pieces = self.raw.take(ids)
        ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
        data = pieces.buffers()[2].to_pybytes() if pieces.buffers()[2] else b""
        at = ends[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        return [t.removeprefix(" ") for t in texts]


class Lattices:
    """Word lattices in flat arrays. A node's edges carry their cumulated probabilities, the last one 1, so the first that
    is above a uniform number is the edge drawn; many nodes are drawn for at once."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        # Memory is only taken as it is filled.
        nodes, edges = CACHE_NODES + 2, EDGES_OF_NODE * CACHE_NODES
        self._edges = (np.empty(edges, np.float32), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.float32))
        self._nodes = (np.zeros(nodes, np.int32), np.zeros(nodes, np.int32))
        self.length = np.zeros(nodes, np.int32)  # of a word, at its first node
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}
        self.byte_runs: list[list[int]] = []
        self._run_of: dict[str, tuple[int, float]] = {}
        self.n_nodes = self.n_edges = 0

    def add(self, keys_of: list[str]) -> None:
        """Builds the lattices of new words together and appends them to the arrays, which grow when they are full."""
        words = [SPACE + k for k in keys_of]
        for i in [i for i, k in enumerate(keys_of) if k[-1:] == SPACE and k.strip(SPACE)]:
            words[i] = keys_of[i][:-1]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = "".join(words)
        start, size, ids, value = self._pieces(text, np.repeat(offsets[1:], sizes))
        # Summed log-probability of all paths from a place to its word's end: places nearest to an end come first, and
        # the edges of a place stay together.
        by_place = np.argsort(start, kind="stable")
        left = (np.repeat(offsets[1:], sizes) - np.arange(len(text))).astype(np.uint16 if sizes.max() < 65536 else np.int64)  # sorted by radix if they are short
        ahead = left[start[by_place]]
        turn = by_place[np.argsort(ahead, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ahead))])
        here = (np.arange(len(text)) + np.repeat(np.arange(len(words)), sizes))[start[turn]]  # each word has one more node than characters
        there, ids, share = here + size[turn], ids[turn], value[turn]
        back = np.zeros(len(text) + len(words))
        heads = np.flatnonzero(np.diff(here, prepend=-1))
        inner = np.searchsorted(heads, bounds)
        for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            if a < b:
                share[a:b] += back[there[a:b]]
                first = heads[inner[i] : inner[i + 1]]
                back[here[first]] = np.logaddexp.reduceat(share[a:b], first - a)
        counts = np.diff(np.append(heads, len(here)))
        share -= np.repeat(back[here[heads]], counts)
        run = np.cumsum(np.exp(share))
        total = run - np.repeat(np.concatenate([[0.0], run[heads[1:] - 1]]), counts)
        base = self.n_nodes
        total[np.append(heads[1:], len(here)) - 1] = 1.0
        share[heads[counts == 1]] = 0.0
        starts, held = np.zeros((2, len(back)), np.int32)
        starts[here[heads]], held[here[heads]] = self.n_edges + heads, counts
        there += base
        nodes, edges = self.n_nodes, self.n_edges
        self._edges = tuple(self._grown(old, edges, new) for old, new in zip(self._edges, (total, there, ids, share), strict=True))
        self._nodes = tuple(self._grown(old, nodes, new) for old, new in zip(self._nodes, (starts, held), strict=True))
        begin = offsets[:-1] + np.arange(len(words))
        length = np.zeros(len(back), np.int32)
        length[begin] = sizes
        self.length = self._grown(self.length, nodes, length)
        self.first.update(zip(keys_of, (base + begin).tolist(), strict=True))
        self.n_nodes += len(back)
        self.n_edges += len(here)

    def _pieces(self, text: str, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, id, log-probability) of every piece in the words; ids below -1 stand for runs of bytes."""
        m = self.model
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, table in enumerate(m.tables, 1):
            inside = at + size <= word_end[at]
            at, hashes = at[inside], hashes[inside]
            if not len(at):
                break
            hashes = extended(hashes, codes[at + size - 1])
            ids, known = looked_up(table, hashes)
            is_piece = known & (ids >= 0)
            found.append((at[is_piece], np.full(int(is_piece.sum()), size), ids[is_piece], m._log_array[ids[is_piece]]))
            if size == 1 and not is_piece.all():  # a character that is no piece is written in bytes
                odd = at[~is_piece]
                runs = [self._byte_run(text[x]) for x in odd.tolist()]
                found.append((odd, np.ones(len(odd), np.int64), np.array([r[0] for r in runs], np.int32), np.array([r[1] for r in runs])))
            at, hashes = at[known], hashes[known]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _byte_run(self, char: str) -> tuple[int, float]:
        if char not in self._run_of:
            run = [self.model.byte_ids[b] for b in char.encode()]
            self.byte_runs.append(run)
            self._run_of[char] = (-1 - len(self.byte_runs), sum(self.model.logs[b] for b in run))
        return self._run_of[char]

    @staticmethod
    def _grown(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        need = used + len(new)
        if need > len(old):
            old = np.concatenate([old[:used], np.zeros(max(need, 6 * used // 5) - used, old.dtype)])
        old[used:need] = new
        return old

    def arrays(self) -> tuple:
        """cumulated shares, ends, ids, log shares, first edge and edges of each node; a node that ends a word has none."""
        n, m = self.n_edges, self.n_nodes
        return *(x[:n] for x in self._edges), *(x[:m] for x in self._nodes)


def truncated_gumbel(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, given that they lie below ``bound``; minus infinity where there is no mass."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = location - np.logaddexp(location - bound, np.log(-np.log(u)))
    return np.where(np.isneginf(location), -np.inf, np.minimum(out, bound))


class Sampled(NamedTuple):
    """Segmentations in the order of (text, sample): where each one's ids begin, the ids, and what is known of each."""

    text: np.ndarray
    sample: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    log_prob: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray


class Sampler:
    def __init__(self, path: str, k: int = SAMPLES, alpha: float = ALPHA) -> None:
        self.model = PieceModel(path, alpha)
        self.lattices = Lattices(self.model)
        self.k = k

    def groups(self, texts: list[str], seeds: list[int]) -> Iterator[tuple[int, Sampled]]:
        """The segmentations of texts that are searched together, with the number of the first of these texts."""
        begin = size = 0
        for i, text in enumerate(texts):
            if i > begin and size + len(text) > GROUP_CHARS:
                yield begin, self._group(texts[begin:i], seeds[begin:i])
                begin, size = i, 0
            size += len(text)
        if begin < len(texts):
            yield begin, self._group(texts[begin:], seeds[begin:])

    def sample(self, texts: list[str], seeds: list[int]) -> Iterator[tuple[list[np.ndarray], list[tuple[float, float, float]]]]:
        """For each text its segmentations as id arrays, and (log-probability, perturbed value, log inclusion) of each."""
        for _, found in self.groups(texts, seeds):
            arrays = np.split(found.ids, found.offsets[1:-1])
            facts = list(zip(found.log_prob.tolist(), found.value.tolist(), found.inclusion.tolist(), strict=True))
            for a, b in itertools.pairwise(np.searchsorted(found.text, np.arange(int(found.text[-1]) + 2)).tolist()):
                yield arrays[a:b], facts[a:b]

    @staticmethod
    def _words(norm: str) -> list[str]:
        """Keys of a text's words: the word without its first space mark, or, if it has none, with a mark at its end."""
        head, *parts = norm.split(SPACE) if norm else [""]
        if "" in parts:  # a run of spaces belongs to the word after it
            spaced, held = parts, ""
            parts = []
            for x in spaced[:-1]:
                if x:
                    parts.append(held + x)
                    held = ""
                else:
                    held += SPACE
            parts.append(held + spaced[-1])
        return [head + SPACE, *parts] if head else parts

    def _encoded_words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct keys, number of each word's key, words of each text)."""
        if self.model.plain:
            lists = pc.split_pattern(pa.array([t.replace(SPACE, " ") for t in texts], pa.large_string()), " ")
            words = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            # Words between single spaces are their own keys; texts with empty ones among them are cut in Python.
            empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
            odd = np.unique(np.searchsorted(np.cumsum(counts), empty, side="right"))
        else:
            words, counts, odd = pa.array([], pa.large_string()), np.zeros(len(texts), np.int64), np.arange(len(texts))
        if len(odd):
            held = [self._words(self.model.normalize(texts[i])) for i in odd.tolist()]
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            owner = np.repeat(np.arange(len(texts)), counts)
            words = pa.concat_arrays([words.filter(pa.array(plain[owner])), pa.array(list(itertools.chain.from_iterable(held)), pa.large_string())])
            counts = counts.copy()
            counts[odd] = [len(x) for x in held]
            owner = np.concatenate([owner[plain[owner]], np.repeat(odd, counts[odd])])
            order = np.argsort(owner, kind="stable")
        encoded = words.dictionary_encode()
        codes = encoded.indices.to_numpy()
        return encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), codes[order] if len(odd) else codes, counts

    def _group(self, texts: list[str], seed_list: list[int]) -> Sampled:
        lat, k = self.lattices, self.k
        unique, codes, counts = self._encoded_words(texts)
        missing = [w for w in unique if w not in lat.first]
        if lat.n_nodes + sum(map(len, missing)) + 2 * len(missing) > CACHE_NODES:
            lat.clear()
            missing = unique
        if missing:
            lat.add(missing)
        keys, ends, ids, logs, starts, held = lat.arrays()
        n_docs = len(texts)
        seeds = np.array([s & 0xFFFFFFFFFFFFFFFF for s in seed_list], np.uint64)
        node = np.fromiter(map(lat.first.__getitem__, unique), np.int64, len(unique))[codes]
        size = lat.length[node].astype(np.int64)
        word_at = np.concatenate([[0], np.cumsum(size)])  # place of each word in the group's characters
        doc_of_word = np.repeat(np.arange(n_docs), counts)
        doc_at = np.concatenate([[0], np.cumsum(np.bincount(doc_of_word, size, n_docs).astype(np.int64))])
        total = int(word_at[-1])
        shift = word_at[:-1] - node  # place = node + shift within a word

        def walk(at: np.ndarray, move: np.ndarray, doc: np.ndarray, draw: int, edge_at: np.ndarray) -> None:
            """Draws edges from the nodes ``at`` to their words' ends and notes each at its place."""
            live = np.flatnonzero(held[at])
            at, move, doc = at[live], move[live], doc[live]
            start = shifted(draws(seeds, draw)[doc], move - doc_at[doc])
            while len(at):
                key = uniform(start, at)
                e = starts[at]
                more = np.flatnonzero(keys[e] <= key)
                while len(more):  # nodes have few edges, so stepping through them beats a search of all keys
                    e[more] += 1
                    more = more[keys[e[more]] <= key[more]]
                edge_at[at + move] = e
                at = ends[e]
                live = np.flatnonzero(held[at])
                at, move, start = at[live], move[live], start[live]

        docs = np.arange(n_docs)
        zero = np.zeros(n_docs, np.int64)
        edge_at = np.full(total, _NONE, np.int32)
        walk(node, shift, doc_of_word, 0, edge_at)
        top = -np.log(-np.log(uniform(draws(seeds, 10_000), zero)))
        paths: list[dict[str, Any]] = [self._path(edge_at, top, docs, doc_at, seeds, 1, logs, None)]
        values: list[np.ndarray] = [top]
        bound = np.full(n_docs, -np.inf)
        for j in range(1, k + 1):
            # The best set that is still open, over all paths drawn so far.
            bests = np.stack([p["best"] for p in paths])
            source = bests.argmax(axis=0)
            bound = bests.max(axis=0)
            if j == k:
                break
            open_docs = np.flatnonzero(~np.isneginf(bound))
            edge_new = np.full(total, _NONE, np.int32)
            left_word = np.full(n_docs, len(node), np.int64)
            begin = np.full(n_docs, total + 1, np.int64)
            first = [np.zeros(0, np.int64)] * 3
            for path in (paths[s] for s in np.unique(source[open_docs]).tolist()):
                who = open_docs[[paths[s] is path for s in source[open_docs].tolist()]]
                place = path["where"][who]
                w = np.searchsorted(word_at, place, side="right") - 1
                n = place - shift[w]
                size_n = held[n].astype(np.int64)
                heads = np.cumsum(size_n) - size_n
                owner = np.repeat(np.arange(len(who)), size_n)
                edges = np.arange(int(size_n.sum())) - heads[owner] + starts[n][owner]
                mark = place[owner] * len(ids) + edges  # a branch of the path, as one number
                free = (edges != path["edge_at"][place][owner]) & ~np.isin(mark, path["taken"])
                share = np.where(free, np.exp(logs[edges].astype(np.float64)), 0.0)
                share_all = np.add.reduceat(share, heads)
                share /= share_all[owner]
                run = np.cumsum(share) - np.arange(len(who))[owner]  # each node's shares end at about 1
                u = uniform(draws(seeds[who], 20_000 + j), place - doc_at[who])
                behind = np.where(free & (run > u[owner]), np.arange(len(edges)), len(edges))
                ahead = np.where(free, np.arange(len(edges)), -1)
                pick = np.minimum(np.minimum.reduceat(behind, heads), np.maximum.reduceat(ahead, heads))
                e = edges[pick]
                path["taken"] = np.append(path["taken"], mark[pick])
                # What remains of the set keeps its place in the queue with a smaller value.
                share[pick] = 0.0
                i = path["index"](place)
                with np.errstate(divide="ignore"):
                    mass = path["before"][i] + np.log(share_all) + np.log(np.add.reduceat(share, heads))
                path["value"][i] = truncated_gumbel(mass, bound[who], uniform(draws(seeds[who], 30_000 + j), place - doc_at[who]))
                path["refresh"]()
                same = np.zeros(total + 1, np.int32)  # the new path runs along the old one up to its branch
                np.add.at(same, doc_at[who], 1)
                np.add.at(same, place, -1)
                same = np.flatnonzero(np.cumsum(same[:-1]))
                edge_new[same] = path["edge_at"][same]
                edge_new[place] = e
                begin[who], left_word[who] = place, w
                first = [np.concatenate(x) for x in zip(first, (ends[e], shift[w], who), strict=True)]
            rest = np.flatnonzero(np.arange(len(node)) > left_word[doc_of_word])  # words after the one it leaves in
            walk(*(np.concatenate(x) for x in zip(first, (node[rest], shift[rest], doc_of_word[rest]), strict=True)), j, edge_new)
            path = self._path(edge_new, bound, docs, doc_at, seeds, 1 + j, logs, begin)
            paths.append(path)
            values.append(bound)
        return self._emit(paths, values, bound, ids)

    def _path(self, edge_at: np.ndarray, top: np.ndarray, docs: np.ndarray, doc_at: np.ndarray, seeds: np.ndarray, draw: int, logs: np.ndarray, begin: np.ndarray | None, depth: float = DEPTH) -> dict[str, Any]:
        """The sets that leave a drawn path at each of its edges, after ``begin``, with their perturbed values.

        A Gumbel variable made of these uniform numbers exceeds its location by less than HIGHEST. Sets deeper than
        ``depth`` therefore need no value where enough others lie above ``HIGHEST - depth``; else all get one.
        """
        place = np.flatnonzero(edge_at >= 0)
        share = logs[edge_at[place]].astype(np.float64)
        first = np.searchsorted(place, doc_at)  # of each document, and the end
        counts = np.diff(first)
        run = np.concatenate([[0.0], np.cumsum(share)])
        log_prob = run[first[1:]] - run[first[:-1]]
        before = run[:-1] - np.repeat(run[first[:-1]], counts)
        near = np.flatnonzero(before > -depth)
        at, before, share = place[near], before[near], share[near]
        bounds = np.searchsorted(near, first)
        held = np.diff(bounds)
        doc = np.repeat(docs, held)
        with np.errstate(divide="ignore"):
            mass = before + np.log(-np.expm1(np.minimum(share, 0.0)))
        if begin is not None:
            mass[at <= begin[doc]] = -np.inf  # these sets belong to the path it has left
        value = truncated_gumbel(mass, top[doc], uniform(draws(seeds, 40_000 + draw)[doc], at - doc_at[doc]))
        high = np.bincount(doc, value > HIGHEST - depth, len(docs))
        if ((held < counts) & (high <= self.k) & ~np.isneginf(top)).any():
            return self._path(edge_at, top, docs, doc_at, seeds, draw, logs, begin, math.inf)
        best, where = np.full(len(docs), -np.inf), np.zeros(len(docs), np.int64)
        some = np.flatnonzero(held)

        def refresh() -> None:
            """The largest value of each document, and where it is."""
            if len(some):
                best[some] = np.maximum.reduceat(value, bounds[some])
                hit = np.flatnonzero(value == best[doc])[::-1]
                where[doc[hit]] = at[hit]  # of equal ones the first

        refresh()
        index = lambda p: np.searchsorted(at, p)
        return {"edge_at": edge_at, "value": value, "before": before, "best": best, "where": where, "taken": np.zeros(0, np.int64), "refresh": refresh, "index": index, "log_prob": log_prob, "place": place, "first": first}

    def _emit(self, paths: list[dict[str, Any]], values: list[np.ndarray], bound: np.ndarray, ids: np.ndarray) -> Sampled:
        flat = []
        for path in paths:
            first, found = path["first"], ids[path["edge_at"][path["place"]]]
            odd = np.flatnonzero(found < 0)
            if len(odd):  # runs of bytes
                runs = [self.lattices.byte_runs[-2 - x] for x in found[odd].tolist()]
                sizes = np.ones(len(found), np.int64)
                sizes[odd] = [len(r) for r in runs]
                grown = np.concatenate([[0], np.cumsum(sizes)])
                found = np.repeat(found, sizes)
                starts = np.repeat(grown[odd], sizes[odd])
                step = np.arange(len(starts)) - np.repeat(np.cumsum(sizes[odd]) - sizes[odd], sizes[odd])
                found[starts + step] = list(itertools.chain.from_iterable(runs))
                first = grown[first]
            flat.append((found, first))
        value = np.stack(values, axis=1)
        drawn = ~np.isneginf(value)
        text, sample = np.nonzero(drawn)
        size = np.stack([np.diff(first) for _, first in flat], axis=1)[text, sample]
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(offsets[-1]), np.int32)
        for s, (found, first) in enumerate(flat):
            mine = np.flatnonzero(sample == s)
            at = np.flatnonzero(np.repeat(drawn[:, s], np.diff(first)))
            out[at + np.repeat(offsets[mine] - first[text[mine]], size[mine])] = found[at]
        log_prob = np.minimum(np.stack([p["log_prob"] for p in paths], axis=1)[text, sample], 0.0)
        # P(a path's perturbed value exceeds the largest that was not drawn); sure if all were drawn.
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            above = log_prob - bound[text]
            inclusion = np.where(np.isneginf(bound[text]), 0.0, np.where(above > -30, np.log(-np.expm1(-np.exp(above))), above))
        return Sampled(text, sample, offsets, out, log_prob, value[text, sample], inclusion)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()),
    T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType()), T.StructField("round_trip", T.BooleanType()),
])


def sample_pieces(docs: DataFrame, model_path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct segmentations of every text, most favoured first, as one row each.

    Columns: doc_id, sample (from 0), ids, n_pieces, log_prob, perturbed, log_inclusion (log-probability that a draw of
    this size holds the segmentation) and round_trip (decoding the ids gives the text). A text with fewer than k
    segmentations gives them all; a null or empty text gives one empty segmentation. The draw depends on the id and
    ``seed``: repeated rows repeat their samples. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    keyed = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), keyed.alias("seed"))
    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_path, k, alpha)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, found in sampler.groups(texts, batch.column(2).to_pylist()):
                yield _result(sampler, batch.column(0), texts, begin, found, arrow)

    return rows.mapInArrow(run, SCHEMA)


@functools.cache
def _sampler(path: str, k: int, alpha: float) -> Sampler:
    """One sampler for all tasks of a worker, so that its lattices are built once."""
    return Sampler(path, k, alpha)


def _result(sampler: Sampler, keys: pa.Array, texts: list[str], begin: int, found: Sampled, arrow: pa.Schema) -> pa.RecordBatch:
    row = found.text + begin
    ids = pa.array(found.ids, pa.int32())
    same = [t == texts[i] for t, i in zip(sampler.model.decode(ids, found.offsets), row.tolist(), strict=True)]
    columns = [
        pc.take(keys, pa.array(row)), pa.array(found.sample), pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), ids), pa.array(np.diff(found.offsets)),
        *[pa.array(x) for x in (found.log_prob, found.value, found.inclusion)], pa.array(same, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text that each array of ids stands for; null arrays give null, empty ones an empty text."""
    held: list[PieceModel] = []

    def decode(ids: pa.Array) -> pa.Array:
        if not held:
            held.append(PieceModel(model_path))
        lists = ids.to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
        texts = held[0].decode(pa.array([i for x in lists for i in x or ()], pa.int32()), offsets)
        return pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())

    from tessera.llm.common import arrow_column

    return encoded.withColumn(out_col, arrow_column(decode, "string", F.col(ids_col)))
