"""A hierarchical navigable small-world graph over the unit vectors of one shard, in arrays, for many queries at a time.

Nodes enter in batches: the graph so far proposes neighbours by beam search, the batch itself by its own similarities.
A vector within a given angle of a node joins that node's ball instead of becoming a node, so that masses of near copies
neither fill the graph nor a beam.
"""

from __future__ import annotations

import io

import numpy as np

#: Neighbours of a node in upper layers and in the lowest one, beam of the construction, nodes opened in a step.
LINKS, BASE_LINKS, BUILD_BEAM, OPENED = 12, 24, 48, 4
#: Vectors of the first and of a later batch, and cells of the table of visited nodes.
FIRST_BATCH, BATCH, VISITED = 256, 1024, 16_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares of very large or small components leave the doubles."""
    v = vectors.astype(np.float64)
    v /= np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Layer:
    def __init__(self, size: int, links: int):
        self.place = np.full(size, -1, np.int32)  # of a node in this layer's table
        self.near = np.full((64, links), -1, np.int32)
        self.nodes = np.zeros(0, np.int32)

    def add(self, nodes: np.ndarray) -> None:
        self.place[nodes] = np.arange(len(self.nodes), len(self.nodes) + len(nodes))
        self.nodes = np.concatenate((self.nodes, nodes.astype(np.int32)))
        while len(self.near) < len(self.nodes):
            self.near = np.concatenate((self.near, np.full_like(self.near, -1)))


class Graph:
    """unit_vectors: float32 rows of length 1; salt: one number per row, from which its layer is drawn; join: cosine from
    which a vector joins a ball. center[i] is the node of row i's ball, i itself for nodes."""

    def __init__(self, unit_vectors: np.ndarray, salt: np.ndarray, join: float):
        self.v, self.join, n = unit_vectors, join, len(unit_vectors)
        self.center = np.full(n, -1, np.int32)
        draw = (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2.0**53
        self.level = np.minimum(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS), 8).astype(int)
        self.layers: list[Layer] = []
        at = 0
        while at < n:
            size = FIRST_BATCH if not at else min(BATCH, max(FIRST_BATCH, at // 4))
            self._insert(np.arange(at, min(n, at + size)))
            at += size

    def _insert(self, rows: np.ndarray) -> None:
        beams = self.descend(self.v[rows], BUILD_BEAM, lowest=0, keep=True) if self.layers else {}
        if beams:
            ids, sims = beams[0]
            inside = sims[:, 0] >= self.join
            self.center[rows[inside]] = ids[inside, 0]
            beams = {k: (i[~inside], s[~inside]) for k, (i, s) in beams.items()}
            rows = rows[~inside]
        among = self.v[rows] @ self.v[rows].T
        np.fill_diagonal(among, -2)
        is_node = np.ones(len(rows), bool)
        for i in np.flatnonzero((among >= self.join).any(axis=1)):
            first = np.flatnonzero((among[i, :i] >= self.join) & is_node[:i])
            if len(first):
                self.center[rows[i]], is_node[i] = rows[first[among[i, first].argmax()]], False
        new = np.flatnonzero(is_node)
        self.center[rows[new]] = rows[new]
        if not len(new):
            return
        top = int(self.level[rows[new]].max())
        for k in range(top + 1):
            if k == len(self.layers):
                self.layers.append(Layer(len(self.v), LINKS if k else BASE_LINKS))
            mine = new[self.level[rows[new]] >= k]
            layer, sims = self.layers[k], among[np.ix_(mine, mine)]
            take = min(BUILD_BEAM // 2, len(mine))
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            ids, near = rows[mine][best], np.take_along_axis(sims, best, axis=1)
            if k in beams:
                ids, near = np.concatenate((ids, beams[k][0][mine]), axis=1), np.concatenate((near, beams[k][1][mine]), axis=1)
            layer.add(rows[mine])
            chosen = self._varied(ids, near, layer.near.shape[1] // 2)
            layer.near[layer.place[rows[mine]], : chosen.shape[1]] = chosen
            self._link_back(layer, rows[mine], chosen)

    def _varied(self, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than to any chosen before; the nearest others
        fill what is left."""
        width = min(ids.shape[1], 3 * links)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        there = sims > -1.5
        there[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        x = self.v[np.maximum(ids, 0)]
        between = x @ x.transpose(0, 2, 1)
        chosen, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for j in range(width):
            hidden = (chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
            chosen[:, j] = there[:, j] & ~hidden & (count < links)
            count += chosen[:, j]
        rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :links]
        good = np.take_along_axis(there, rank, axis=1)
        return np.where(good, np.take_along_axis(ids, rank, axis=1), -1)

    def _link_back(self, layer: Layer, rows: np.ndarray, chosen: np.ndarray) -> None:
        """Add each row to the lists of those that it chose; full lists are chosen anew."""
        source, target = np.repeat(rows, chosen.shape[1]), chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        most = layer.near.shape[1]
        while len(target):
            first = np.concatenate(([True], target[1:] != target[:-1]))
            rank = np.arange(len(target)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            now = rank < most
            to, row = np.unique(target[now], return_inverse=True)
            new = np.full((len(to), most), -1, np.int32)
            new[row, rank[now]] = source[now]
            both = np.concatenate((layer.near[layer.place[to]], new), axis=1)
            full = (both >= 0).sum(axis=1) > most
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :most]
            if full.any():
                ids = both[full]
                sims = np.where(ids >= 0, np.einsum("id,ijd->ij", self.v[to[full]], self.v[np.maximum(ids, 0)]), -2)
                packed[full] = self._varied(ids, sims, most)
            layer.near[layer.place[to]] = packed
            source, target = source[~now], target[~now]

    def descend(self, queries: np.ndarray, beam: int, lowest: int = 0, keep: bool = False):
        """The nodes nearest to each query by beam search from the top layer: ids and cosines, nearest first.

        keep: those of every layer, as a dictionary.
        """
        entry, found = np.repeat(self.layers[-1].nodes[:1][None, :], len(queries), axis=0), {}
        for k in range(len(self.layers) - 1, lowest - 1, -1):
            ids, sims = self.beam(self.layers[k], queries, entry, beam if keep or k == lowest else 4)
            found[k], entry = (ids, sims), ids[:, :4]
        return found if keep else found[lowest]

    def beam(self, layer: Layer, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        width = max(1, min(width, len(layer.nodes)))
        step = max(1, VISITED // len(layer.nodes))
        parts = [self._beam(layer, queries[i : i + step], entry[i : i + step], width) for i in range(0, len(queries), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _beam(self, layer: Layer, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, e = len(q), min(width, entry.shape[1])
        ids, sims, fresh = np.full((n, width), -1, np.int32), np.full((n, width), -2, np.float32), np.zeros((n, width), bool)
        ids[:, :e] = entry[:, :e]
        there = entry[:, :e] >= 0
        sims[:, :e] = np.where(there, np.einsum("id,ijd->ij", q, self.v[np.maximum(entry[:, :e], 0)]), -2)
        fresh[:, :e] = there
        seen = np.zeros((n, len(layer.nodes)), bool)
        row, col = np.nonzero(there)
        seen[row, layer.place[ids[row, col]]] = True
        live = np.arange(n)
        while True:
            open_ = np.where(fresh[live], sims[live], -3)
            live, open_ = live[some := open_.max(axis=1) > -2.5], open_[some]
            if not len(live):
                break
            m = min(OPENED, width)
            best = np.argpartition(-open_, m - 1, axis=1)[:, :m] if m < width else np.argsort(-open_, axis=1)
            good = np.take_along_axis(open_, best, axis=1) > -2.5
            nodes = np.where(good, ids[live[:, None], best], -1)
            fresh[live[:, None], best] = False
            near = np.where((nodes >= 0)[:, :, None], layer.near[layer.place[np.maximum(nodes, 0)]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, col = np.nonzero(new)
            place = layer.place[near[row, col]]
            unseen = ~seen[live[row], place]
            row, col, place = row[unseen], col[unseen], place[unseen]
            seen[live[row], place] = True
            node = near[row, col]
            sim = np.einsum("ij,ij->i", q[live[row]], self.v[node])
            worst = sims[live].min(axis=1)
            better = sim > worst[row]
            row, node, sim = row[better], node[better], sim[better]
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(live))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more = np.full((len(live), count.max()), -1, np.int32), np.full((len(live), count.max()), -2, np.float32)
            more_ids[row, rank], more[row, rank] = node, sim
            all_ids, all_sims = np.concatenate((ids[live], more_ids), axis=1), np.concatenate((sims[live], more), axis=1)
            all_fresh = np.concatenate((fresh[live], more > -1.5), axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], fresh[live] = (np.take_along_axis(x, keep, axis=1) for x in (all_ids, all_sims, all_fresh))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all found pairs with a cosine of least or more. A beam full of such nodes is widened."""
        out, rows, widest = [], np.arange(len(queries)), len(self.layers[0].nodes)
        while len(rows):
            ids, sims = self.descend(queries[rows], beam)
            full = (sims[:, -1] >= least) & (beam < widest)
            row, col = np.nonzero((sims >= least) & ~full[:, None] & (ids >= 0))
            out.append(np.stack((rows[row], ids[row, col])))
            rows, beam = rows[full], 2 * beam
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), int)
        return pairs[0], pairs[1]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {"center": self.center} | {f"nodes{k}": x.nodes for k, x in enumerate(self.layers)} | {f"near{k}": x.near[: len(x.nodes)] for k, x in enumerate(self.layers)}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, unit_vectors: np.ndarray, data: bytes) -> Graph:
        arrays = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.v, self.center, self.layers = unit_vectors, arrays["center"], []
        for k in range(sum(name.startswith("nodes") for name in arrays.files)):
            layer = Layer(len(unit_vectors), arrays[f"near{k}"].shape[1])
            layer.near = arrays[f"near{k}"]
            layer.nodes = arrays[f"nodes{k}"]
            layer.place[layer.nodes] = np.arange(len(layer.nodes))
            self.layers.append(layer)
        return self


def audited_beam(graph: Graph, least: float, link: float, beam: int, target: float, sample: int) -> int:
    """The beam, doubled from the given one until an audit passes: of all rows that a full comparison links with sampled
    queries, at least target are in balls that the search finds. Queries are rows, and rows turned to the edge of a link."""
    rng, n = np.random.default_rng(len(graph.v)), len(graph.v)
    own = graph.v[rng.permutation(n)[:sample]]
    aside = rng.normal(size=own.shape).astype(np.float32)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    edge = (link + 1e-4) * own + np.sqrt(max(0.0, 1 - (link + 1e-4) ** 2)) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 0)
    queries = np.concatenate((own, edge)).astype(np.float32)
    linked = queries @ graph.v.T >= link
    widest = len(graph.layers[0].nodes)
    while beam < widest:
        found = np.zeros((len(queries), n), bool)
        found[graph.within(queries, least, beam)] = True
        if (linked & found[:, graph.center]).sum() >= target * linked.sum():
            break
        beam *= 2
    return min(beam, widest)
