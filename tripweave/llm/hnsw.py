"""Hierarchical navigable small-world graphs over unit vectors, for many queries at a time.

All queries of a block walk in step: each round expands the best candidates of every query
that has some left, with one gather and one product for all of them.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np

NEIGHBOURS = 12
BUILD_BEAM = 40
EXPAND = 4
BLOCK = 256
FIRST = 64
CELLS = 500_000
AUDIT_QUERIES = 64
AUDIT_RECALL = 0.995
BEAM = 32
WALK = 2048


class Graph(NamedTuple):
    """Unit vectors in rows, each layer's nodes and their neighbours (-1: none), bottom first.

    Layers above the bottom hold a geometrically falling part of the nodes; the last node
    list's first node is the entry.
    """

    vectors: np.ndarray
    nodes: list[np.ndarray]
    links: list[np.ndarray]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"n{i}": x for i, x in enumerate(self.nodes)},
                 **{f"l{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as held:
            layers = sum(name.startswith("n") for name in held.files)
            return Graph(held["vectors"], [held[f"n{i}"] for i in range(layers)], [held[f"l{i}"] for i in range(layers)])


def _likeness(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of each query with the vectors of its row of ids; -2 for missing ones."""
    found = np.matmul(vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
    return np.where(ids >= 0, found, -2.0)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the best `beam` nodes met on the way, best first (-1: fewer met).

    `entries` has the first nodes of each query in a row. A query ends once all nodes of its
    beam are expanded.
    """
    count = len(queries)
    seen = np.zeros((count, len(vectors) + 1), bool)  # the last column takes missing ids
    width = max(beam, entries.shape[1])
    ids, sims = np.full((count, width), -1, np.int64), np.full((count, width), -2.0)
    ids[:, :entries.shape[1]] = entries
    sims[:, :entries.shape[1]] = _likeness(vectors, entries, queries)
    seen[np.arange(count)[:, None], entries] = True
    expanded = np.zeros((count, width), bool)
    active = np.arange(count)
    while len(active):
        open_ = np.where(expanded[active] | (ids[active] < 0), -3.0, sims[active])
        pick = np.argpartition(-open_, min(EXPAND, width) - 1, axis=1)[:, :EXPAND] if width > EXPAND else np.tile(
            np.arange(width), (len(active), 1))
        usable = np.take_along_axis(open_, pick, 1) > -3.0
        going = usable.any(axis=1)
        active, pick, usable = active[going], pick[going], usable[going]
        if not len(active):
            break
        row = active[:, None]
        chosen = np.where(usable, ids[row, pick], -1)
        marks = expanded[row, pick] | usable
        expanded[row, pick] = marks
        near = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # met twice in one round
        near = np.where(seen[row, near], -1, near)
        seen[row, near] = True
        seen[:, -1] = False
        likeness = _likeness(vectors, near, queries[active])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], likeness], axis=1)
        all_done = np.concatenate([expanded[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        expanded[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread_out(vectors: np.ndarray, centres: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the centre than to any chosen
    before, at most `most`; then the nearest of the rest, so that a tight group keeps a way out
    and every node its full number of neighbours. Padded with -1."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    held = vectors[np.maximum(ids, 0)]
    mutual = np.matmul(held, held.transpose(0, 2, 1))
    taken = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        nearest_taken = np.where(taken, mutual[:, c, :], -2.0).max(axis=1)
        good = (ids[:, c] >= 0) & (nearest_taken < sims[:, c]) & (count < most)
        taken[:, c] = good
        count += good
    rank = np.where(taken, 0, 1) * ids.shape[1] + np.arange(ids.shape[1]) + np.where(ids < 0, 10 * ids.shape[1], 0)
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, best, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
    return out


def _connect(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Gives new nodes their neighbours and adds the way back, thinning lists that overflow."""
    most = links.shape[1]
    links[new] = _spread_out(vectors, vectors[new], ids, sims, most)
    source = np.repeat(new, most)
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, counts = np.unique(target, return_index=True, return_counts=True)
    by_count = np.argsort(counts, kind="stable")
    touched, first, counts = touched[by_count], first[by_count], counts[by_count]
    start = 0
    while start < len(touched):  # lists of like length together, fewer of the long ones
        rows = max(1, CELLS // (most + int(counts[start])) ** 2)
        end = start + int(np.searchsorted(counts[start:start + rows], 2 * counts[start] + 4))
        part = slice(start, end)
        column = np.arange(int(counts[end - 1]))[None, :]
        at = np.minimum(first[part][:, None] + column, len(source) - 1)
        added = np.where(column < counts[part][:, None], source[at], -1)
        row = touched[part]
        added = np.where((added[:, :, None] == links[row][:, None, :]).any(axis=2), -1, added)
        both = np.concatenate([links[row], added], axis=1)
        links[row] = _spread_out(vectors, vectors[row], both, _likeness(vectors, both, vectors[row]), most)
        start = end


def _layer(vectors: np.ndarray, most: int, entries: np.ndarray | None) -> np.ndarray:
    """Neighbours of all rows of one layer. Rows come in batches that at most double the
    layer; a batch searches the rows before it and is compared with itself."""
    count = len(vectors)
    links = np.full((count, most), -1, np.int64)
    done = min(FIRST, count)
    if done > 1:
        sims = vectors[:done] @ vectors[:done].T
        np.fill_diagonal(sims, -2.0)
        ids = np.where(sims > -2.0, np.arange(done)[None, :], -1)
        _connect(vectors, links, np.arange(done), ids, sims)
    while done < count:
        new = np.arange(done, min(count, done + min(BLOCK, done)))
        start = entries[new] if entries is not None else np.zeros((len(new), 1), np.int64)
        start = np.where(start < done, start, 0)
        ids, sims = beam_search(vectors[:done], links[:done], vectors[new], start, BUILD_BEAM)
        own = vectors[new] @ vectors[new].T
        np.fill_diagonal(own, -2.0)
        keep = min(most, len(new))
        near = np.argpartition(-own, keep - 1, axis=1)[:, :keep]
        near_sims = np.take_along_axis(own, near, 1)
        ids = np.concatenate([ids, np.where(near_sims > -2.0, new[near], -1)], axis=1)
        _connect(vectors, links, new, ids, np.concatenate([sims, near_sims], axis=1))
        done = int(new[-1]) + 1
    return links


def build(vectors: np.ndarray) -> Graph:
    """The graph of unit vectors. Layers are built from the top, each with the one above as
    its way in. Row order decides the layers, so equal input gives equal graphs."""
    count = len(vectors)
    sizes = [count]
    while sizes[-1] > 4 * NEIGHBOURS:
        sizes.append(-(-sizes[-1] // NEIGHBOURS))
    order = np.random.default_rng(count).permutation(count)
    nodes, links = [], []
    for size in reversed(sizes):
        here = order[:size]
        most = 2 * NEIGHBOURS if size == count else NEIGHBOURS
        entries = None
        if nodes:  # nodes of the layer above come first here, in the same order
            entries = _descend(vectors, nodes, links, vectors[here])[:, None]
        links.append(_layer(vectors[here], most, entries))
        nodes.append(here)
    bottom = np.full_like(links[-1], -1)
    bottom[order] = np.where(links[-1] >= 0, order[np.maximum(links[-1], 0)], -1)
    links[-1], nodes[-1] = bottom, np.arange(count)
    return Graph(vectors, nodes[::-1], links[::-1])


def _descend(vectors: np.ndarray, nodes: list, links: list, queries: np.ndarray) -> np.ndarray:
    """Nearest node found in the lowest of the given layers (top first), as a place in it."""
    out = np.zeros(len(queries), np.int64)
    for start in range(0, len(queries), BLOCK):
        part = queries[start:start + BLOCK]
        at = np.zeros((len(part), 1), np.int64)
        for here, near in zip(nodes, links):  # a place in one layer is the same place in the next
            at = beam_search(vectors[here], near, part, at, 4)[0][:, :1]
        out[start:start + BLOCK] = at[:, 0]
    return out


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the best nodes found for each query, best first."""
    if len(graph.nodes) > 1:
        places = _descend(graph.vectors, graph.nodes[:0:-1], graph.links[:0:-1], queries)
        entries = graph.nodes[1][places][:, None]
    else:
        entries = np.zeros((len(queries), 1), np.int64)
    return beam_search(graph.vectors, graph.links[0], queries, entries, beam)


def _widen(graph: Graph, queries: np.ndarray, least: float, found: np.ndarray) -> None:
    """Goes on from the near nodes found of each query to all near nodes that links reach, a
    bounded number of expansions at a time: a beam as wide as the query's group."""
    seen = np.concatenate([found, np.zeros((len(found), 1), bool)], axis=1)
    todo = found.copy()
    while True:
        query, node = np.nonzero(todo)
        if not len(query):
            return
        query, node = query[:WALK], node[:WALK]
        todo[query, node] = False
        near = graph.links[0][node]
        query, near = np.repeat(query, near.shape[1]), near.ravel()
        fresh = (near >= 0) & ~seen[query, near]
        query, near = query[fresh], near[fresh]
        seen[query, near] = True
        hit = np.einsum("md,md->m", graph.vectors[near], queries[query]) >= least
        found[query[hit], near[hit]] = True
        todo[query[hit], near[hit]] = True


def _fill_links(graph: Graph, queries: np.ndarray, least: float, beam: int, out: np.ndarray) -> None:
    """Marks the nodes found with at least the given cosine. A query whose whole beam is that
    near may have more, so it goes on through near nodes."""
    for start in range(0, len(queries), BLOCK):
        part = slice(start, start + BLOCK)
        ids, sims = search(graph, queries[part], beam)
        near = (sims >= least) & (ids >= 0)
        hit = np.nonzero(near)
        out[start + hit[0], ids[hit]] = True
        full = start + np.flatnonzero(near.all(axis=1))
        if len(full):
            found = out[full]
            _widen(graph, queries[full], least, found)
            out[full] = found


def _recall(other: Graph, queries: np.ndarray, found: np.ndarray, audit: np.ndarray, least: float) -> float:
    """The mean over audited rows that have links of the share of them found; 1 if none has any."""
    truth = queries[audit] @ other.vectors.T >= least
    counts = truth.sum(1)
    rows = counts > 0
    return float(((found[audit] & truth).sum(1)[rows] / counts[rows]).mean()) if rows.any() else 1.0


def _planted_recall(graph: Graph, audit: np.ndarray, least: float, beam: int) -> float:
    """The share of vectors planted near audited nodes, at a cosine just above `least`, from which a
    search finds a node as near as that. It tells how links are found also where the audited vectors have none."""
    own = graph.vectors[audit]
    aside = np.random.default_rng(len(audit)).normal(size=own.shape)
    aside -= np.einsum("nd,nd->n", aside, own)[:, None] * own
    length = np.sqrt((aside * aside).sum(1, keepdims=True))
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    cosine = least + (1 - least) / 20
    planted = cosine * own + np.sqrt(1 - cosine * cosine) * aside
    planted /= np.sqrt((planted * planted).sum(1, keepdims=True))
    nearest = search(graph, planted, beam)[1][:, 0]  # in a dense place another node may be nearer
    return float((nearest >= np.einsum("nd,nd->n", planted, own) - 1e-9).mean())


def near_matrix(one: Graph, two: Graph | None, least: float) -> tuple[np.ndarray, float]:
    """Which nodes of two graphs (or of one with itself) are found within `least` of each
    other, and the recall of the last audit.

    Each graph is searched for all vectors of the other; a pair found from either side
    counts. Some vectors, evenly spaced, and some of those with links and of their partners are then
    compared with every node, each row for itself, so that a hot group can't hide small ones; and some
    nodes are searched from vectors planted near them. While too few true links or planted nodes are found,
    all beams are doubled; once a beam holds the whole graph and fails, all pairs are compared, block by block.
    """
    other = two or one
    out = np.zeros((len(one.vectors), len(other.vectors)), bool)
    back = np.zeros((len(other.vectors), len(one.vectors)), bool) if two else None
    spaced = lambda rows: rows[np.unique(np.linspace(0, len(rows) - 1, min(AUDIT_QUERIES, len(rows))).astype(np.int64))]
    beam = BEAM
    while True:
        _fill_links(other, one.vectors, least, beam, out)
        if two:
            _fill_links(one, two.vectors, least, beam, back)
        out |= back.T if two else out.T.copy()
        linked = out.copy() if two else out & ~np.eye(len(out), dtype=bool)
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        audit = np.concatenate([spaced(np.arange(len(out))), *([spaced(rows)] if len(rows) else [])])
        recall = min(_recall(other, one.vectors, out, audit, least),
                     _planted_recall(one, spaced(np.arange(len(out))), least, beam))
        if two:
            recall = min(recall, _planted_recall(two, spaced(np.arange(out.shape[1])), least, beam))
            if len(columns):
                recall = min(recall, _recall(one, two.vectors, out.T, spaced(columns), least))
        if recall >= AUDIT_RECALL:
            return out, recall
        beam *= 2
        if beam >= 2 * len(other.vectors):
            break
    for start in range(0, len(out), BLOCK):
        out[start:start + BLOCK] = one.vectors[start:start + BLOCK] @ other.vectors.T >= least
    return out, 1.0
