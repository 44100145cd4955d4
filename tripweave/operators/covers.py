"""Scores of documents from the places of query words, each document inside one task.

A document's hits are swept once: occurrences of items, intervals that hold all items of a
group, and the minimal ones of those. Only the best rows of each query leave a task, so what is
shuffled does not depend on how often words occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

COVER_WEIGHT = 0.1
#: Results are in order of the relevance rounded to so many decimals.
RANK_DECIMALS = 6
#: Rows of a task that wait before they are cut to the best of each query.
WAITING_ROWS = 1 << 16
HIT_COLUMNS = ("grp", "item", "off", "words", "needed", "pos", "minus", "simple", "ranked")


def sweep(hits: list[tuple]) -> tuple[float, bool, set, bool]:
    """Relevance and match of one document for one query, the groups with a minus item, and whether
    any group has all its plain items.

    A hit is (grp, item, off, words, needed, pos, minus, simple, ranked). A phrase occurs where all its
    words stand at their distance from one start. For each end, the latest start of every item up to
    it gives the shortest interval; intervals that hold another one don't count.
    """
    numbers = {pos: n for n, pos in enumerate(sorted({hit[5] for hit in hits if hit[8]}))}
    places: dict[tuple, list[int]] = {}
    for grp, item, off, words, needed, pos, minus, _, ranked in hits:
        places.setdefault((grp, minus, item, words, needed, ranked, pos - off), []).append(pos)
    groups: dict[int, dict] = {}
    barred = set()
    for (grp, minus, item, words, needed, ranked, _), found in places.items():
        if len(found) == words:
            if minus:
                barred.add(grp)
            else:
                groups.setdefault(grp, {"needed": needed, "items": {}, "all": []})["items"].setdefault(item, None)
                groups[grp]["all"].append((max(found), min(found), item, ranked))
    covers: dict[int, list] = {}  # by start: nearest end, match, rank
    for grp, group in groups.items():
        if len(group["items"]) != group["needed"]:
            continue
        opened = dict.fromkeys(group["items"], -1)
        ends = sorted(group["all"])
        for n, (last, first, item, ranked) in enumerate(ends):
            opened[item] = max(opened[item], first)
            if n + 1 < len(ends) and ends[n + 1][0] == last:
                continue  # all items that end here come first
            start = min(opened.values())
            if start >= 0:
                known = covers.get(start)
                if known is None:
                    covers[start] = [last, grp not in barred, ranked]
                else:
                    covers[start] = [min(known[0], last), known[1] or grp not in barred, known[2] or ranked]
    relevance, matched, nearest = 0.0, False, None
    for start in sorted(covers, reverse=True):
        last, match, ranked = covers[start]
        matched |= match
        if ranked and (nearest is None or nearest > last):
            relevance += COVER_WEIGHT / (1 + (last - start) - (numbers[last] - numbers[start]))
        nearest = last if nearest is None else min(nearest, last)
    return relevance, matched, barred, bool(covers)


def _order(values: list) -> np.ndarray:
    """The place of each value in rising order, nulls first."""
    place = {value: n for n, value in enumerate(sorted(set(values), key=lambda v: (v is not None, v)))}
    return np.array([place[value] for value in values], np.int64)


def _rounded(relevance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The relevance as results are ordered by it, as whole numbers, and where it lies so near the middle of two that it may be either."""
    scaled = relevance * 10.0 ** RANK_DECIMALS + 0.5
    return np.floor(scaled), np.abs(scaled - np.rint(scaled)) < 1e-4


def _best_of_all(scored: Iterator[pa.RecordBatch], doc_id: str, query_id: str, best: int, whole: set) -> Iterator[pa.RecordBatch]:
    """The first rows of each query over all of a task's; all of those in `whole`, and those whose order isn't sure."""
    held: list[pa.RecordBatch] = []
    waiting, most = 0, WAITING_ROWS

    def cut() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table.append_column("_order", pa.array(_rounded(table.column("relevance").to_numpy())[0])), [
            (query_id, "ascending"), ("_order", "descending"), ("name", "ascending"), (doc_id, "ascending")], null_placement="at_start")
        table = table.take(order)
        query = table.column(query_id).combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        return table.filter(pa.array(place < best)).combine_chunks().to_batches()[0]

    for made in scored:
        unsure = _rounded(made.column("relevance").to_numpy())[1]
        apart = pa.array(unsure | np.array([known in whole for known in made.column(query_id).to_pylist()], bool))
        yield made.filter(apart)
        rest = made.filter(pc.invert(apart))
        held.append(rest)
        waiting += rest.num_rows
        if waiting >= most:
            held = [cut()]
            waiting = held[0].num_rows
            most = max(WAITING_ROWS, 2 * waiting)
    if waiting:
        yield cut()


class Scored:
    """Scores of the documents of one piece of the hits, as arrays over (query, document)."""

    def __init__(self, table: pa.Table, doc_id: str, query_id: str, anywhere: dict):
        docs = table.column(doc_id).combine_chunks().dictionary_encode()
        queries = table.column(query_id).combine_chunks().dictionary_encode()
        self.doc_ids, self.query_ids = docs.dictionary.to_pylist(), queries.dictionary.to_pylist()
        doc = docs.indices.to_numpy()
        query = queries.indices.fill_null(-1).to_numpy()
        self.names: list = [None] * len(self.doc_ids)
        for at in np.flatnonzero(query < 0).tolist():  # the row that every document has
            self.names[doc[at]] = table.column("name")[at].as_py()
        for known in anywhere:
            if known not in self.query_ids:
                self.query_ids.append(known)
        columns = {name: table.column(name).to_numpy() for name in HIT_COLUMNS}
        self.n = len(self.query_ids)
        pair = doc.astype(np.int64) * self.n + query
        self.pairs: list[np.ndarray] = []
        self.barred: list[tuple[int, int]] = []  # pair and group
        self._count(pair, columns, (query >= 0) & columns["simple"])
        self._sweep(pair, columns, (query >= 0) & ~columns["simple"])
        self.pair, self.relevance, self.matched = (np.concatenate(x) for x in zip(*self.pairs))
        self._anywhere(anywhere)

    def _count(self, pair: np.ndarray, columns: dict, rows: np.ndarray) -> None:
        """Queries in which one word is enough: every place of a word is a cover of its own."""
        group = columns["grp"][rows].astype(np.int64)
        width = int(group.max(initial=0)) + 1
        keys, which = np.unique(pair[rows] * width + group, return_inverse=True)
        minus = np.bincount(which, columns["minus"][rows], len(keys)) > 0
        plain = np.bincount(which, ~columns["minus"][rows], len(keys)) > 0
        places = np.bincount(which, columns["ranked"][rows], len(keys))
        self.barred += zip((keys[minus] // width).tolist(), (keys[minus] % width).tolist())
        pairs, which = np.unique(keys[plain] // width, return_inverse=True)
        self.pairs.append((pairs, COVER_WEIGHT * np.bincount(which, places[plain], len(pairs)),
                           np.bincount(which, ~minus[plain], len(pairs)) > 0))

    def _sweep(self, pair: np.ndarray, columns: dict, rows: np.ndarray) -> None:
        at = np.flatnonzero(rows)
        at = at[np.argsort(pair[at], kind="stable")]
        own = pair[at]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(at) else np.zeros(0, np.int64)
        hits = list(zip(*[columns[name][at].tolist() for name in HIT_COLUMNS]))
        found = []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            relevance, matched, barred, whole = sweep(hits[start:stop])
            self.barred += [(int(own[start]), grp) for grp in barred]
            if whole:
                found.append((own[start], relevance, matched))
        self.pairs.append(tuple(np.array([row[i] for row in found], kind) for i, kind in enumerate((np.int64, float, bool))))

    def _anywhere(self, anywhere: dict) -> None:
        """Groups of minus items alone match every document that has none of these."""
        if not anywhere:
            return
        barred: dict[tuple[int, int], set] = {}
        for pair, grp in self.barred:
            barred.setdefault((pair % self.n, grp), set()).add(pair // self.n)
        more = []
        for known, groups in anywhere.items():
            query = self.query_ids.index(known)
            free = np.zeros(len(self.doc_ids), bool)
            for grp in groups:
                own = np.ones(len(self.doc_ids), bool)
                own[list(barred.get((query, grp), ()))] = False
                free |= own
            more.append(np.flatnonzero(free) * self.n + query)
        also = np.concatenate(more)
        self.matched |= np.isin(self.pair, also)
        also = np.setdiff1d(also, self.pair)
        self.pair = np.append(self.pair, also)
        self.relevance = np.append(self.relevance, np.zeros(len(also)))
        self.matched = np.append(self.matched, np.ones(len(also), bool))

    def rows(self, best: int | None, whole: set) -> list[list]:
        """query, document, name, match and relevance: all, or of each query that is not in `whole` the
        first `best` matches by relevance, name and id."""
        query, doc = self.pair % self.n, self.pair // self.n
        kept = np.arange(len(self.pair))
        if best is not None:
            names, ids = _order(self.names), _order(self.doc_ids)
            relevance, unsure = _rounded(self.relevance)
            order = np.lexsort((ids[doc], names[doc], -relevance, ~self.matched, query))
            first = np.append(True, query[order][1:] != query[order][:-1]) if len(order) else np.zeros(0, bool)
            starts = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            all_of = np.array([known in whole for known in self.query_ids], bool)
            kept = order[(((np.arange(len(order)) - starts < best) | unsure[order]) & self.matched[order]) | all_of[query[order]]]
        return [[self.query_ids[q] for q in query[kept]], [self.doc_ids[d] for d in doc[kept]],
                [self.names[d] for d in doc[kept]], self.matched[kept], self.relevance[kept]]


def score_hits(hits: DataFrame, doc_id: str, query_id: str, together: bool, anywhere: dict | None = None,
               best: int | None = None, whole: set | None = None) -> DataFrame:
    """query, document, name, matched and relevance (unrounded) of the hits.

    With `together` the hits of a document lie next to each other already, as where its text was
    split; else they are brought together by one shuffle. `anywhere` gives the groups of minus
    items alone by query; for them every document has a row without a query, which also carries the
    document's name. With `best` only the first rows of each query leave a task, and few whose order rounding decides.
    """
    rows = hits.select(doc_id, query_id, "name", *HIT_COLUMNS)
    if not together:
        rows = rows.repartition(doc_id).sortWithinPartitions(doc_id)
    schema = T.StructType([rows.schema[query_id], rows.schema[doc_id], rows.schema["name"],
                           T.StructField("matched", T.BooleanType()), T.StructField("relevance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    anywhere, whole = anywhere or {}, whole or set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = every(batches)
        return made if best is None else _best_of_all(made, doc_id, query_id, best, whole)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(table: pa.Table) -> pa.RecordBatch:
            made = Scored(table, doc_id, query_id, anywhere).rows(best, whole)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow)], schema=arrow)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column(doc_id)
            last, cut = keys[len(keys) - 1], len(keys) - 1
            while cut > 0 and keys[cut - 1] == last:
                cut -= 1
            if cut:
                yield scored(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield scored(held)

    return rows.mapInArrow(run, schema)
