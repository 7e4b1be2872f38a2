"""Search for the words of many items in documents: each item's best documents by counts of its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text, and scores of documents by items, that a worker holds at once.
MOST_BYTES, MOST_SCORES = 1 << 20, 1 << 18
#: Rows of a document that are held before they become one.
MOST_ROWS = 256
#: Fixed value: a word counts so often at most.
MOST_TIMES = 5


class Terms:
    """Different words of items (item, word), numbered, with the items of each: those of term t are owners[starts[t] : starts[t + 1]]."""

    def __init__(self, pairs: list[tuple[object, bytes]], kind: DataType):
        self.kind = kind
        self.items = list(dict.fromkeys(item for item, _ in pairs))
        place = {item: i for i, item in enumerate(self.items)}
        owners: dict[bytes, list[int]] = {}
        for item, word in pairs:
            owners.setdefault(bytes(word), []).append(place[item])
        self.number = {word: t for t, word in enumerate(owners)}
        self.starts = np.cumsum([0, *map(len, owners.values())])
        self.owners = np.array([i for own in owners.values() for i in own], dtype=np.int64)


def counts(terms: Terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, terms, counts of batches (doc_id, words): how often each document has the terms; those without any go, and a doc_id may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.number
        for batch in batches:
            step = max(1, MOST_BYTES * len(batch) // max(1, batch.nbytes))
            for at in range(0, len(batch), step):
                found: dict[object, Counter] = {}
                for doc, words in zip(*[x.slice(at, step).to_pylist() for x in batch.columns]):
                    if words:
                        found.setdefault(doc, Counter()).update(words.split(b" "))
                known = {doc: own for doc, times in found.items() if (own := [(number[w], n) for w, n in times.items() if w in number])}
                numbers, times = ([[x[k] for x in own] for own in known.values()] for k in (0, 1))
                columns = [pa.array(list(known), batch.column(0).type), pa.array(numbers, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "terms", "counts"])

    return run


def _scores(terms: Terms, docs: np.ndarray, numbers: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Scores (document, item) of n documents from rows (document, term, count), which may repeat a document's term."""
    order = np.lexsort((numbers, docs))
    docs, numbers, times = docs[order], numbers[order], times[order]
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (numbers[1:] != numbers[:-1])])
    docs, numbers, times = docs[first], numbers[first], np.minimum(np.add.reduceat(times, first), MOST_TIMES)
    many = terms.starts[numbers + 1] - terms.starts[numbers]
    at = np.arange(many.sum()) + np.repeat(terms.starts[numbers] - np.r_[0, np.cumsum(many)[:-1]], many)
    key = np.repeat(docs, many) * len(terms.items) + terms.owners[at]
    return np.bincount(key, np.repeat(times, many), n * len(terms.items)).astype(np.int64).reshape(n, -1)


def best(terms: Terms, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """item_id, doc_id, score: of batches that counts() made, sorted by doc_id with nulls first, each item's best documents.

    Rows of one doc_id are one document. Of equal scores the least doc_id is better, and null is the worst.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, int, object]]] = [[] for _ in terms.items]  # an item's (-score, order of its document, doc_id)
        held: tuple[list, list, list] = ([], [], [])  # documents, and of each the arrays of terms and counts
        seen, kind = 0, None

        def score() -> None:
            nonlocal seen, held
            ids, numbers, times = held
            lengths = [sum(map(len, x)) for x in numbers]
            flat = [np.concatenate([y for x in part for y in x]).astype(np.int64) for part in (numbers, times)]
            found = _scores(terms, np.repeat(np.arange(len(ids)), lengths), *flat, len(ids))
            place = np.array([len(ids) if doc is None else i for i, doc in enumerate(ids)])
            rank = found * (len(ids) + 1) - place[:, None]  # by score, and then the first
            if len(ids) > most:
                top = np.argpartition(rank, len(ids) - most, axis=0)[len(ids) - most :]
            else:
                top = np.broadcast_to(np.arange(len(ids))[:, None], found.shape)
            for item in range(len(terms.items)):
                new = [(-int(found[i, item]), float("inf") if ids[i] is None else seen + int(i), ids[i]) for i in top[:, item] if found[i, item]]
                if new:
                    kept[item] = sorted(kept[item] + new, key=lambda x: x[:2])[:most]
            seen, held = seen + len(ids), ([], [], [])

        for batch in batches:
            kind = batch.column(0).type
            numbers, times = batch.column(1), batch.column(2)
            ends = numbers.offsets.to_numpy()
            all_numbers, all_times = numbers.values.to_numpy(), times.values.to_numpy()
            time_ends = times.offsets.to_numpy()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if not held[0] or held[0][-1] != doc:
                    if held[0] and (len(held[0]) + 1) * len(terms.items) > MOST_SCORES:
                        score()
                    held[0].append(doc), held[1].append([]), held[2].append([])
                elif len(held[1][-1]) >= MOST_ROWS:
                    known, to = np.unique(np.concatenate(held[1][-1]), return_inverse=True)
                    total = np.zeros(len(known), dtype=np.int64)
                    np.add.at(total, to, np.concatenate(held[2][-1]))
                    held[1][-1], held[2][-1] = [known], [total]
                held[1][-1].append(all_numbers[ends[i] : ends[i + 1]].copy())
                held[2][-1].append(all_times[time_ends[i] : time_ends[i + 1]].copy())
        if held[0]:
            score()
        rows = [(terms.items[item], doc, -less) for item, found in enumerate(kept) for less, _, doc in found]
        if rows:
            item_ids, docs, found = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item_ids, to_arrow_type(terms.kind)), pa.array(docs, kind), pa.array(found, pa.int64())], ["item_id", "doc_id", "score"])

    return run
