"""Evaluation texts that leak into training texts.

Windows of a document are given SimHash fingerprints over their weighted words, by sums of sums, so a
document costs one pass a window size. Item windows are indexed in one block of bits more than the radius:
two fingerprints within it agree in at least one block, so the index guarantees every fingerprint within the radius.
Passages are windows of ``WINDOW`` words, verified as the same run of words (``ItemIndex``); whole items with small
edits are found by windows of nearly the item's size, verified by weighted shingle similarity (``NearIndex``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordHash, words

WINDOW = 10
RADIUS = 3
#: Item texts up to this many bytes are shipped to every task; beyond it items come in blocks of this size.
ITEM_BYTES = 8_000_000
SHINGLE = 5
#: Bits that windows of nearly an item's size may differ in, for items with small edits.
NEAR_RADIUS = 7


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` words; every word weighs as often as it stands in the window."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # window sums from sums of 1, 2, 4, ... words
    total, done, part, width = None, 0, bits, 1
    while True:
        if size & width:
            total = part[: n + size - done - width].copy() if total is None else total[: n + size - done - width] + part[done : n + size - width]
            done += width
        if done == size:
            break
        part = part[:-width] + part[width:]
        width *= 2
    return np.packbits((2 * total[:n].astype(np.int16) > size), axis=1, bitorder="little").view("<u8").ravel()


class ItemIndex:
    """Windows of all items by size, with their fingerprints in Hamming blocks."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        self.hash = WordHash()
        by_size: dict[int, list[tuple[int, list[str]]]] = {}
        for item, text in items:
            ws = words(text)
            if item is not None and ws:
                by_size.setdefault(min(window, len(ws)), []).append((item, ws))
        self.sizes = {}
        for size, rows in by_size.items():
            marks, item_of, texts = [], [], []
            for item, ws in rows:
                marks.append(simhashes(self.hash(ws), size))
                for i in range(len(ws) - size + 1):
                    item_of.append(item)
                    texts.append(ws[i : i + size])
            marks = np.concatenate(marks)
            self.sizes[size] = (marks, np.array(item_of, np.int64), texts, _blocks(marks, RADIUS))

    def candidates(self, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window of the document, window of an item) within ``RADIUS``, each once."""
        own, _, _, blocks = self.sizes[size]
        return _candidates(marks, own, blocks, RADIUS)


def _blocks(marks: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(order, starts) of the fingerprints by each of ``radius`` + 1 blocks of bits."""
    bits = 64 // (radius + 1)
    out = []
    for b in range(radius + 1):
        key = (marks >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)
        order = np.argsort(key, kind="stable")
        out.append((order, np.searchsorted(key[order], np.arange((1 << bits) + 1, dtype=np.uint64))))
    return out


def _candidates(marks: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``marks``, position in ``own``) within ``radius`` bits, each once: two such agree in a block."""
    bits = 64 // (radius + 1)
    out_d, out_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    part = np.uint64((1 << bits) - 1)
    for b, (order, starts) in enumerate(blocks):
        key = ((marks >> np.uint64(b * bits)) & part).astype(np.int64)
        lo, n = starts[key], starts[key + 1] - starts[key]
        at = np.flatnonzero(n)
        if not len(at):
            continue
        d = np.repeat(at, n[at])
        first = np.repeat(lo[at] - np.concatenate([[0], np.cumsum(n[at])[:-1]]), n[at])
        i = order[first + np.arange(len(d))]
        diff = marks[d] ^ own[i]
        keep = np.flatnonzero(np.bitwise_count(diff) <= radius)
        d, i, diff = d[keep], i[keep], diff[keep]
        # pairs that agree in an earlier block came out there
        new = np.ones(len(d), bool)
        for e in range(b):
            new &= (diff & (part << np.uint64(e * bits))) != 0
        out_d.append(d[new]), out_i.append(i[new])
    return np.concatenate(out_d), np.concatenate(out_i)


def shingles(ws: list[str], size: int = SHINGLE) -> Counter:
    """Word shingles with how often each stands; a text shorter than a shingle is one."""
    size = min(size, len(ws))
    return Counter(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if ws else Counter()


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity: common weight by weight of either."""
    both = sum((x & y).values())
    either = sum(x.values()) + sum(y.values()) - both
    return both / either if either else 0.0


def _laid_out(docs: list[list[str]], chunk: int) -> Iterator[tuple[int, list[list[str]], list[str], np.ndarray]]:
    """(number of the first, documents, their words end to end, where each ends) in runs of about ``chunk`` words."""
    first = 0
    while first < len(docs):
        last, n = first, 0
        while last < len(docs) and (last == first or n + len(docs[last]) <= chunk):
            n += len(docs[last])
            last += 1
        part = docs[first:last]
        yield first, part, part[0] if len(part) == 1 else [w for d in part for w in d], np.cumsum([len(d) for d in part])
        first = last


def leaked_many(docs: list[list[str]], index: ItemIndex, chunk: int = 100_000) -> list[tuple[int, int, int, int]]:
    """(document, item, position, size) of each document window that is the same run of words as an item's window."""
    out = []
    for first, part, ws, ends in _laid_out(docs, chunk):
        h = index.hash(ws)
        for size in index.sizes:
            if len(ws) < size:
                continue
            d, i = index.candidates(simhashes(h, size), size)
            doc = np.searchsorted(ends, d, side="right")
            # windows that reach into the next document are none
            inside = d + size <= ends[np.minimum(doc, len(ends) - 1)]
            _, item_of, texts, _ = index.sizes[size]
            for a, b, k in zip(d[inside].tolist(), i[inside].tolist(), doc[inside].tolist()):
                if ws[a : a + size] == texts[b]:
                    out.append((first + k, int(item_of[b]), a - (int(ends[k]) - len(part[k])), size))
    return out


def grid_size(n: int) -> int:
    """The window that stands for items of ``n`` words: of 5, 7, 11, 16, ... words the longest that fits, a third shorter at most."""
    size = SHINGLE
    while (longer := size + (size + 1) // 2) <= n:
        size = longer
    return min(size, n)


class NearIndex:
    """Items as a whole, by windows of nearly their size, for copies with small edits.

    An item's copy of similarity 0.8 or more holds one of the item's windows with few edits; its fingerprint lies
    within ``NEAR_RADIUS`` bits for at least nine of ten such copies (tests measure it), and blocks of bits
    guarantee every window within the radius.
    """

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.hash = WordHash()
        self.items = [(item, ws, shingles(ws)) for item, text in items if item is not None and (ws := words(text))]
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, (_, ws, _) in enumerate(self.items):
            size = grid_size(len(ws))
            k = len(ws) - size + 1
            by_size.setdefault(size, []).append((simhashes(self.hash(ws), size), np.full(k, n), np.arange(k)))
        self.sizes = {}
        for size, rows in by_size.items():
            marks, item, offset = (np.concatenate(c) for c in zip(*rows))
            self.sizes[size] = (marks, item, offset, _blocks(marks, NEAR_RADIUS))

    def near_many(self, docs: list[list[str]], least: float, chunk: int = 100_000) -> list[tuple[int, int, float]]:
        """(document, item, similarity) of items that a document's window of the item's length is like, the best of each."""
        best: dict[tuple[int, int], float] = {}
        for first, part, ws, ends in _laid_out(docs, chunk):
            h = self.hash(ws)
            for size, (own, item, offset, blocks) in self.sizes.items():
                if len(ws) < size:
                    continue
                marks = simhashes(h, size)
                d, i = _candidates(marks, own, blocks, NEAR_RADIUS)
                doc = np.searchsorted(ends, d, side="right")
                inside = d + size <= ends[np.minimum(doc, len(ends) - 1)]
                places = np.unique(np.stack([doc[inside], item[i[inside]], (d - offset[i])[inside]], 1), axis=0) if inside.any() else []
                for k, n, at in np.asarray(places).tolist():
                    lo, hi = int(ends[k]) - len(part[k]), int(ends[k])
                    name, text, weight = self.items[n]
                    s = similarity(shingles(ws[max(lo, at) : min(hi, at + len(text))]), weight)
                    if s >= least:
                        best[first + k, name] = max(s, best.get((first + k, name), 0.0))
        return [(k, name, s) for (k, name), s in best.items()]


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The stated item set in blocks of at most ``most`` bytes of text, one at a time on the driver; at least one, maybe empty."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(r[1].encode("utf-8", "replace"))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "question", least: float | None = None) -> DataFrame:
    """(doc_id, item_id, windows, similarity): the documents that hold passages of an item.

    A passage is ``WINDOW`` consecutive words of the item, or all of it if it has fewer; ``windows``
    counts the places where one stands. With ``least``, documents also come out that hold the whole item with small
    edits: ``similarity`` is the highest weighted shingle similarity of a window of the item's length, NULL where it
    is below ``least``. Null and empty texts and items give no
    rows; repeated texts each give theirs; whole texts are read, of any length; no shuffle.
    The item set is a stated query set: it is read against all documents, in blocks of bounded size.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = None
    for block in item_blocks(items, item_id, question):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            near = NearIndex(shared.value) if least is not None else None
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lo in range(0, len(ids), 500):
                    ws = [words(t) for t in texts[lo : lo + 500]]
                    per: dict[tuple[int, int], list] = {}
                    for k, item, _, _ in leaked_many(ws, index):
                        per.setdefault((lo + k, item), [0, None])[0] += 1
                    for k, item, s in near.near_many(ws, least) if near else ():
                        per.setdefault((lo + k, item), [0, None])[1] = s
                    rows = [(ids[k], item, n, s) for (k, item), (n, s) in per.items() if ids[k] is not None]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "windows", "similarity"])

        found = d.mapInArrow(scan, "doc_id bigint, item_id bigint, windows bigint, similarity double")
        parts = found if parts is None else parts.unionByName(found)
    return parts
