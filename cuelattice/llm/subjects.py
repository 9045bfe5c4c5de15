"""Subject areas of documents.

Documents are embedded by term weighting and a truncated singular value decomposition; their
sentences are folded into the same space and assigned to the nearest centroid. Centroids are seeded
from hand labels and area descriptions, one for each area and language and one for remarks
that belong to no area, and refined: assignments give new centroids and new term weights (a term
counts by how concentrated it is on one area) until few sentences change.

Languages are those that the documents' ``lang`` names often enough; a sentence's language is the likeliest by
its terms, whose rates in each language come from all documents, so wrong and missing names don't matter.

Terms are hashed words and word pairs, so the model's size is fixed by ``DIM`` and ``RANK`` and not
by the vocabulary. All counts, the decomposition and the refinement run over all documents, in
passes whose partial sums are matrices of that fixed size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_out
from .leakage import ItemIndex, leaked_many
from .words import _WORD, folded

DIM = 1 << 15
RANK = 128
OVERSAMPLE = 16
POWER_PASSES = 3
ROUNDS = 6
SETTLED = 0.01  # of the cosine
LEAST_SHARE = 0.25
SMOOTH = 1.0
#: Labelled documents that seed centroids at most; beyond it a seeded hash picks them.
SEED_LABELS = 200_000
#: Share of the named documents that a language needs to count as one.
LEAST_LANGUAGE = 0.01
SEED = 7

_STAMP = re.compile(r"^\W*\[\d\d:\d\d:\d\d\]\s+\w+\s+")
_MARKUP = re.compile(r"</?[a-z][a-z0-9]{0,8}>|\*\*|`")
_END = re.compile(r"(?<=[.!])\s+|[。！]")


def sentence_words(text: str, *indexes: ItemIndex) -> list[list[str]]:
    """Words of each sentence, without markup, headings, log stamps and passages of test items.

    A sentence ends at a full stop, an exclamation mark or a line end; a question belongs with
    the sentence that answers it.
    """
    return sentences_of([text], *indexes)[0]


def sentences_of(texts: list[str], *indexes: ItemIndex) -> list[list[list[str]]]:
    """``sentence_words`` of many texts; test passages are searched for in all of them together."""
    pieces = [_pieces(folded(_MARKUP.sub("", t))) if t else [] for t in texts]
    gone: dict[int, list[tuple[int, int]]] = {}
    if any(index.sizes for index in indexes):
        ws = [[w for _, piece in ps for w in piece] for ps in pieces]
        for index in indexes:
            for k, _, at, size in leaked_many(ws, index):
                gone.setdefault(k, []).append((at, at + size))
    return [_kept(ps, gone[k]) if k in gone else [p for about, p in ps if about and p] for k, ps in enumerate(pieces)]


def _pieces(t: str) -> list[tuple[bool, list[str]]]:
    """(whether it is a sentence, its words) of the text's sentences, headings and log stamps, in order."""
    out = []
    for line in t.split("\n"):
        if (stamp := _STAMP.match(line)) is not None:
            out.append((False, _WORD.findall(stamp.group())))
            line = line[stamp.end() :]
        if line.lstrip().startswith("#"):
            out.append((False, _WORD.findall(line)))
        else:
            out.extend((True, _WORD.findall(s)) for s in _END.split(line))
    return out


def _kept(pieces: list[tuple[bool, list[str]]], spans: list[tuple[int, int]]) -> list[list[str]]:
    """The sentences without the words in ``spans`` (positions in the whole text); a sentence ends where some are taken out."""
    out = []
    gone = np.zeros(sum(len(p) for _, p in pieces) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    at = 0
    for about, piece in pieces:
        own = gone[at : at + len(piece)]
        at += len(piece)
        if not about or not piece:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
        out.extend(piece[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
    return out


def terms(ws: list[str], memo: dict[str, int]) -> list[int]:
    """Hashed words and word pairs; words with digits are left out."""
    import xxhash

    out = []
    before = ""
    for w in ws:
        if not w.isalpha():
            continue
        for t in (f"{before} {w}", w) if before else (w,):
            h = memo.get(t)
            if h is None:
                if len(memo) > 500_000:
                    memo.clear()
                h = memo[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % DIM
            out.append(h)
        before = w
    return out


def features(docs: DataFrame, items: Iterable[list[tuple[int, str]]]) -> DataFrame:
    """(doc_id, lang, lens, flat): a document's sentences as packed int32 arrays. Narrow.

    Documents without words have empty arrays; null texts count as empty. ``lang`` is trimmed and in lower case, NULL where
    it is empty, ``und`` or no column of ``docs``. ``items``: blocks of test items
    whose passages don't count.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in items]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, memo = [ItemIndex(b.value) for b in shared], {}
        for b in batches:
            all_ids, langs, texts = (b.column(i).to_pylist() for i in range(3))
            pack = lambda x: np.asarray(x, np.int32).tobytes()
            for lo in range(0, len(all_ids), 500):
                rows = []
                for did, lang, ss in zip(all_ids[lo : lo + 500], langs[lo : lo + 500], sentences_of(texts[lo : lo + 500], *indexes)):
                    ts = [terms(w, memo) for w in ss]
                    rows.append((did, lang, pack([len(t) for t in ts]), pack([h for t in ts for h in t])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["doc_id", "lang", "lens", "flat"])

    lang = F.lower(F.regexp_replace("lang", r"^\s+|\s+$", "")) if "lang" in docs.columns else F.lit(None).cast("string")
    lang = F.when(~lang.isin("", "und"), lang).alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id bigint, lang string, lens binary, flat binary")


class _Batch:
    """Sentences of a run of documents as flat arrays."""

    def __init__(self, ids, lang, lens, flat) -> None:
        get = lambda col: [np.frombuffer(x, np.int32) for x in col]
        ls, fs = get(lens), get(flat)
        self.ids, self.lang = np.asarray(ids, dtype=object), lang
        self.per_doc = np.array([len(x) for x in ls], np.int64)
        self.lens = np.concatenate(ls) if ls else np.zeros(0, np.int32)
        self.flat = np.concatenate(fs) if fs else np.zeros(0, np.int32)
        self.doc_of = np.repeat(np.arange(len(ls)), self.per_doc)
        self.sent_of = np.repeat(np.arange(len(self.lens)), self.lens)
        self.doc_of_term = self.doc_of[self.sent_of] if len(self.flat) else np.zeros(0, np.int64)

    def groups(self, rates: np.ndarray) -> np.ndarray:
        """The language of each sentence: the likeliest by its terms, a little by its document's."""
        if rates.shape[1] == 1 or not len(self.flat):
            return np.zeros(len(self.lens), np.int64)
        own = np.stack([np.bincount(self.sent_of, rates[self.flat, g], minlength=len(self.lens)) for g in range(rates.shape[1])], 1)
        whole = np.stack([np.bincount(self.doc_of, own[:, g], minlength=len(self.ids)) for g in range(rates.shape[1])], 1)
        return (own + 0.2 * (whole[self.doc_of] - own)).argmax(1)

    def doc_terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count) of distinct terms."""
        key, tf = np.unique(self.doc_of_term.astype(np.int64) * DIM + self.flat, return_counts=True)
        return key // DIM, key % DIM, tf

    def sums(self, rows: np.ndarray, n: int, matrix: np.ndarray, cols: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Row sums of ``matrix[cols]`` (weighted); ``rows`` ascend. One small product a row."""
        out = np.zeros((n, matrix.shape[1]), np.float32)
        _add_products(out, rows, matrix, cols, np.ones(len(rows), np.float32) if weight is None else weight.astype(np.float32))
        return out


def _add_products(out: np.ndarray, rows: np.ndarray, matrix: np.ndarray, cols: np.ndarray, weight: np.ndarray, runs: int = 16, most: int = 512) -> None:
    """out[r] += weight @ matrix[cols] over the run of each r in the ascending ``rows``.

    Short runs are taken together, as one small block matrix; a long run is one product.
    """
    if not len(rows):
        return
    edges = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]])
    i = 0
    while i < len(edges) - 1:
        j = i + 1
        while j < len(edges) - 1 and j - i < runs and edges[j + 1] - edges[i] <= most:
            j += 1
        a, b = edges[i], edges[j]
        if j == i + 1:
            out[rows[a]] += weight[a:b] @ matrix[cols[a:b]]
        else:
            block = np.zeros((j - i, b - a), np.float32)
            block[np.repeat(np.arange(j - i), np.diff(edges[i : j + 1])), np.arange(b - a)] = weight[a:b]
            out[rows[edges[i:j]]] += block @ matrix[cols[a:b]]
        i = j


def _batches(it: Iterator[pa.RecordBatch], docs: int = 2000) -> Iterator[_Batch]:
    for b in it:
        for lo in range(0, b.num_rows, docs):
            part = b.slice(lo, docs)
            yield _Batch(*[part.column(i).to_pylist() for i in range(4)])


def _matrix_sum(df: DataFrame, partial, shape: tuple[int, int], slabs: int = 16) -> np.ndarray:
    """Sum over all partitions of a matrix of fixed shape; ``partial`` maps batches to one matrix.

    Partial matrices are cut into slabs of rows and added up slab by slab on the executors; the
    driver gets one matrix, whose size doesn't depend on the data. Sums run in two levels, so that a task adds
    as many matrices as the root of the number of partitions.
    """
    rows, cols = shape
    cut = [rows * i // slabs for i in range(slabs + 1)]

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(it)
        if m is None:
            return
        m = np.ascontiguousarray(m, np.float32)
        for i in range(slabs):
            part = m[cut[i] : cut[i + 1]]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slab", "m"])

    def bucketed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % buckets
        for b in emit(it):
            yield b.append_column("bucket", pa.array([part] * b.num_rows, pa.int64()))

    def add(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in it:
            for x in pdf["m"]:
                v = np.frombuffer(x, np.float32)
                total = v.astype(np.float64) if total is None else total + v
        yield pd.DataFrame({"slab": [key[0]], "m": [total.astype(np.float32).tobytes()]})

    out = np.zeros((rows, cols), np.float32)
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    buckets = max(1, math.isqrt(parts)) if parts > 64 else 1
    summed = df.mapInArrow(bucketed, "slab bigint, m binary, bucket bigint")
    if buckets > 1:
        summed = summed.groupBy("slab", "bucket").applyInPandas(add, "slab bigint, m binary")
    summed = summed.groupBy("slab").applyInPandas(add, "slab bigint, m binary")
    for r in summed.collect():
        out[cut[r["slab"]] : cut[r["slab"] + 1]] = np.frombuffer(r["m"], np.float32).reshape(-1, cols)
    return out


def language_rates(feat: DataFrame) -> np.ndarray:
    """(DIM, languages): log rate of each term in each language, from the documents that name one.

    Languages that fewer than ``LEAST_LANGUAGE`` of the named documents have are left out; without any there is one column.
    """
    named = feat.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    # at most 1 / LEAST_LANGUAGE rows
    langs = sorted(r["lang"] for r in named.where(F.col("n") >= LEAST_LANGUAGE * total).collect())
    if len(langs) < 2:
        return np.zeros((DIM, 1), np.float32)
    at = {name: i for i, name in enumerate(langs)}

    def count(it: Iterator[pa.RecordBatch]) -> np.ndarray:
        m = np.zeros((DIM, len(langs)), np.float64)
        for b in _batches(it):
            g = np.array([at.get(x, -1) for x in b.lang], np.int64)[b.doc_of_term]
            m += np.bincount(b.flat[g >= 0].astype(np.int64) * len(langs) + g[g >= 0], minlength=m.size).reshape(m.shape)
        return m

    m = _matrix_sum(feat, count, (DIM, len(langs))).astype(np.float64) + 0.5
    return np.log(m / m.sum(0)).astype(np.float32)


def term_rates(feat: DataFrame, rates: np.ndarray) -> np.ndarray:
    """Term weights: minus the log of the share of documents with the term, in the language that uses it most.

    Templates of a language with few documents are thus common, not rare. Terms of one document weigh 0.
    """
    k = rates.shape[1]
    shared = feat.sparkSession.sparkContext.broadcast(rates)

    def count(it: Iterator[pa.RecordBatch]) -> np.ndarray:
        m = np.zeros((DIM + 1, k), np.float64)
        for b in _batches(it):
            votes = np.zeros((len(b.ids), k), np.int64)
            np.add.at(votes, (b.doc_of, b.groups(shared.value)), 1)
            group = votes.argmax(1)
            d, t, _ = b.doc_terms()
            m[:DIM] += np.bincount(t * k + group[d], minlength=DIM * k).reshape(DIM, k)
            m[DIM] += np.bincount(group[b.per_doc > 0], minlength=k)
        return m

    m = _matrix_sum(feat, count, (DIM + 1, k)).astype(np.float64)
    shared.destroy()
    df, n = m[:DIM], np.maximum(m[DIM], 1)
    w = -np.log(np.clip((df / n).max(1), 1e-9, 1))
    w[df.sum(1) < 2] = 0
    return w


def truncated_svd(feat: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(DIM, rank) right singular vectors of the weighted document-term matrix, by randomized power passes."""
    spark = feat.sparkSession
    w = weight.astype(np.float32)

    def rows_of(b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, t, tf = b.doc_terms()
        some = w[t] > 0
        d, t, tf = d[some], t[some], tf[some]
        v = (1 + np.log(tf)) * w[t]
        norm = np.sqrt(np.bincount(d, v**2, minlength=len(b.ids)))
        return d, t, v / np.maximum(norm[d], 1e-9)

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((DIM, rank + OVERSAMPLE), np.float32))[0]
    for i in range(POWER_PASSES + 1):
        shared = spark.sparkContext.broadcast(q)
        last = i == POWER_PASSES

        def step(it: Iterator[pa.RecordBatch], shared=shared, last=last) -> np.ndarray:
            basis = shared.value
            k = basis.shape[1]
            out = np.zeros((k if last else DIM, k), np.float32)
            for b in _batches(it):
                d, t, v = rows_of(b)
                y = b.sums(d, len(b.ids), basis, t, v)
                if last:
                    out += y.T @ y
                    continue
                # blocks of documents as small dense matrices over the terms they have
                cut = np.searchsorted(d, np.arange(0, len(b.ids) + 64, 64))
                for n, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if hi > lo:
                        own, at = np.unique(t[lo:hi], return_inverse=True)
                        block = np.zeros(len(own) * 64, np.float32)
                        block[at * 64 + d[lo:hi] - 64 * n] = v[lo:hi]  # the terms of one document differ
                        out[own] += block.reshape(-1, 64)[:, : len(y) - 64 * n] @ y[64 * n : 64 * n + 64]
            return out

        m = _matrix_sum(feat, step, (q.shape[1], q.shape[1]) if last else q.shape)
        shared.destroy()
        if not last:
            q = np.linalg.qr(m)[0]
    values, vectors = np.linalg.eigh(m.astype(np.float64))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Model:
    """Areas, term vectors and centroids: a fixed size, shipped to every task."""

    def __init__(self, areas: list[str], vectors: np.ndarray, weight: np.ndarray, seeds: list[tuple[int, list[int]]], rates: np.ndarray) -> None:
        self.areas = areas
        self.rates = rates
        self.base = weight
        self.vectors = vectors
        self.weight = weight.copy()
        self.centroids = np.zeros((len(areas) + 1, rates.shape[1], vectors.shape[1]), np.float32)
        self.seeds = seeds

    def embed(self, b: _Batch) -> np.ndarray:
        w = self.weight[b.flat]
        some = w > 0
        return _unit(b.sums(b.sent_of[some], len(b.lens), self.vectors, b.flat[some], w[some]))

    def assign(self, b: _Batch, x: np.ndarray, groups: np.ndarray, allow: np.ndarray | None = None) -> np.ndarray:
        """The nearest centroid of each sentence; the last is no area. A sentence like no centroid is of no area."""
        sim = np.empty((len(x), len(self.centroids)), np.float32)
        for g in range(self.centroids.shape[1]):
            own = groups == g
            sim[own] = x[own] @ self.centroids[:, g].T
        if allow is not None:
            sim = np.where(allow[b.doc_of], sim, -9)
        out = sim.argmax(1)
        out[sim.max(1) <= 0] = len(self.areas)
        return out


def _allowed(model: Model, b: _Batch, labels: dict[int, frozenset[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(allowed classes by document, whether labelled)."""
    c = len(model.areas) + 1
    own = [labels.get(i) for i in b.ids]
    allow = np.ones((len(b.ids), c), bool)
    has = np.array([x is not None for x in own], bool)
    allow[has, :-1] = False
    for d in np.flatnonzero(has).tolist():
        allow[d, list(own[d])] = True
    return allow, has


def refine(feat: DataFrame, labelled: DataFrame, labels: dict[int, frozenset[int]], model: Model) -> Model:
    """Centroids and term weights from labelled sentences first, then from all, round by round.

    ``labels``: document to its areas. Sentences of labelled documents stay within
    their labels or no area; the first two rounds use them alone. In the first, a document with one
    label gives it to all its sentences. Rounds end when no centroid turns by more than ``SETTLED``, after ``ROUNDS`` at most.
    """
    spark = feat.sparkSession
    c = len(model.areas) + 1
    k, langs = model.vectors.shape[1], model.rates.shape[1]
    shared_labels = spark.sparkContext.broadcast(labels)  # as small as SEED_LABELS allows
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def step(it: Iterator[pa.RecordBatch], shared=shared, i=i) -> np.ndarray:
            m, lab = shared.value, shared_labels.value
            # centroid sums and counts above, class counts of terms below
            out = np.zeros((c * langs + DIM, max(k + 1, c)), np.float32)
            for b in _batches(it):
                allow, has = _allowed(m, b, lab)
                x, groups = m.embed(b), b.groups(m.rates)
                if i == 0:
                    n = allow[:, :-1].sum(1)
                    first = np.where(n == 0, c - 1, allow[:, :-1].argmax(1))
                    cls = first[b.doc_of]
                    keep = (has & (n <= 1))[b.doc_of]
                else:
                    cls, keep = m.assign(b, x, groups, allow), np.ones(len(b.lens), bool)
                slot = cls * langs + groups
                o = np.flatnonzero(keep)
                o = o[np.argsort(slot[o], kind="stable")]
                if len(o):
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(slot[o])) + 1])
                    out[slot[o][starts], :k] += np.add.reduceat(x[o], starts, axis=0)
                    out[: c * langs, k] += np.bincount(slot[o], minlength=c * langs)
                    t = keep[b.sent_of]
                    out[c * langs :, :c] += np.bincount(b.flat[t].astype(np.int64) * c + cls[b.sent_of][t], minlength=DIM * c).reshape(DIM, c)
            return out

        m = _matrix_sum(labelled if i < 2 else feat, step, (c * langs + DIM, max(k + 1, c)))
        shared.destroy()
        sums, counts = m[: c * langs, :k].reshape(c, langs, k), m[: c * langs, k].reshape(c, langs).sum(1)
        new = Model(model.areas, model.vectors, model.base, model.seeds, model.rates)
        cents = sums.astype(np.float64)
        if i == 0:
            for area, ts in model.seeds:
                if ts:
                    # a description counts in its own language
                    group = int(model.rates[ts].sum(0).argmax())
                    cents[area, group] += _unit((model.vectors[ts] * model.base[ts, None]).sum(0))
        new.centroids = _unit(cents).astype(np.float32)
        by = m[c * langs :, :c].astype(np.float64)
        by = by / np.maximum(counts, 1) * counts.mean()  # rates, as areas differ in size
        p = (by + SMOOTH / c) / (by.sum(1, keepdims=True) + SMOOTH)
        new.weight = model.base * np.maximum(0, 1 + (p * np.log(p)).sum(1) / math.log(c))
        turned = 1 - (new.centroids * model.centroids).sum(2)[np.abs(new.centroids).sum(2) > 0]
        model = new
        if i > 2 and turned.max(initial=0) < SETTLED:
            break
    shared_labels.destroy()
    return model


def assigned(feat: DataFrame, model: Model, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, sentences, share): areas that at least ``least`` of a document's sentences are about."""
    shared = feat.sparkSession.sparkContext.broadcast(model)

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c = len(m.areas) + 1
        names = np.array([*m.areas, ""], dtype=object)
        for b in _batches(it):
            n = np.zeros((len(b.ids), c), np.int64)
            np.add.at(n, (b.doc_of, m.assign(b, m.embed(b), b.groups(m.rates))), 1)
            share = n / np.maximum(n.sum(1, keepdims=True), 1)
            d, s = np.nonzero((share[:, :-1] >= least) & (n[:, :-1] > 0))
            if len(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids[d].tolist(), pa.int64()), pa.array(names[s].tolist(), pa.string()), pa.array(n[d, s]), pa.array(share[d, s])], ["doc_id", "subject", "sentences", "share"]
                )

    return feat.mapInArrow(make, "doc_id bigint, subject string, sentences bigint, share double")


def label_sets(labels: DataFrame, areas: list[str], most: int = SEED_LABELS) -> dict[int, frozenset[int]]:
    """Document to its areas, on the driver: a bounded sample of labelled documents.

    Spellings are trimmed and lower-cased; repeated labels count once; ``none`` and unknown areas
    give no area (a document with ``none`` alone has an empty set); null documents and labels are left out.
    """
    s = F.lower(F.regexp_replace("subject", r"^\s+|\s+$", ""))
    rows = labels.select(F.col("doc_id").cast("long").alias("d"), s.alias("s")).dropna()
    rows = rows.where(F.col("s").isin(*areas, "none")).groupBy("d").agg(F.collect_set("s").alias("s"))
    rows = rows.orderBy(F.xxhash64(F.lit(SEED), "d"), "d").limit(most)
    at = {a: i for i, a in enumerate(areas)}
    return {r["d"]: frozenset(at[x] for x in r["s"] if x in at) for r in rows.collect()}


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: Iterable[list[tuple[int, str]]]) -> tuple[DataFrame, Model]:
    """(features, model) of a collection. ``areas``: (subject, description); the model grows with their number.

    Empty tables, documents without words and areas without labels are allowed; an area that
    no label and no description reaches has no centroid and is never assigned.
    """
    feat = write_out(features(docs, items), "p9-features")
    rows = sorted((r[0].strip().lower(), r[1] or "") for r in areas.select("subject", "description").where("subject is not null").collect())
    names = [a for a, _ in rows]
    bits = label_sets(labels, names)
    rates = language_rates(feat)
    weight = term_rates(feat, rates)
    vectors = truncated_svd(feat, weight)
    memo: dict[str, int] = {}
    seeds = [(i, [t for w in sentence_words(d) for t in terms(w, memo)]) for i, (_, d) in enumerate(rows)]
    labelled = write_out(feat.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "p9-labelled")
    return feat, refine(feat, labelled, bits, Model(names, vectors, weight, seeds, rates))
