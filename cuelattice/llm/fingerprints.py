"""Perceptual fingerprints as numbers, exact comparison, and links over shared hash values.

Two fingerprints are *alike* by content if both durations are above 0 and differ by at most
12 % of the longer (whole ms), and at least three fifths of the longer hash list can be paired one
to one with hashes of the other list that differ in at most 7 of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 7
MAX_PERCENT = 12
#: Above so many pairs of records, a pair of hash values is *heavy* and its records meet by profile.
HEAVY = 4096


def prepared(df: DataFrame, id_col: str, fingerprint: str = "fingerprint", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, sha, ms, hashes, *extra): lower-case digest or NULL, whole ms or NULL, sorted hash list.

    Members of exactly 16 hex digits are hashes; others are left out. Null or empty lists give an
    empty list; durations that are null, not finite, not above 0 or too long for whole ms in 64 bits give NULL.
    """
    f = F.col(fingerprint)
    sha = F.lower(f["sha256"])
    d = f["duration_seconds"]
    ms = F.when(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < 9.2e15), F.round(d * 1000.0, 0).cast("long"))
    members = F.filter(F.coalesce(f["perceptual_hashes"], F.array().cast("array<string>")), lambda h: h.isNotNull() & h.rlike("^[0-9a-fA-F]{16}$"))
    hashes = F.array_sort(F.transform(members, lambda h: F.conv(h, 16, -10).cast("long")))
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.when(sha != "", sha).alias("sha"), F.when(ms > 0, ms).alias("ms"), hashes.alias("hashes"), *extra
    ).where("id is not null")


def durations_fit(a: Column, b: Column) -> Column:
    """The durations differ by at most ``MAX_PERCENT`` % of the longer."""
    longer = F.greatest(a, b)
    hundreds = F.call_function("div", longer, F.lit(100).cast("long"))
    # in whole numbers that don't overflow
    return F.abs(a - b) <= hundreds * MAX_PERCENT + F.call_function("div", (longer - hundreds * 100) * MAX_PERCENT, F.lit(100).cast("long"))


def _matching(close: np.ndarray) -> int:
    """Size of the largest one-to-one pairing, by augmenting paths (iterative)."""
    n, m = close.shape
    owner = [-1] * m
    adj = [np.flatnonzero(r).tolist() for r in close]
    size = 0
    for i in range(n):
        # breadth-first search for a free column
        came, queue, seen, free = {}, [i], set(), -1
        while queue and free < 0:
            r = queue.pop()
            for j in adj[r]:
                if j in seen:
                    continue
                seen.add(j)
                came[j] = r
                if owner[j] < 0:
                    free = j
                    break
                queue.append(owner[j])
        if free < 0:
            continue
        size += 1
        j = free
        while True:
            r = came[j]
            prev = next((c for c in adj[r] if owner[c] == r), -1)
            owner[j] = r
            if r == i:
                break
            j = prev
    return size


def alike_lists(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two hash lists (uint64) pair up in three fifths of the longer."""
    n = max(len(a), len(b))
    need = -(-3 * n // 5)
    if not n or min(len(a), len(b)) < need:
        return False
    close = np.bitwise_count(a[:, None] ^ b[None, :]) <= MAX_BITS
    if min(int(close.any(1).sum()), int(close.any(0).sum())) < need:
        return False
    return _matching(close) >= need


def _list_column(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    return np.asarray(col.offsets), np.asarray(col.flatten()).view(np.uint64) if len(col) else np.zeros(0, np.uint64)


def verified(pairs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows of ``pairs`` (with ``ha``, ``hb`` hash lists) whose lists are alike; keeps long columns ``keep``.

    Short lists of equal lengths are compared together, column by column; only rows whose counts
    leave the pairing open go through augmenting paths.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0), batch.column(1)
            (oa, va), (ob, vb) = _list_column(a), _list_column(b)
            base_a, base_b = oa[0], ob[0]
            la, lb = np.diff(oa), np.diff(ob)
            ok = np.zeros(len(la), bool)
            n = np.maximum(la, lb)
            need = -(-3 * n // 5)
            may = (n > 0) & (np.minimum(la, lb) >= need)
            shape = la.astype(np.int64) << 32 | lb
            for s in np.unique(shape[may]):
                x, y = int(s >> 32), int(s & 0xFFFFFFFF)
                step = max(1, 4_000_000 // (x * y))
                rows_all = np.flatnonzero(may & (shape == s))
                for lo in range(0, len(rows_all), step):
                    rows = rows_all[lo : lo + step]
                    aa = va[(oa[rows] - base_a)[:, None] + np.arange(x)]
                    bb = vb[(ob[rows] - base_b)[:, None] + np.arange(y)]
                    close = np.bitwise_count(aa[:, :, None] ^ bb[:, None, :]) <= MAX_BITS
                    want = -(-3 * max(x, y) // 5)
                    r, c = close.sum(2), close.sum(1)
                    upper = np.minimum((r > 0).sum(1), (c > 0).sum(1))
                    sure = ((r <= 1).all(1) & (c <= 1).all(1)) | (upper < want)
                    ok[rows] = upper >= want
                    for i in np.flatnonzero(~sure):
                        ok[rows[i]] = _matching(close[i]) >= want
            if ok.any():
                kept = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([batch.column(i + 2).take(pa.array(kept)) for i in range(len(keep))], list(keep))

    return pairs.select("ha", "hb", *keep).mapInArrow(check, ", ".join(f"{c} bigint" for c in keep))
