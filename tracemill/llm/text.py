"""Vectorised word handling over Arrow string arrays, used inside mapInArrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text (a longer text comes alone), so that memory follows the limit and not the batch."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 16)
    start, base = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(start, end - start)
        start, base = end, int(sizes[end - 1])


def strings(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large strings, null as empty, in buffers of their own: ascii_lower misreads offsets that do not begin at 0."""
    found = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return found.take(pa.array(np.arange(len(found))))


def words_of(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets of each text's words, code of each word, and the distinct words the codes point at."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    coded = flat.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def shingles_of(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text after lower-casing A-Z: offsets per text and hashes.

    A shingle is ``width`` words; a text of fewer words gives its whole word sequence, one without words nothing.
    Equal shingles have equal hashes; two different ones share a 64-bit hash with a chance of about 5e-20.
    """
    offsets, codes, distinct = words_of(texts, lower=True)
    n_texts, n = len(offsets) - 1, np.diff(offsets)
    if not len(codes):
        return np.zeros(n_texts + 1, np.int64), np.empty(0, np.uint64)
    h = word_hashes(distinct)[codes]
    total = len(h)
    run = np.zeros(total, np.uint64)
    for k in range(width):
        if total > k:
            run[: total - k] = mixed(run[: total - k] * MIX + h[k:] + np.uint64(k + 1))
    owner = np.repeat(np.arange(n_texts), n)
    place = np.arange(total) - offsets[:-1][owner]
    whole = place <= n[owner] - width
    keys, owners = run[whole], owner[whole]
    for t in np.flatnonzero((n > 0) & (n < width)):
        x = np.zeros(1, np.uint64)
        for k in range(n[t]):
            x = mixed(x * MIX + h[offsets[t] + k : offsets[t] + k + 1] + np.uint64(k + 1))
        keys, owners = np.append(keys, mixed(x + np.uint64(n[t]))), np.append(owners, t)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[first], owners[first]
    return np.searchsorted(owners, np.arange(n_texts + 1)), keys


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each of many runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def by_slice(column: str, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = 2 << 20):
    """A mapInArrow function that applies ``each`` to bounded slices of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return run
