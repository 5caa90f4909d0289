"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

Only documents longer than a sequence are cut; the rest after full pieces is the first piece, so each document
has at most one piece that is not full. Those pieces are dealt to buckets of a fixed expected size, packed there
by best-fit decreasing, and the bucket's bin count is held against dual-feasible-function lower bounds. While
the total exceeds the bound over all pieces, buckets with a gap and bins with room give up their pieces, which
are dealt anew and packed again; the outcome is kept if it needs fewer bins.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed as
often as they come, told apart by a row number; of pieces of one length the one with the smaller row number is placed
first, of bins with one room any; a very long text is cut into as many pieces as it takes; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_texts, vocabulary
from .runtime import cut, vocabulary_path
from .text import by_slice, ragged, strings

PIECE = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_texts(strings(part, "text").to_pylist(), vocabulary(path))
        n = np.diff(offsets) + 1
        pieces = -(-n // size)
        first = n - (pieces - 1) * size
        number = ragged(np.zeros(len(n), np.int64), pieces)
        owner = np.repeat(np.arange(len(n)), pieces)
        start = np.where(number == 0, 0, first[owner] + (number - 1) * size)
        length = np.where(number == 0, first[owner], size)
        crc = np.empty(len(owner), np.int64)
        little, end = ids.astype("<u4", copy=False), np.array([end_id], "<u4").tobytes()
        for k, (o, a, m) in enumerate(zip(owner, start, length)):
            data = little[offsets[o] + a : min(offsets[o] + a + m, offsets[o + 1])].tobytes()
            crc[k] = zlib.crc32(end if a + m == n[o] else b"", zlib.crc32(data))
        doc_id = part.column("doc_id").take(pa.array(owner))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> x
        if fitting:
            room = x + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, n = size, n, n + 1
        bins[i], offsets[i] = at, size - room
        if room > x:
            open_bins[room - x].append(at)
            rooms |= 1 << (room - x)
    return bins, offsets, n


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Least number of bins for counts[x] pieces of length x, by two families of dual feasible functions."""
    x = np.arange(size + 1, dtype=object)
    counts = counts.astype(object)
    best = -(-int((x * counts).sum()) // size)
    number = counts.cumsum()
    mass = (x * counts).cumsum()
    for least in range(1, size // 2 + 1):  # pieces over size - least count as full, those under least as nothing
        large = int(number[size] - number[size - least])
        middle = int(mass[size - least] - mass[least - 1])
        best = max(best, large + -(-middle // size))
    for k in range(1, 21):  # x * (k + 1) / size rounded down, in k-ths of a bin, or x itself where that is whole
        scaled = x * (k + 1)
        worth = np.where(scaled % size == 0, x * k, scaled // size * size)
        best = max(best, -(-int((worth * counts).sum()) // (k * size)))
    return best


#: Bits of a bin's number within its bucket and of a bucket's: with two for the round they make a bin's name, of 62 bits.
BIN_BITS, BUCKET_BITS = 22, 38


def bin_names(seed: int, bucket: int, bins: np.ndarray) -> np.ndarray:
    """Names that no other bin of any round and bucket has."""
    if seed > 3 or bucket >> BUCKET_BITS or len(bins) and int(bins.max()) >> BIN_BITS:
        raise ValueError(f"round {seed}, bucket {bucket} or its bins are too many for a bin's name")
    return ((seed << BUCKET_BITS | bucket) << BIN_BITS) + bins.astype(np.int64)


def _pack(rows: DataFrame, size: int, buckets: int, seed: int) -> DataFrame:
    """Each piece with its bin, offset, and its bucket's bins and lower bound."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        return pd.DataFrame({"rid": pdf["rid"], "length": lengths, "bin": bin_names(seed, int(key[0]), bins), "offset": offsets, "bucket_gap": n - bound})

    dealt = rows.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(one, "rid long, length long, bin long, offset long, bucket_gap long")


def pack_pieces(pieces: DataFrame, size: int = 1024, bucket_rows: int = 50_000, rounds: int = 3) -> DataFrame:
    """pieces (with a unique rid and a length of at most size) with ``sequence_id``, ``offset`` and ``least_sequences``, the bound on the number of sequences of any packing.

    A bucket holds about ``bucket_rows`` pieces however large the table is.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    n_full = counts.pop(size, 0)
    total = sum(counts.values())
    full = pieces.filter(F.col("length") == size).withColumns({"sequence_id": F.col("rid") * 2 + 1, "offset": F.lit(0).cast("long")})
    if not total:
        return full.withColumn("least_sequences", F.lit(n_full).cast("long"))
    bound = lower_bound(np.array([counts.get(x, 0) for x in range(size + 1)]), size)
    small = pieces.filter(F.col("length") < size).select("rid", "length")
    placed = cut(_pack(small, size, -(-total // bucket_rows), 0), "packed")
    n_bins = lambda df: df.select(F.count_distinct("bin")).first()[0]
    have = n_bins(placed)
    for seed in range(1, rounds + 1):
        if have <= bound:
            break
        bins = placed.groupBy("bin").agg(F.sum("length").alias("used"), F.max("bucket_gap").alias("bucket_gap"), F.count("*").alias("n"))
        loose = bins.filter((F.col("used") <= size - size // 16) | (F.col("bucket_gap") > 0) & (F.col("used") < size))
        before = loose.agg(F.count("*").alias("bins"), F.sum("n").alias("n")).first()
        if before["bins"] < 2:
            break
        pooled = placed.join(loose.select("bin"), "bin", "left_semi").select("rid", "length")
        again = cut(_pack(pooled, size, -(-before["n"] // bucket_rows), seed), "repacked")
        need = n_bins(again)
        if need >= before["bins"]:
            break
        placed = cut(placed.join(loose.select("bin"), "bin", "left_anti").select(again.columns).unionByName(again), "packed")
        have += need - before["bins"]
    packed = pieces.join(placed.select("rid", (F.col("bin") * 2).alias("sequence_id"), "offset"), "rid")
    return full.unionByName(packed).withColumn("least_sequences", F.lit(n_full + bound).cast("long"))


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, path: str | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the certified bound least_sequences."""
    pieces = cut(document_pieces(docs, size, end_id, path).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, size, bucket_rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "least_sequences")
