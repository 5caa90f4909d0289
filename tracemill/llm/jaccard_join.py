"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, exact, with connected components.

A document's set holds the hashes of its distinct word shingles. Sets within Jaccard similarity t of each other
differ in at most (1 - t) / (1 + t) * (|R| + |S|) shingles. The hash universe is cut into 2^level segments, the level
following the size band of the set, and a set is seen as one subset per segment. If two similar sets differ in
fewer places than a set has usable segments, one of these segments agrees, or differs in one shingle at most where
one-deletion neighbourhoods are indexed as well. Empty segments are never used, so a match always says something.

Allocation, by cost: a set indexes its subsets, cheapest rows per segment first decided by a bounded sample of
documents whose frequent signatures are left out, segment by segment until they outnumber the possible differences by
a twentieth of its size. Of two similar sets the one that stops earlier finds all its segments indexed by the
other. Sets whose segments do not suffice index all of them with their one-deletion neighbourhoods, which count
twice, and the smallest ones their single shingles.

Signatures are shuffled once and read in sorted order. Groups of up to GROUP sets give pairs, and a pair goes on if it
shares as many signatures as similar sets of these sizes must, less those that may lie in larger groups. Sets with
too many signatures in larger groups are indexed again, by their rarest segments with exact counts. Sets that share
even these with many, such as near copies of one text, form clusters: links to a few leaders come first, and sets
that are then still in different components are compared block by block by parity sketches, whose distance never
exceeds that of the sets; only sets of one size band or of neighbouring bands are held against each other. Whatever is
left is verified on the exact shingle sets. Equal sets are one node from the start and are never expanded into pairs;
where the hashes of different sets of one size collide, each keeps a representative of its own. Rows are told apart by
a row number, not by doc_id.

Defined results: null and empty texts and those without words have the empty set and link with nothing; repeated
rows are one node; rows with one doc_id and different texts, or without doc_id, are judged each; a null doc_id never is
the smallest unless no other is there; a text of any length is read whole (sets of MOST shingles and more are only not
parted by size); among ties the smallest doc_id names a component; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import bounded_sample, cut, free_name, look_up, numbered
from .text import MIX, by_slice, mixed, shingles_of, strings

WIDTH = 5
#: A level has 4^level segments of at most FULL shingles on average.
FULL = 0.4
#: Sets of up to so many shingles always index single shingles.
SMALL = 12
SINGLE = 63  # the level of single shingles
#: Documents in the sample for costs, and how many of them make a signature expensive.
SAMPLE_DOCS, EXPENSIVE = 2000, 4
SEEN = 200_000  # nodes a task remembers so as to index a copy once
GROUP = 8  # groups of more sets than that are large
HOT = 10_000  # sets: groups that are known to hold more are dealt over all tasks, as nothing is paired inside a large group
SPREAD = -1  # marks the rows of such groups
ROUNDS = 1  # of links to leaders
ROWS, TEXTS = 200_000, 5_000  # pairs, and texts to compare, for each task
CLOSEST = (2, 2, None)  # candidates for each set and block, in turn; the last turn takes all
BLOCK = 1000  # sets of a cluster that are held against each other at a time
SKETCH_BITS = 4096
# A node stands for the sets of one size and hash: the size, whether they are poor in segments, and the hash, in one
# number. Sets are told apart by a second hash of 63 bits; those of one node that differ have representatives of their own.
HASH_BITS = 43
POOR = 1 << HASH_BITS
SIZE_SHIFT = HASH_BITS + 1
MOST = (1 << (63 - SIZE_SHIFT)) - 1  # a node's size is at most this; sets of this size and more are never parted by size


def level_of(size: int) -> int:
    level = 0
    while (1 << 2 * level) * FULL < size:
        level += 1
    return level


def levels_for(size: int, numerator: int, denominator: int) -> list[int]:
    """Levels at which a set of this size can meet a similar one: those of the smaller set's size."""
    return list(range(level_of(-(-size * numerator // denominator)), level_of(size) + 1))


def most_differences(size: int, numerator: int, denominator: int) -> int:
    """Between a set and a similar one that is as large as it may be."""
    return (denominator - numerator) * (size + size * denominator // numerator) // (denominator + numerator)


def target(size, numerator: int, denominator: int):
    """Segments that a set indexes; works on numbers, arrays and columns of non-negative values."""
    largest = (size * denominator - size * denominator % numerator) / numerator
    both = (denominator - numerator) * (size + largest)
    return (both - both % (denominator + numerator)) / (denominator + numerator) + (size - size % 20) / 20 + 3


def signatures(keys: np.ndarray, offsets: np.ndarray, expensive: np.ndarray, numerator: int, denominator: int, whole: bool = False):
    """(signature, set number) rows of many sets given as sorted distinct hashes, and which sets are poor in segments.

    With ``whole``, all subsets and nothing else are indexed; the rows' turns (one for each level of a set) and the
    least number of subsets that each set has at any of its levels come instead of the poor sets.
    """
    sizes = np.diff(offsets)
    n = len(sizes)
    out_sig, out_set, out_turn = [], [], []
    single = (sizes > 0) & (sizes * numerator <= SMALL * denominator)
    poor = single.copy()
    subsets = np.full(n, 1 << 30)
    owner = np.repeat(np.arange(n), sizes)
    values = mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    place = mixed(keys + MIX) >> np.uint64(1)
    need = target(sizes, numerator, denominator).astype(np.int64)
    least = {int(s): levels_for(int(s), numerator, denominator) for s in np.unique(sizes) if s}
    for turn in range(2):  # a set has two levels at most
        level = np.full(n, -1)
        for s, levels in least.items():
            if turn < len(levels):
                level[sizes == s] = levels[turn]
        live = level[owner] >= 0
        if not live.any():
            break
        own = owner[live]
        segment = (place[live] & ((np.uint64(1) << (2 * level[own]).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        order = np.argsort(own << 40 | segment, kind="stable")
        own, segment, value = own[order], segment[order], values[live][order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])))
        count = np.diff(np.append(first, len(own)))
        total = np.add.reduceat(value, first)
        o, s = own[first], segment[first]
        tag = mixed((s.astype(np.uint64) + np.uint64(1)) * MIX + level[o].astype(np.uint64))
        sig = mixed(total + tag)
        if whole:
            subsets = np.where(level >= 0, np.minimum(subsets, np.bincount(o, minlength=n)), subsets)
            out_sig.append(sig)
            out_set.append(o)
            out_turn.append(np.full(len(o), turn))
            continue
        cheap = ~np.isin(sig, expensive) if len(expensive) else np.ones(len(sig), bool)
        reached = np.cumsum(cheap)
        before = reached - cheap - (reached - cheap)[np.searchsorted(o, o)]
        capacity = np.bincount(o[cheap], minlength=n)
        lacking = (level >= 0) & (capacity < need)
        poor |= lacking
        keep = cheap & (before < need[o]) | lacking[o]
        out_sig.append(sig[keep])
        out_set.append(o[keep])
        # one-deletion neighbourhoods count twice where two shingles or more are left to delete from
        double = np.bincount(o, 1 + (count >= 2), n)
        single |= lacking & (double < need)
        which = np.repeat(np.arange(len(first)), count)
        less = (lacking[o] & (count >= 2))[which]
        out_sig.append(mixed(total[which][less] - value[less] + tag[which][less]))
        out_set.append(o[which][less])
    if whole:
        rows = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((out_sig, np.uint64), (out_set, np.int64), (out_turn, np.int64))]
        return rows[0], rows[1], (rows[2], np.where(sizes > 0, subsets, 0))
    alone = single[owner]
    out_sig.append(mixed(values[alone] + np.uint64(SINGLE)))
    out_set.append(owner[alone])
    return np.concatenate(out_sig), np.concatenate(out_set), poor


def node_ids(keys: np.ndarray, offsets: np.ndarray, poor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node of each set, 0 for the empty one, and a second hash of it."""
    sizes = np.diff(offsets)

    def hashed(salt: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(keys + np.uint64(salt)), dtype=np.uint64)])
        return mixed(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64))

    found = (hashed(77) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return np.where(sizes > 0, np.minimum(sizes, MOST) << SIZE_SHIFT | poor * POOR | found, 0), (hashed(1 << 40) >> np.uint64(1)).astype(np.int64)


def _expensive(docs: DataFrame, numerator: int, denominator: int) -> np.ndarray:
    """Signatures that at least EXPENSIVE documents of a bounded sample share; docs: rid, text."""
    sample = bounded_sample(docs, ["rid"], SAMPLE_DOCS, 5)

    def each(part: pa.RecordBatch) -> pa.RecordBatch | None:
        offsets, keys = shingles_of(strings(part, "text"), WIDTH)
        sig, of, poor = signatures(keys, offsets, np.empty(0, np.uint64), numerator, denominator)
        _, first = np.unique(node_ids(keys, offsets, poor)[0], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(sig[np.isin(of, first)].view(np.int64))], ["sig"])

    rows = sample.select("text").mapInArrow(by_slice("text", each), "sig long").groupBy("sig").count().filter(F.col("count") >= EXPENSIVE).select("sig").toPandas()
    return np.sort(rows["sig"].to_numpy(np.int64).view(np.uint64))


def index_rows(docs: DataFrame, expensive: np.ndarray, numerator: int, denominator: int) -> DataFrame:
    """Signature rows (sig, node), and one row per row of docs (rid, text) with rid as sig, -1 - node as node, and the second hash.

    Expensive signatures are marked by SPREAD in place of the second hash: their groups are taken as large unread.
    """

    def run(batches):
        seen: dict[tuple[int, int], None] = {}

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            offsets, keys = shingles_of(strings(part, "text"), WIDTH)
            sig, of, poor = signatures(keys, offsets, expensive, numerator, denominator)
            nodes, second = node_ids(keys, offsets, poor)
            fresh = np.zeros(len(nodes), bool)
            for k, node in enumerate(zip(nodes.tolist(), second.tolist())):
                if node[0] and node not in seen:
                    fresh[k] = True
                    seen[node] = None
            while len(seen) > SEEN:
                del seen[next(iter(seen))]
            kept = fresh[of]
            mark = np.where(np.isin(sig[kept], expensive), SPREAD, 0) if len(expensive) else np.zeros(int(kept.sum()), np.int64)
            sig, of = sig[kept].view(np.int64), of[kept]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(sig), part.column("rid")]), pa.array(np.concatenate([nodes[of], -1 - nodes])), pa.array(np.concatenate([mark, second]))], ["sig", "node", "second"])

        yield from by_slice("text", each)(batches)

    return docs.select("rid", "text").mapInArrow(run, "sig long, node long, second long")


def whole_rows(texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """All subsets (sig, node, rid, turn, size) of the sets of texts (rid, node, text), and one row per set with its number of subsets as sig and turn -1."""

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, keys = shingles_of(strings(part, "text"), WIDTH)
        sig, of, (turn, subsets) = signatures(keys, offsets, np.empty(0, np.uint64), numerator, denominator, whole=True)
        every = np.concatenate([of, np.arange(part.num_rows)])
        columns = [np.concatenate([sig.view(np.int64), subsets.astype(np.int64)]), part.column("node").to_numpy()[every], part.column("rid").to_numpy()[every], np.concatenate([turn, np.full(part.num_rows, -1)]), np.diff(offsets)[every]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["sig", "node", "rid", "turn", "size"])

    return texts.select("rid", "node", "text").mapInArrow(by_slice("text", each), "sig long, node long, rid long, turn long, size long")


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _read_groups(numerator: int, denominator: int):
    """Over rows sorted by (sig, node): kind 0, documents (a = node, b = rid, n = second hash); kind 1, pairs of small groups
    with how many signatures they share here as n; kind 2, rows of large groups (a = node, b = sig). Only the last small group is held back.
    Rows that SPREAD marks come out as rows of large groups at once."""

    def made(kind: int, a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["kind", "a", "b", "n"])

    def run(batches):
        held_sig, held_node, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        last_node = None

        def flush(sig, node):
            first = _group_starts(sig)
            count = np.diff(np.append(first, len(sig)))
            small = np.repeat(count <= GROUP, count)
            if not small.all():
                yield made(2, node[~small], sig[~small], np.ones(int((~small).sum())))
            group, node = np.repeat(np.arange(len(first)), count)[small], node[small]
            size = np.minimum(node >> SIZE_SHIFT, MOST)
            pairs = []
            for k in range(1, GROUP):
                if len(node) > k:
                    ok = (group[k:] == group[:-k]) & ((size[k:] * numerator <= size[:-k] * denominator) | (size[k:] == MOST))
                    pairs.append(np.stack([node[:-k][ok], node[k:][ok]], axis=1))
            pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
            if len(pairs):
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                at = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
                yield made(1, pairs[at, 0], pairs[at, 1], np.diff(np.append(at, len(pairs))))

        for batch in batches:
            node = batch.column("node").to_numpy()
            is_doc = node < 0
            if is_doc.any():
                docs = batch.filter(pa.array(is_doc))
                yield made(0, -1 - docs.column("node").to_numpy(), docs.column("sig").to_numpy(), docs.column("second").to_numpy())
            hot = ~is_doc & (batch.column("second").to_numpy() == SPREAD)
            if hot.any():
                yield made(2, node[hot], batch.column("sig").to_numpy()[hot], np.ones(int(hot.sum())))
            rest = ~is_doc & ~hot
            sig, node = batch.column("sig").to_numpy()[rest], node[rest]
            sig, node = np.concatenate([held_sig, sig]), np.concatenate([held_node, node])
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            if large is not None and len(sig):  # the group that went on from the batch before
                on = int(np.searchsorted(sig != large, True)) if sig[0] == large else 0
                start = 1 if on and node[0] == last_node else 0
                if on > start:
                    yield made(2, node[start:on], sig[start:on], np.ones(on - start))
                if on == len(sig):
                    last_node = node[-1] if on else last_node
                    held_sig, held_node = sig[:0], node[:0]
                    continue
                if on or sig[0] != large:
                    large = None
                sig, node = sig[on:], node[on:]
            if not len(sig):
                continue
            at = _group_starts(sig)[-1]
            if len(sig) - at > GROUP:
                large, last_node = sig[-1], node[-1]
                held_sig, held_node = sig[:0], node[:0]
                yield from flush(sig, node)
            else:
                held_sig, held_node = sig[at:].copy(), node[at:].copy()
                if at:
                    yield from flush(sig[:at], node[:at])
        if len(held_sig):
            yield from flush(held_sig, held_node)

    return run


def _texts(docs: DataFrame, ids: DataFrame, n: int, most: int = 500_000) -> DataFrame:
    """rid and text of the given rows; ids (rid), at most n, are broadcast up to ``most``, and more are joined."""
    texts = docs.select("rid", "text")
    return texts.join(F.broadcast(ids), "rid", "left_semi") if n <= most else texts.join(ids, "rid", "left_semi")


def verify(docs: DataFrame, pairs: DataFrame, numerator: int, denominator: int, salts: int = 8, most: int = 500_000) -> DataFrame:
    """The pairs (a, b) of rows of docs (rid, text) whose shingle sets are similar enough.

    The leaders' texts are repeated over salts, so that a leader with very many members is dealt to several tasks.
    """
    n = pairs.count()
    tasks, wide = 1 + n // ROWS, 1 + n // TEXTS
    members = pairs.coalesce(tasks).select(F.col("a").alias("leader"), F.col("b").alias("rid"), F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("member"))
    leaders = members.select("leader", F.col("leader").alias("rid"), "salt", F.lit(0).alias("member")).distinct().coalesce(tasks)
    wanted = members.unionByName(leaders).coalesce(tasks)
    texts = _texts(docs, wanted.select("rid").distinct().coalesce(tasks), 2 * n, most)
    rows = wanted.join(texts, "rid").select("leader", "salt", "member", "rid", "text").coalesce(wide)
    rows = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")

    def run(batches):
        leader, own = None, None

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal leader, own
            offsets, keys = shingles_of(strings(part, "text"), WIDTH)
            a, b = [], []
            for k, (of, rid, member) in enumerate(zip(*(part.column(c).to_pylist() for c in ("leader", "rid", "member")))):
                found = keys[offsets[k] : offsets[k + 1]]
                if not member:
                    leader, own = of, found
                elif leader == of:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if both and denominator * both >= numerator * (len(own) + len(found) - both):
                        a.append(of)
                        b.append(rid)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        yield from by_slice("text", each)(batches)

    return rows.mapInArrow(run, "a long, b long").coalesce(wide)


def _stars(batches):
    """Over edges (a, b) of one task: each end but the least of its part, with that least end."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    ends = [(x, top(x)) for x in list(above)]
    found = np.array([e for e in ends if e[0] != e[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of the nodes of edges (a, b) that are not roots themselves.

    Each task joins the edges it holds, ROWS at most on average, into stars. One task's stars are the components; those
    of several tasks are joined further by alternating large-star and small-star steps until nothing changes.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "edges")
    tasks, state = 1 + edges.count() // ROWS, None
    if tasks == 1:
        return cut(edges.coalesce(1).mapInArrow(_stars, "a long, b long").withColumnsRenamed({"a": "node", "b": "root"}), "roots")
    edges = cut(edges.repartition(tasks, "a").mapInArrow(_stars, "a long, b long").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)
        edges = cut(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
        if state == tuple(now):
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        state = tuple(now)


def sketches(texts: DataFrame) -> DataFrame:
    """rid and sketch of texts (rid, text): for each of SKETCH_BITS cells of the universe, the parity of the set's shingles in it.

    The sketches of two sets differ in no more bits than the sets differ in shingles.
    """

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, keys = shingles_of(strings(part, "text"), WIDTH)
        owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        cell = (mixed(keys ^ np.uint64(0x5bd1e995)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(owner * SKETCH_BITS + cell, minlength=part.num_rows * SKETCH_BITS).astype(np.uint8) & 1
        bits = np.packbits(odd.reshape(part.num_rows, SKETCH_BITS), axis=1)
        return pa.RecordBatch.from_arrays([part.column("rid"), pa.array([x.tobytes() for x in bits], pa.binary())], ["rid", "sketch"])

    return texts.select("rid", "text").mapInArrow(by_slice("text", each, 1 << 20), "rid long, sketch binary")


def _near_blocks(numerator: int, denominator: int, closest: int | None):
    """Pairs (a, b) of rows of different components in two blocks (side 0 and 1, or 0 alone) whose sizes and sketches allow a link;
    with ``closest``, so many for each node of side 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        node, rid, root, side, above = (pdf[c].to_numpy() for c in ("node", "rid", "root", "side", "above"))
        size = node >> SIZE_SHIFT
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        out = []
        for i in left:
            small, big = np.minimum(size[i], size[right]), np.maximum(size[i], size[right])
            ok = right[(root[right] != root[i]) & ~(above[right] & above[i]) & ((small * denominator >= big * numerator) | (big == MOST))]
            if len(ok):
                far = np.bitwise_count(sketch[ok] ^ sketch[i]).sum(axis=1)
                most = (denominator - numerator) * (size[i] + size[ok]) // (denominator + numerator)
                near = (far <= most) | (np.maximum(size[i], size[ok]) == MOST)
                ok = ok[near]
                if closest and len(ok) > closest:
                    ok = ok[np.argsort(far[near], kind="stable")[:closest]]
                out.append(np.stack([np.minimum(rid[i], rid[ok]), np.maximum(rid[i], rid[ok])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _size(node: str):
    return F.shiftright(F.col(node), SIZE_SHIFT)


def _is_poor(node: str):
    return F.col(node).bitwiseAND(F.lit(POOR)) != 0


def _sharing(shared: DataFrame, large: DataFrame, least, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) that share ``least`` signatures or more, counting all that one of the two may have in large groups.

    shared: a, b, n; large: node, n; least: a column over a, b and the columns that ``large`` adds for either side.
    """
    pairs = shared.groupBy("a", "b").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(large.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in large.columns if c != "node")), side, "left")
    hidden = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    return pairs.filter((F.col("n") + hidden >= least) | (_size("a") == MOST) | (_size("b") == MOST)).select("a", "b")


def jaccard_classes(docs: DataFrame, numerator: int = 3, denominator: int = 4) -> DataFrame:
    """Per row of docs (rid, unique, and text): rid, n_shingles, and root, the same for all rows of a component; null for the empty set."""
    differ = lambda r, s: F.floor((denominator - numerator) * (r + s) / (denominator + numerator))
    must = lambda r, s: target(r, numerator, denominator) - differ(r, s)
    dealt = F.when((F.col("second") == SPREAD) & (F.col("node") >= 0), F.xxhash64("sig", "node")).otherwise(F.col("sig"))
    grouped = lambda rows: rows.repartition(dealt).sortWithinPartitions("sig", "node").mapInArrow(_read_groups(numerator, denominator), "kind byte, a long, b long, n long")
    in_large = lambda rows: rows.filter("kind = 2").select(F.col("b").alias("sig"), F.col("a").alias("node"))
    size, small, big = _size("node"), F.least(_size("a"), _size("b")), F.greatest(_size("a"), _size("b"))
    upper, lower = F.floor(size * denominator / numerator), F.ceil(size * numerator / denominator)
    docs = docs.select("rid", "text")

    # all sets, by as many segments as their sizes need
    found = cut(grouped(index_rows(docs, _expensive(docs, numerator, denominator), numerator, denominator)), "jaccard")
    nodes = found.filter("kind = 0").select(F.col("b").alias("rid"), F.col("a").alias("node"), F.col("n").alias("second"))
    sets = cut(nodes.filter("node <> 0").groupBy("node", "second").agg(F.min("rid").alias("rid"), F.count("*").alias("k")), "reps")
    n_sets = sets.count()
    tasks = 1 + n_sets // ROWS
    sets = sets.coalesce(tasks)
    reps = sets.drop("k")
    large = cut(in_large(found).groupBy("node").agg(F.count("*").alias("n")).coalesce(tasks), "large")
    unsafe = large.filter(_is_poor("node") | (F.col("n") >= F.least(must(size, upper), must(lower, size))) | (size == MOST)).select("node")
    pairs = _sharing(found.filter("kind = 1").select("a", "b", "n"), large, F.when(_is_poor("a") & _is_poor("b"), 1).otherwise(must(small, big)), numerator, denominator)

    # sets with too many signatures in large groups: by their rarest segments, one more than may differ
    again = cut(unsafe.join(reps, "node").select("node", "rid").coalesce(tasks), "unsafe")
    texts = _texts(docs, again.select("rid"), n_sets).join(again, "rid")
    whole = cut(whole_rows(texts, numerator, denominator), "whole")
    tokens = whole.filter("turn >= 0")
    counts = tokens.groupBy("sig").agg(F.count("*").alias("n"))
    order = W.partitionBy("rid", "turn").orderBy("n", "sig")  # a set's own segments of one level
    own, most = F.col("size"), differ(F.col("size"), F.floor(F.col("size") * denominator / numerator))
    rare = tokens.join(counts, "sig").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most + 1).select("sig", "node", F.when(F.col("n") > HOT, SPREAD).otherwise(0).cast("long").alias("second"))
    found_again = cut(grouped(rare), "jaccard-rare")
    pairs = pairs.unionByName(found_again.filter("kind = 1").select("a", "b")).distinct()

    # from nodes to rows: the representatives of either node, and those of one node that hold different sets
    as_rows = pairs.join(reps.select(F.col("node").alias("a"), F.col("rid").alias("x")), "a").join(reps.select(F.col("node").alias("b"), F.col("rid").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    shared = reps.groupBy("node").agg(F.sort_array(F.collect_set("rid")).alias("rids")).filter(F.size("rids") > 1)  # sets of one size whose hashes collide
    shared = shared.select(F.explode("rids").alias("a"), "rids").select("a", F.explode("rids").alias("b")).filter("a < b")
    links = cut(verify(docs, cut(as_rows.unionByName(shared).coalesce(tasks), "pairs"), numerator, denominator), "links")

    # those left share even their rarest segments with many (near copies of one text): clusters of sets that share any,
    # in which links to a few leaders come first, and sets that are still apart are held against each other by sketches
    helpless = whole.filter((F.col("turn") < 0) & (F.col("sig") <= most) & (own > 0)).select("node").distinct()
    rows = in_large(found_again).unionByName(in_large(found).join(helpless, "node", "left_semi")).distinct()
    star = rows.join(rows.groupBy("sig").agg(F.min("node").alias("lead")), "sig").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    clusters = components(star).withColumnRenamed("root", "cluster")
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster")).distinct()
    band = F.floor(F.log(_size("node").cast("double")) / math.log(denominator / numerator))
    clusters = cut(clusters.join(reps, "node").select("rid", "node", "cluster", band.alias("band")).coalesce(tasks), "clusters")
    roots = components(links)
    if not clusters.limit(1).count():
        return _placed(nodes, sets, roots, docs)
    place = lambda: clusters.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    for turn in range(ROUNDS):
        placed = place()
        leaders = placed.groupBy("cluster", "band").agg(F.min_by(F.struct("rid", "root"), F.xxhash64("node", F.lit(turn))).alias("lead"))
        leaders = leaders.select("cluster", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "lead")
        led = placed.join(leaders, ["cluster", "band"]).filter((F.col("root") != F.col("lead.root")) & (F.col("rid") != F.col("lead.rid")))
        new = cut(verify(docs, cut(led.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b")).distinct(), "pairs"), numerator, denominator), "links")
        links = links.unionByName(new)
        roots = components(links)
    drawn = None
    for closest in CLOSEST:
        placed = place()
        open_ = placed.groupBy("cluster").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("cluster")
        # similar sets are of one size band or of neighbouring ones: a band is held against itself and the band above
        placed = placed.join(open_, "cluster").withColumn("low", F.explode(F.array("band", F.col("band") - 1)))
        blocks = placed.groupBy("cluster", "low").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("band").alias("least"), (F.min("root") != F.max("root")).alias("open"))
        placed = cut(placed.join(blocks.filter("open and least = low").drop("open", "least"), ["cluster", "low"]).coalesce(tasks), "open")
        n = placed.count()
        if not n:
            break
        if drawn is None:
            drawn = cut(sketches(_texts(docs, placed.select("rid").distinct(), n)), "sketches")
        rows = placed.join(drawn, "rid").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("cluster", "low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "rid", "root", (F.col("band") > F.col("low")).alias("above"), "sketch")
        near = cut(rows.groupBy("cluster", "low", "i", "j").applyInPandas(_near_blocks(numerator, denominator, closest), "a long, b long").distinct(), "pairs")
        new = cut(verify(docs, near, numerator, denominator), "links")
        links = links.unionByName(new)
        roots = components(links)
    return _placed(nodes, sets, roots, docs)


def _placed(nodes: DataFrame, sets: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """rid, n_shingles, root of every row.

    Only sets that have several rows or another root than their representative are looked up; sets that one row alone
    holds and nothing links are their own root. A set that very many rows hold is looked up by salted keys.
    """
    sets = sets.join(roots.withColumnRenamed("node", "rid"), "rid", "left").filter("k > 1 or root is not null").select("node", "second", F.coalesce("root", "rid").alias("root"))
    out = look_up(nodes, cut(sets, "sets"), ["node", "second"], "left")
    out = out.select("rid", _size("node").alias("n_shingles"), F.when(F.col("node") != 0, F.coalesce("root", "rid")).alias("root"))

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("rid"), pa.array(np.diff(shingles_of(strings(part, "text"), WIDTH)[0]))], ["rid", "true_size"])

    if not nodes.filter(_size("node") == MOST).limit(1).count():
        return out
    sizes = docs.join(nodes.filter(_size("node") == MOST).select("rid"), "rid", "left_semi").mapInArrow(by_slice("text", each), "rid long, true_size long")
    return out.join(sizes, "rid", "left").select("rid", F.coalesce("true_size", "n_shingles").alias("n_shingles"), "root")


def jaccard_components(docs: DataFrame, numerator: int = 3, denominator: int = 4) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; sets link when intersection / union >= numerator / denominator."""
    rows = numbered(docs.select("doc_id", "text"), "rid")
    classes = cut(jaccard_classes(rows, numerator, denominator).join(rows.select("rid", "doc_id"), "rid"), "classes")
    least = classes.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return look_up(classes, cut(least, "least"), "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, numerator: int = 3, denominator: int = 4) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (null last; of equal ones the first read), all columns as they were; rows with the empty set stay."""
    name = free_name(docs.columns, "rid")
    rows = numbered(docs, name)
    ids = rows.select(F.col(name).alias("rid"), F.col("doc_id").alias("doc"))
    classes = cut(jaccard_classes(rows.select(F.col(name).alias("rid"), "text"), numerator, denominator).filter("root is not null").join(ids, "rid"), "classes")
    kept = classes.groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc").isNull(), "doc", "rid")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    dropped = look_up(classes, cut(kept, "kept"), "root").filter("rid <> kept").select(F.col("rid").alias(name))
    return rows.join(dropped, name, "left_anti").drop(name)
