"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nyström landmarks.

Units are words without punctuation, and runs of three or more single letters read as one word ("l o s e r").
The kernel compares units by their subsequences of four characters with up to three characters between them, each
gap costing a factor; word borders count as characters. So inserted characters and gaps lower the value instead
of breaking the match. Landmarks are units of the training sentences; in their Nyström space a linear machine with
squared hinge loss is trained on units that take the labels of the sentences they stand in. As the kernel is an
inner product of hashed subsequence vectors, the trained machine folds into one table of weights, and a unit's
value costs a few look-ups. Labels are those of documents, as no sentence has one: the kernel compares units and not
whole sentences, in which one insult is a small share of the subsequences. A sentence has the value of its strongest unit; a document's score is a calibrated
function of its strongest sentences and of how dense strong units are. Labels are read for training only; lang, source and doc_id never enter.

Defined results: null and empty texts get the score of a document without any sign of toxicity; without both
classes in the training rows the score is the share of toxic training rows (0 without any); repeated rows are
scored each; a very long text is read whole, in training too, alone in its slice; of units that tie at the sample's bound
the hash decides, and of equally strong sentences any one counts; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_sample, cut
from .text import by_slice, strings, words_of

BITS = 18
SPAN = 6  # the last of four characters stands at most so far behind the first
DECAY = 0.7  # per character between them
POWER = 0.25  # of the squared length by which vectors are divided: 0.5 would make all alike long, but a long suffix must not hide an insult
LONGEST, STRIDE = 32, 24  # a longer word is read in overlapping pieces
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
OFFSETS = [(a, b, c) for a, b, c in combinations(range(1, SPAN + 1), 3)]
FLOOR = -3.0  # value of a document without units
#: Bounds of the training sample: documents of either class, distinct units of their whole texts, landmarks.
TOXIC_DOCS, CLEAN_DOCS, UNITS, LANDMARKS = 2000, 4000, 30_000, 512
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Per text: offsets into the unit codes; the codes, the distinct units, and the sentence number of each unit."""
    offsets, codes, distinct = words_of(texts, lower=False)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pN]+", "")
    sizes = np.asarray(pc.utf8_length(plain), dtype=np.int64)
    ends = np.asarray(pc.match_substring_regex(distinct, r"[.!?]\W*$"), dtype=bool)
    units = plain.to_pylist()
    sentence = np.concatenate([[0], np.cumsum(ends[codes])])[:-1] if len(codes) else codes
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    extra_codes, extra_owner, extra_sentence, extra = [], [], [], {}
    if len(codes):
        single = sizes[codes] == 1
        run = np.flatnonzero(single[1:] & single[:-1] & (owner[1:] == owner[:-1])) + 1
        for chain in np.split(run, np.flatnonzero(np.diff(run) > 1) + 1) if len(run) else ():
            if len(chain) >= 2:
                word = "".join(units[c] for c in codes[chain[0] - 1 : chain[-1] + 1])
                extra_codes.append(len(units) + extra.setdefault(word, len(extra)))
                extra_owner.append(owner[chain[0]])
                extra_sentence.append(sentence[chain[0]])
    pieces: dict[int, list[int]] = {}
    for i in np.flatnonzero(sizes[codes] > LONGEST) if len(codes) else ():  # further pieces of long words
        if (parts := pieces.get(codes[i])) is None:
            word = units[codes[i]]
            parts = pieces[codes[i]] = [len(units) + extra.setdefault(word[at : at + LONGEST], len(extra)) for at in range(0, len(word), STRIDE)]
        extra_codes += parts
        extra_owner += [owner[i]] * len(parts)
        extra_sentence += [sentence[i]] * len(parts)
    if extra:
        units = [u if s <= LONGEST else "" for u, s in zip(units, sizes)] + list(extra)
        codes, owner, sentence = np.append(codes, extra_codes), np.append(owner, extra_owner), np.append(sentence, extra_sentence)
        order = np.argsort(owner, kind="stable")
        codes, owner, sentence = codes[order], owner[order], sentence[order]
    full = np.fromiter(map(bool, units), bool, len(units))
    kept = full[codes] if len(codes) else np.zeros(0, bool)
    codes, owner, sentence = codes[kept].astype(np.int64), owner[kept], sentence[kept]
    return np.searchsorted(owner, np.arange(n + 1)), codes, units, sentence


class Subsequences:
    """The hashed subsequences of many units: for each offset triple, keys and which positions are whole."""

    def __init__(self, units: list[str]):
        joined = "".join(f"\x02{u}\x03" for u in units)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 2
        ends = np.cumsum(lengths)
        self.starts, self.n = ends - lengths, len(units)
        self.left = (np.repeat(ends, lengths) - np.arange(len(points))).astype(np.int32)  # positions up to the unit's end
        padded = np.concatenate([points, np.zeros(SPAN, np.uint32)])
        self.parts = [padded * f for f in FACTORS]
        room = lengths[:, None] - np.arange(SPAN + 1)
        self.norm = (1e-9 + sum(DECAY ** (2 * (c - 3)) * np.maximum(room[:, c], 0) for _, _, c in OFFSETS)) ** POWER

    def each(self):
        a, b, c, d = self.parts
        size = len(self.left)
        for i, j, k in OFFSETS:
            key = a[:size] + b[i : i + size] + c[j : j + size] + d[k : k + size]
            key ^= key >> np.uint32(15)
            yield key * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), self.left > k, DECAY ** (k - 3)

    def values(self, table: np.ndarray) -> np.ndarray:
        """Inner product of each unit's normalised vector with ``table``."""
        total = np.zeros(len(self.left), np.float32)
        for key, whole, weight in self.each():
            total += table[key] * (whole * np.float32(weight))
        return np.add.reduceat(total, self.starts) / self.norm if self.n else np.zeros(0)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, key, value) of all subsequences, normalised."""
        owner = np.repeat(np.arange(self.n), np.diff(np.append(self.starts, len(self.left))))
        found = [(owner[w], k[w], np.full(int(w.sum()), v)) for k, w, v in self.each()]
        o, k, v = (np.concatenate(x) for x in zip(*found))
        return o, k, v / self.norm[o]


class Landmarks:
    """Landmark units as columns of a matrix over the subsequences that occur in them."""

    def __init__(self, units: list[str]):
        owner, key, value = Subsequences(units).entries()
        self.keys, row = np.unique(key, return_inverse=True)
        self.matrix = np.zeros((len(self.keys), len(units)), np.float32)
        np.add.at(self.matrix, (row, owner), value)
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.keys] = np.arange(len(self.keys))

    def kernel(self, units: list[str], step: int = 100) -> np.ndarray:
        """Kernel of units with the landmarks."""
        out = np.zeros((len(units), self.matrix.shape[1]), np.float32)
        for at in range(0, len(units), step):
            o, k, v = Subsequences(units[at : at + step]).entries()
            p = self.place[k]
            hit = np.flatnonzero(p >= 0)
            hit = hit[np.argsort(o[hit], kind="stable")]
            o, p, v = o[hit], p[hit], v[hit].astype(np.float32)
            if len(o):
                first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                out[at + o[first]] = np.add.reduceat(self.matrix[p] * v[:, None], first, axis=0)
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """One weight per hashed subsequence: the machine with these weights on the landmarks."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.keys] = self.matrix @ weights
        return table


def squared_hinge(x: np.ndarray, bad: np.ndarray, fine: np.ndarray, penalty: float = 0.01, rounds: int = 15) -> np.ndarray:
    """Primal Newton steps for units that weigh ``bad`` as toxic and ``fine`` as not; the last entry is the bias, which is hardly penalised."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    value, w = np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(rounds):
        up, down = bad * (value < 1), fine * (value > -1)
        gram, right = np.diag(ridge), np.zeros(x.shape[1])
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            gram += (part * (up + down)[at : at + 4096, None].astype(x.dtype)).T @ part
            right += part.T @ (up - down)[at : at + 4096]
        before, w = w, np.linalg.solve(gram, right)
        value = x @ w
        if np.abs(w - before).max() < 1e-6 * max(1.0, np.abs(w).max()):
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


SIGNS = 5


def signs(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: the values of its three strongest sentences, and on a logarithmic scale the mean over all units of what their values exceed 0 and 0.4 by."""
    offsets, codes, units, sentence = units_of(texts)
    n = len(offsets) - 1
    out = np.zeros((n, SIGNS))
    out[:, :3] = FLOOR
    if len(codes):
        value = np.maximum(Subsequences(units).values(table) + bias, FLOOR)[codes]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        order = np.lexsort((sentence, owner))
        o, s, v = owner[order], sentence[order], value[order]
        first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
        best, who = np.maximum.reduceat(v, first), o[first]
        order = np.lexsort((-best, who))
        best, who = best[order], who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        for k in range(3):
            out[who[place == k], k] = best[place == k]
        total = np.maximum(np.diff(offsets), 1)
        for k, least in ((3, 0.0), (4, 0.4)):
            out[:, k] = np.log1p(100 * np.bincount(owner, np.maximum(value - least, 0), n) / total)
    return out


def choose_landmarks(units: list[str], bad: np.ndarray, fine: np.ndarray, n_bad: int, n_fine: int, landmarks: int) -> list[str]:
    """Half of the landmarks cover the subsequences that set toxic sentences apart, best first; the rest are spread over all units by frequency."""
    keys, owners = [], []
    for at in range(0, len(units), 4000):
        o, k, _ = Subsequences(units[at : at + 4000]).entries()
        both = np.unique((o + at) << BITS | k)
        keys.append(both & ((1 << BITS) - 1))
        owners.append(both >> BITS)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    a, b = np.bincount(key, bad[owner], 1 << BITS), np.bincount(key, fine[owner], 1 << BITS)
    sign = (a - b) / np.sqrt(a / n_bad + b / n_fine + 1 / (n_bad * n_fine))
    order = np.lexsort((-(bad - fine)[owner], key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    best_unit = dict(zip(key[first].tolist(), owner[first].tolist()))
    chosen: dict[int, None] = {}
    for k in np.argsort(-sign, kind="stable"):
        if len(chosen) >= landmarks // 2 or sign[k] <= 0:
            break
        if int(k) in best_unit:
            chosen[best_unit[int(k)]] = None
    rest = np.setdiff1d(np.arange(len(units)), list(chosen))
    spread = rest[np.linspace(0, len(rest) - 1, min(len(rest), landmarks - len(chosen))).astype(int)] if len(rest) else rest
    return [units[k] for k in [*chosen, *spread]]


class Model:
    """The folded weights, and the calibration of a document's signs."""

    def __init__(self, table: np.ndarray | None, bias: float, calibration: np.ndarray | None, share: float):
        self.table, self.bias, self.calibration, self.share = table, bias, calibration, share

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        x = signs(texts, self.table, self.bias)
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.calibration, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> DataFrame:
    """text and toxic of a bounded sample of the labelled rows that are not held out, chosen by a hash of the id."""
    rows = labels.filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").distinct()
    sample = bounded_sample(rows.filter("toxic = 1"), ["doc_id"], toxic_docs, 11).unionByName(bounded_sample(rows.filter("toxic = 0"), ["doc_id"], clean_docs, 11))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # a bounded number of ids


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, max_units: int = UNITS, landmarks: int = LANDMARKS) -> Model:
    """Trains on about toxic_docs + clean_docs labelled documents at most, their whole texts, and ``max_units`` distinct units."""
    sample = cut(training_rows(docs, labels, toxic_docs, clean_docs), "toxic-sample")

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, codes, units, _ = units_of(strings(part, "text"))
        owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        pairs = np.unique(owner * (len(units) + 1) + codes)
        o, c = pairs // (len(units) + 1), pairs % (len(units) + 1)
        toxic = np.asarray(part.column("toxic"), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(units, pa.string()).take(pa.array(c)), pa.array(toxic[o])], ["unit", "toxic"])

    counted = sample.mapInArrow(by_slice("text", each), "unit string, toxic long").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    if len(size) < 2:
        return Model(None, 0.0, None, share)
    ratio = size[0] / size[1]
    rows = counted.orderBy((F.col("bad") * ratio + F.col("fine")).desc(), F.xxhash64("unit")).limit(max_units).toPandas()
    units, bad, fine = rows["unit"].tolist(), rows["bad"].to_numpy(float) / size[1], rows["fine"].to_numpy(float) / size[0]
    marks = choose_landmarks(units, bad, fine, size[1], size[0], landmarks)
    space = Landmarks(marks)
    inner = space.kernel(marks).astype(float)
    values, basis = np.linalg.eigh((inner + inner.T) / 2 + 1e-3 * np.eye(len(marks)))
    root = basis / np.sqrt(np.maximum(values, 1e-3))
    x = space.kernel(units) @ root.astype(np.float32)
    scale = 1000.0
    w = squared_hinge(x, bad * scale, (2 * fine + 0.5 / size[0]) * scale)
    table = space.folded(root @ w[:-1])
    bias = float(w[-1])

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        s = signs(strings(part, "text"), table, bias)
        return pa.RecordBatch.from_arrays([*(pa.array(s[:, k]) for k in range(SIGNS)), part.column("toxic")], [*(f"s{k}" for k in range(SIGNS)), "toxic"])

    found = sample.mapInArrow(by_slice("text", measure), ", ".join(f"s{k} double" for k in range(SIGNS)) + ", toxic int").toPandas()
    calibration = logistic(found[[f"s{k}" for k in range(SIGNS)]].to_numpy(), found["toxic"].to_numpy(float))
    return Model(table, bias, calibration, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(strings(part, "text")))], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(by_slice("text", each), "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
