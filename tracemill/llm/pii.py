"""Personal data: exact base spans, high-recall candidates, and boosted trees that decide on the candidates.

Generators propose spans of every kind that the base patterns miss, and these may overlap: written-out addresses,
runs of four numbers inside longer dotted runs or with marked dots, card numbers inside longer runs of digits or with
other separators, telephone numbers inside matches that failed, after 00 or without a prefix. Boosted trees judge them
by format and context.

Nobody labels such spans, so labels come from the base spans, which are personal data by definition. Each is put back
into its place in another guise (``disguises``), the generators run over the result, and the candidate that is exactly
the disguised span is a positive, while those that overlap it in part are negatives. Negatives of each kind too are
candidates that lie across base spans of the text as it is, and those in look-alikes put at the same place: prose with a
bracketed word, versions and section numbers, long digit runs, dates and amounts (``look_alikes``). Trees are fitted on
a bounded sample of these candidates. The threshold of each kind is set on all held-out candidates of all documents, from
a histogram of scores: the least one at which the share of negatives among the accepted is at most ERROR. Accepted
candidates are added best first where they overlap neither a base span nor each other.

Defined results: null and empty texts have no spans; base spans always stay; without both classes in the sample, or
where no threshold of a kind keeps the errors down, nothing of it is added; of candidates with one score the one that
starts first, then the longer one, then the kind listed first goes first; repeated rows and rows with one doc_id are
handled each; a very long text is read whole, alone in its slice; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_sample, cut
from .text import by_slice, strings

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit before: a run of digits that fails from its first digit fails from any, so the rest of it need not be tried.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
LONG_DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Generators of candidates.
AT, DOT = r"(?: ?[(\[{<] ?at ?[)\]}>] ?| at )", r"(?: ?[(\[{<] ?dot ?[)\]}>] ?| dot |\. ?)"
SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
MARKED_AT = re.compile(r"[(\[{<] ?at ?[)\]}>]", re.I)
DIGIT = re.compile(r"[0-9]")
MARKED_DOTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[(\[{] ?(?:\.|dot) ?[)\]}] ?[0-9]{1,3}){3}(?![0-9])", re.I)
NUMBERS = re.compile(r"[0-9]++")
SEPARATED = re.compile(r"(?<![0-9])[0-9]{3,6}(?:[./_][0-9]{3,6}){2,4}(?![0-9])")
GROUPED = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")
PREFIXED = re.compile(r"(?<![0-9A-Za-z+])00[1-9][0-9 ().-]{7,20}[0-9](?![0-9A-Za-z])")
HINTS = re.compile(r"mail|phone|tel|call|fax|card|visa|ip|host|contact|kontakt|carte|tarjeta|server|address|number", re.I)
CARD_LENGTHS = range(13, 20)
#: Candidates in the training sample, the share of negatives among the accepted, bins of the histogram of scores, and the least threshold.
SAMPLE, ERROR, BINS, LEAST = 20_000, 0.01, 1000, 0.5
#: Positives among the accepted from which on a single negative does not count.
ENOUGH = 20
ITEM = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("features", pa.list_(pa.float32()))]
EXAMPLE = [("kind", pa.int32()), ("label", pa.float32()), ("features", pa.list_(pa.float32()))]
FOUND = "doc_id long, base array<struct<kind:int,start:long,end:long,features:array<float>>>, wide array<struct<kind:int,start:long,end:long,features:array<float>>>, examples array<struct<kind:int,label:float,features:array<float>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base spans, and of the matches that failed their check."""
    good, failed = [], []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > end and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                good.append((0, at, m.end()))
                end = m.end()
    numbered = DIGIT.search(text) is not None
    for m in DOTTED.finditer(text) if numbered else ():
        fine = all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))
        (good if fine else failed).append((1, m.start(), m.end()))
    for m in DIGITS.finditer(text) if numbered else ():
        if m.end() - m.start() >= 12:
            d = only_digits(m[0])
            (good if 12 <= len(d) <= 19 and luhn(d) else failed).append((2, m.start(), m.end()))
    if "+" in text:
        for m in PLUS.finditer(text):
            (good if 9 <= len(only_digits(m[0])) <= 15 else failed).append((3, m.start(), m.end()))
    return good, failed


def _inner_spans(kind: int, text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Candidates inside a base match that failed its check."""
    groups = [(m.start(), m.end()) for m in NUMBERS.finditer(text, start, end)]
    if kind == 1:
        for k in range(len(groups) - 3):
            if all(b - a <= 3 and int(text[a:b]) <= 255 for a, b in groups[k : k + 4]):
                yield 1, groups[k][0], groups[k + 3][1]
    elif kind == 2:
        for k in range(len(groups)):  # whole groups of digits that make up 13 to 19
            n = 0
            for j in range(k, len(groups)):
                a, b = groups[j]
                n += b - a
                if n >= CARD_LENGTHS.stop:
                    break
                if n in CARD_LENGTHS and (groups[k][0], b) != (start, end) and luhn(only_digits(text[groups[k][0] : b])):
                    yield 2, groups[k][0], b
    elif kind == 3:
        n = 0
        for a, b in groups:
            n += b - a
            if n > 15:
                break
            if n >= 9:
                yield 3, start, b


def wide_spans(text: str, failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base patterns, overlapping ones too, in order; failed: base matches that failed."""
    out = set()
    low = text.lower()
    if MARKED_AT.search(text) or ("dot" in low and " at " in low):
        for m in SPELLED.finditer(text):
            whole = m[0]
            out.add((0, m.start(), m.end()))
            ends = [k.start() for k in re.finditer(DOT, whole, re.I)][1:]
            out.update((0, m.start(), m.start() + e) for e in ends)
    if not DIGIT.search(text):
        return sorted(out)
    out.update((1, m.start(), m.end()) for m in MARKED_DOTS.finditer(text))
    for kind, a, b in failed:
        out.update(_inner_spans(kind, text, a, b))
    # longer dotted runs than four parts hold further windows, which the base pattern passes over
    for m in LONG_DOTTED.finditer(text):
        out.update(_inner_spans(1, text, m.start(), m.end()))
    for m in SEPARATED.finditer(text):
        digits = only_digits(m[0])
        if len(digits) in CARD_LENGTHS and luhn(digits):
            out.add((2, m.start(), m.end()))
    for pattern in (GROUPED, PREFIXED):
        out.update((3, m.start(), m.end()) for m in pattern.finditer(text) if 7 <= len(only_digits(m[0])) <= 17)
    return sorted(out)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = only_digits(span)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    near, then = text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    words = re.findall(r"[^\W\d_]+", span)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(digits)),
        float(min(end - start, 1000)),
        float(min(len(groups), 1000)),
        float(max(sizes) - min(sizes)),
        float(sizes[0]),
        float(sizes[-1]),
        float(len(set(digits))),
        float("+" in span[:1]),
        float(span[:2] == "00"),
        float("(" in span),
        float("." in span),
        float("-" in span),
        float(len(re.findall(r"[(\[{<] ?(?:at|dot) ?[)\]}>]", span, re.I))),
        float(len(re.findall(r" (?:at|dot) ", span, re.I))),
        float(len(re.findall(r"\. ", span))),
        float(max(map(len, words), default=0)),
        float(len(words[-1]) if words else 0),
        float(len(re.findall(r"\.|[(\[{< ]dot[)\]}> ]", re.split(r"(?i)[(\[{< ]at[)\]}> ]", span)[-1], re.I))),
        float(bool(re.match(r" ?(?:\.|[(\[{<] ?dot|dot) ?[^\W_]", then, re.I))),
        float(bool(re.search(r"[A-Z]", span))),
        float(bool(re.search(r"[._%+-]", re.split(r"(?i)[ (\[{<]at", span)[0])) and kind == 0),
        float(bool(digits) and luhn(digits)),
        float(all(s < 4 and int(g) <= 255 for s, g in zip(sizes, groups))),
        float(before.isalnum()),
        float(after.isalnum()),
        float(bool(re.search(r"[0-9][ ().-]*$", near))),
        float(bool(re.search(r"^[ ().-]*[0-9]", then))),
        float(len(only_digits(re.search(r"[0-9 ().-]*$", near)[0]))),
        float(len(only_digits(re.match(r"[0-9 ().-]*", then)[0]))),
        float(bool(re.search(r"\+[0-9 ().-]*$", near))),
        float(bool(re.search(r"(?:v|version|section|release|§)\.? ?$", near, re.I))),
        float(bool(HINTS.search(near))),
    ]


class Cover:
    """Places of a text that spans have taken, as disjoint intervals in order."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        """Takes a place that meets none before."""
        k = bisect_left(self.starts, b)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def disguises(kind: int, span: str, seed: int) -> list[str]:
    """Other guises of a base span that keep it personal data; the span itself is at the place of the mark \x00...\x01."""
    digits = only_digits(span)
    if kind == 0:
        name, _, host = span.partition("@")
        left, right = ("()", "[]", "{}", "<>")[seed % 4]
        dotted = host.split(".")
        short, ends = re.sub("[^A-Za-z]", "", name)[: 3 + seed % 7] or name, dotted[-2:]
        plainer = [f"\x00{short} {left}at{right} {'.'.join(ends)}\x01", f"\x00{short}{left}at{right}{f'{left}dot{right}'.join(ends)}\x01", f"\x00{name} at {' dot '.join(ends)}\x01"]
        return [*plainer, f"\x00{name} {left}at{right} {host}\x01", f"\x00{name}{left}at{right}{f'{left}dot{right}'.join(dotted)}\x01", f"\x00{name} at {' dot '.join(dotted)}\x01"]
    if kind == 1:
        return [f"{256 + seed % 700}.\x00{span}\x01", f"\x00{'[.]'.join(span.split('.'))}\x01"]
    if kind == 2:
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        more = f"{seed % 90000 + 10000}"
        return [f"{more} \x00{digits}\x01", f"\x00{digits}\x01 {more}", f"{more} \x00{' '.join(four)}\x01", f"\x00{'.'.join(four)}\x01"]
    plain = span.lstrip("+")
    national = plain.split(" ", 1)[1] if " " in plain and len(only_digits(plain.split(" ", 1)[1])) >= 7 else plain
    sizes, at, groups = ((2, 1, 3, 4), (2, 3, 3, 4), (1, 3, 3, 4), (3, 2, 3, 2), (2, 2, 3, 4), (2, 4, 6))[seed % 6], 0, []
    for n in sizes:
        groups.append(digits[at : at + n])
        at += n
    groups = [g for g in [*groups[:-1], groups[-1] + digits[at:]] if g]
    return [f"\x0000{' '.join(groups)}\x01", f"\x0000{'-'.join(groups)}\x01", f"\x00{national}\x01", f"\x0000{plain}\x01", f"\x00{span}\x01 {seed % 900 + 100} {seed % 97}", f"\x00{span}\x01 {seed % 200}.{seed % 100}.{seed % 50}.7"]


def look_alikes(kind: int, before: str, seed: int) -> list[str]:
    """What is formatted like personal data of a kind and is none, of words of the text before."""
    words = re.findall(r"[^\W\d_]{2,}", before) or ["word"]
    w = lambda k: words[(seed >> k) % len(words)]
    if kind == 0:
        return [f"{w(1)} (at) {w(2)}. {w(3).title()}", f"{w(1)} at {w(3)} dot {w(2)}", f"{w(2)} [at] {w(3)}"]
    if kind == 1:
        return [f"version {seed % 9}.{seed % 20}.{seed % 30}.{seed % 7}.{seed % 11}", f"section {seed % 9 + 1}.{seed % 7}.{seed % 5}.{seed % 3 + 1}.{seed % 4}", f"{300 + seed % 600}.{seed % 9}.{seed % 31}.{seed % 27}.{seed % 13}.{seed % 19}.{seed % 5}"]
    if kind == 2:
        many = f"{seed * 2654435761 % 10**20:020d}{seed * 40503 % 10**20:020d}"
        return [many[:26], " ".join(many[k : k + 4] for k in range(0, 40, 4)), " ".join(many[k : k + 5] for k in range(0, 40, 5)), f"{many[:9]} {many[9:16]} {many[16:24]}"]
    return [f"20{seed % 30:02d}-{seed % 12 + 1:02d}-{seed % 28 + 1:02d} {seed % 24:02d}.{seed % 60:02d}", f"{seed % 900 + 100} {seed % 1000:03d} {seed // 7 % 1000:03d}", f"{seed % 28 + 1:02d}.{seed % 12 + 1:02d}.20{seed % 30:02d}", f"{seed % 256}.{seed // 3 % 256}.{seed // 5 % 256}.{seed // 7 % 256}", f"00{seed * 2654435761 % 10**14:014d}", f"00{seed * 40503 % 10**11:011d}"]


def examples_of(text: str, base: list[tuple[int, int, int]], wide: list[tuple[int, int, int]]) -> list[dict]:
    """Labelled candidates that the base spans of a text give."""
    taken = Cover(base)
    out = [{"kind": k, "label": 0.0, "features": features(text, k, a, b)} for k, a, b in wide if taken.meets(a, b)]
    for kind, start, end in base:
        before, after = text[max(0, start - 60) : start], text[end : end + 60]
        seed = zlib.crc32(text[start:end].encode())
        for n, guise in enumerate(disguises(kind, text[start:end], seed)):
            a, b = len(before) + guise.index("\x00"), len(before) + guise.index("\x01") - 1
            made = before + guise.replace("\x00", "").replace("\x01", "") + after
            good, failed = base_spans(made)
            taken = Cover(good)
            for k, c, d in wide_spans(made, failed):
                if c < b and a < d and not taken.meets(c, d):
                    out.append({"kind": k, "label": float((k, c, d) == (kind, a, b)), "features": features(made, k, c, d)})
        for guise in look_alikes(kind, before, seed):
            made, a = before + guise + after, len(before)
            good, failed = base_spans(made)
            taken = Cover(good)
            out += [{"kind": k, "label": 0.0, "features": features(made, k, c, d)} for k, c, d in wide_spans(made, failed) if c < a + len(guise) and a < d and not taken.meets(c, d)]
    return out


def find_spans(docs: DataFrame, examples: bool = True) -> DataFrame:
    """Base spans and wider candidates of every document with features, and the labelled candidates they give."""

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        base, wide, labelled = [], [], []
        for text in strings(part, "text").to_pylist():
            good, failed = base_spans(text)
            more = wide_spans(text, failed)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in good])
            wide.append([{"kind": k, "start": a, "end": b, "features": features(text, k, a, b)} for k, a, b in more])
            labelled.append(examples_of(text, good, more) if examples else [])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(base, pa.list_(pa.struct(ITEM))), pa.array(wide, pa.list_(pa.struct(ITEM))), pa.array(labelled, pa.list_(pa.struct(EXAMPLE)))],
            ["doc_id", "base", "wide", "examples"],
        )

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), FOUND)


class BoostedTrees:
    """Logistic boosting of trees of two levels."""

    def __init__(self, rounds: int = 120, rate: float = 0.2):
        self.rounds, self.rate, self.trees, self.start = rounds, rate, [], 0.0

    @staticmethod
    def split(codes, edges, gradient, weight):
        """Best feature and cut by second-order gain, from sums over the values of each feature."""
        best = (0.0, 0, np.inf)
        total_g, total_w = gradient.sum(), weight.sum()
        whole = total_g**2 / (total_w + 1)
        for f, cuts in enumerate(edges):
            if len(cuts):
                g, w = (np.cumsum(np.bincount(codes[:, f], v, len(cuts) + 1))[:-1] for v in (gradient, weight))
                gain = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(cuts[k]))
        return best[1:]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        values = [np.unique(x[:, f]) for f in range(x.shape[1])]
        edges = [(v[1:] + v[:-1])[:: max(1, len(v) // 256)] / 2 for v in values]
        codes = np.stack([np.searchsorted(cuts, x[:, f]) for f, cuts in enumerate(edges)], axis=1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            f, cut_at = self.split(codes, edges, gradient, weight)
            left, leaves = x[:, f] <= cut_at, []
            for side in (left, ~left):
                f2, cut2 = self.split(codes[side], edges, gradient[side], weight[side]) if side.any() else (0, np.inf)
                low = x[:, f2] <= cut2
                leaves.append((f2, cut2, *(float(gradient[side & s].sum() / (weight[side & s].sum() + 1)) for s in (low, ~low))))
            self.trees.append((f, cut_at, leaves))
            score += self.rate * self.one(self.trees[-1], x)
        return self

    @staticmethod
    def one(tree, x: np.ndarray) -> np.ndarray:
        f, cut_at, leaves = tree
        sides = [np.where(x[:, f2] <= cut2, low, high) for f2, cut2, low, high in leaves]
        return np.where(x[:, f] <= cut_at, *sides)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start) + self.rate * sum(self.one(t, x) for t in self.trees)
        return 1 / (1 + np.exp(-score))


class Judge:
    """Trees and the threshold of each kind (over 1: nothing of it is accepted)."""

    def __init__(self, trees: BoostedTrees, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def accepted(self, base: list[tuple[int, int, int]], wide: list[tuple[int, int, int]], rows: list[list[float]]) -> list[tuple[int, int, int]]:
        """Candidates over the threshold of their kind, best first, without overlaps among each other and with base spans."""
        if not wide:
            return []
        p = self.trees.probability(np.array(rows, float))
        taken, out = Cover(base), []
        for score, (k, a, b) in sorted(zip(-np.round(p, 6), wide), key=lambda x: (x[0], x[1][1], x[1][1] - x[1][2], x[1][0])):
            if -score >= self.thresholds[k] and not taken.meets(a, b):
                taken.add(a, b)
                out.append((k, a, b))
        return out


def thresholds_of(counts: np.ndarray, error: float = ERROR, least: float = LEAST) -> list[float]:
    """For each kind the least score at which negatives are at most ``error`` of what is accepted; counts: kind, label, bin."""
    out, bins = [], counts.shape[2]
    for negative, positive in counts:
        bad, good = (np.cumsum(c[::-1])[::-1] for c in (negative, positive))
        allowed = np.maximum(error * (bad + good), np.where(good >= ENOUGH, 1, 0))  # one is no rate: few examples do not shut a kind off
        fine = (bad <= allowed) & (good > 0) & (np.arange(bins) >= least * bins)
        out.append(int(np.flatnonzero(fine)[0]) / bins if fine.any() else 2.0)
    return out


def train(found: DataFrame, sample: int = SAMPLE, error: float = ERROR, folds: int = 5) -> Judge | None:
    """Trees from at most about ``sample`` labelled candidates; thresholds from all of them, each scored by trees that did not see its document. None without both classes."""
    spans = found.select(F.posexplode("examples").alias("at", "s"), "id_").select("s.*", F.pmod(F.xxhash64("id_", F.lit(7)), F.lit(folds)).cast("int").alias("fold"), F.xxhash64("id_", "at").alias("row"))
    parts = [bounded_sample(spans.filter(F.col("label") == y), ["row"], sample // 2, 7) for y in (1.0, 0.0)]
    rows = parts[0].unionByName(parts[1]).select("row", "label", "fold", "features").toPandas().sort_values(["row", "label"])
    y, x, fold = rows["label"].to_numpy(float), np.array(rows["features"].tolist(), float), rows["fold"].to_numpy()
    if len(set(y)) < 2:
        return None
    trees = BoostedTrees().fit(x, y)
    others = [BoostedTrees().fit(x[fold != f], y[fold != f]) if len(set(y[fold != f])) == 2 else trees for f in range(folds)]

    def score(batches):
        for b in batches:
            x, fold, p = np.array(b.column("features").to_pylist(), float), b.column("fold").to_numpy(), np.zeros(b.num_rows)
            for f in np.unique(fold):
                p[fold == f] = others[f].probability(x[fold == f])
            if len(x):
                place = np.minimum((np.round(p, 6) * BINS).astype(np.int64), BINS - 1)
                key, n = np.unique((b.column("kind").to_numpy() * 2 + b.column("label").to_numpy().astype(np.int64)) * BINS + place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    counts = np.zeros(len(KINDS) * 2 * BINS)
    scored = spans.select("kind", "label", "fold", "features").mapInArrow(score, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for r in scored.collect():  # at most kinds x labels x bins rows
        counts[r["key"]] = r["n"]
    return Judge(trees, thresholds_of(counts.reshape(len(KINDS), 2, BINS), error))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def _candidates(docs: DataFrame) -> DataFrame:
    return cut(find_spans(docs).withColumn("id_", F.monotonically_increasing_id()), "spans")


def detect(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, spans (base and accepted ones), n_spans."""
    found = _candidates(docs)
    judge = train(found, sample)

    def run(batches):
        for b in batches:
            counts, digests, texts, totals = [], [], [], []
            for base, wide in zip(b.column("base").to_pylist(), b.column("wide").to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                more = judge.accepted(spans, [(s["kind"], s["start"], s["end"]) for s in wide], [s["features"] for s in wide]) if judge else []
                counts.append([sum(k == kind for k, _, _ in spans) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(span_text(spans).encode()).hexdigest())
                texts.append(span_text(spans + more))
                totals.append(len(spans) + len(more))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS)).T
            columns = [b.column("doc_id"), *map(pa.array, numbers), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_text(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s in filter(None, (spans or "").split(",")):
        kind, a, b = s.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with personal data replaced in ``text``; other columns as they were, a null text stays null.

    Spans are found again while a text is rewritten, in the task that holds it: no text is shuffled.
    """
    judge = train(_candidates(docs), sample)
    names = docs.columns

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in part.column("text").to_pylist():
            if text is None:
                out.append(None)
                continue
            good, failed = base_spans(text)
            more = wide_spans(text, failed) if judge else []
            added = judge.accepted(good, more, [features(text, k, a, b) for k, a, b in more]) if more else []
            out.append(redact_text(text, span_text(good + added)))
        columns = [pa.array(out, pa.string()) if c == "text" else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(by_slice("text", each), docs.schema)
