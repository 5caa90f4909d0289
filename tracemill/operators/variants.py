"""Labels, sequences and variants: the projections that everything else works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import BY_NAME, BY_NAME_COMPLETE, Classifier, EventLog
from .ranges import with_place, with_rank, with_sum_before


def has_lifecycle_pairs(log: EventLog) -> bool:
    """Whether both a start and a complete event occur (one row is read)."""
    found = log.events.agg(*(F.coalesce(F.bool_or(F.lower("lifecycle") == x), F.lit(False)).alias(x) for x in ("start", "complete"))).first()
    return found["start"] and found["complete"]


def default_classifier(log: EventLog) -> Classifier:
    return BY_NAME_COMPLETE if has_lifecycle_pairs(log) else BY_NAME


def labelled(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """Accepted events with ``label`` and their place ``at`` among the accepted events of the case."""
    own = W.partitionBy("case_id").orderBy("pos")
    taken = log.events.filter(classifier.accepts()).withColumn("label", classifier.label())
    return taken.withColumn("at", F.row_number().over(own) - 1)


def sequences(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """case_id, first, variant; a case without accepted events has the empty one."""
    rows = log.events.filter(classifier.accepts()).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", classifier.label().alias("label")))).alias("x"))
    rows = rows.select("case_id", F.transform("x", lambda e: e["label"]).alias("variant"))
    return log.cases.select("case_id", "first").join(rows, "case_id", "left").withColumn("variant", F.coalesce("variant", F.array().cast("array<string>")))


def variants(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """variant, n, first: the multiset of sequences; cache it, later operators read it more than once."""
    return sequences(log, classifier).groupBy("variant").agg(F.count("*").alias("n"), F.min("first").alias("first"))


# Two moduli (primes under 2^31) and a base for each.
MODULI = ((2147483647, 1000003), (2147483629, 998244353))
#: Digits of a place, to the base 64, that powers are looked up for: 6 are 68 billion events.
DIGITS, DIGIT_BITS = 6, 6


def _power(base: int, place: Column, modulus: int) -> Column:
    """base ** place modulo modulus: one factor per digit of the place, from tables of the digit's powers."""
    out = None
    for d in range(DIGITS):
        step = pow(base, 1 << DIGIT_BITS * d, modulus)
        powers = ", ".join(f"{pow(step, k, modulus)}L" for k in range(1 << DIGIT_BITS))
        digit = F.shiftright(place, DIGIT_BITS * d).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long")).cast("int")
        factor = F.get(F.expr(f"array({powers})"), digit)
        out = factor if out is None else F.pmod(out * factor, F.lit(modulus))
    return out


def _codes(label: Column) -> list[Column]:
    """A number under each modulus that follows from a label."""
    digest = F.sha2(label, 256)
    return [1 + F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long") for k in range(len(MODULI))]


def _written(size: Column, sums: list[Column]) -> Column:
    return F.concat_ws("-", size.cast("string"), *(F.pmod(x, F.lit(m)).cast("string") for x, (m, _) in zip(sums, MODULI)))


def sequence_digests(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """case_id, first, length and digest of the case's sequence, without gathering it: for cases of any length.

    A digest is the length and, for each modulus, the sum of label code times base to the power of the place. The sums of
    a sequence's parts add up whatever the parts are, so events are summed where they are read, and each task sends a row
    per case. Two different sequences of n labels share a digest with a chance of about (n / 2^31)^2.
    """
    taken = labelled_places(log, classifier)
    terms = [F.pmod(c * _power(b, F.col("at"), m), F.lit(m)) for c, (m, b) in zip(_codes(F.col("label")), MODULI)]
    sums = taken.groupBy("case_id").agg(F.count("*").alias("length"), *(F.sum(t).alias(f"s{k}") for k, t in enumerate(terms)))
    found = log.cases.select("case_id", "first").join(sums, "case_id", "left").fillna(0, ["length", *(f"s{k}" for k in range(len(MODULI)))])
    return found.select("case_id", "first", "length", _written(F.col("length"), [F.col(f"s{k}") for k in range(len(MODULI))]).alias("digest"))


def labelled_places(log: EventLog, classifier: Classifier) -> DataFrame:
    """case_id, label and place among the accepted events; very long cases are numbered by several tasks."""
    taken = log.events.filter(classifier.accepts()).select("case_id", "pos", classifier.label().alias("label"))
    return with_place(taken, ["case_id"], [F.col("pos")], "at")


def digest_of(variant: Column) -> Column:
    """The digest of a sequence given as an array."""

    def total(k: int, m: int, b: int) -> Column:
        terms = F.transform(variant, lambda x, i: F.pmod(_codes(x)[k] * _power(b, i.cast("long"), m), F.lit(m)))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    return _written(F.size(variant), [total(k, *pair) for k, pair in enumerate(MODULI)])


def variant_counts(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """digest, length, n, first, and example, a case of the variant: the multiset of sequences of cases of any length."""
    return sequence_digests(log, classifier).groupBy("digest", "length").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min("case_id").alias("example"))


def ranked_variants(table: DataFrame) -> DataFrame:
    """Adds rank (by falling count, then sequence), share and length."""
    total = table.agg(F.sum("n").alias("total"))
    out = with_rank(table, [F.desc("n"), F.col("variant")], "rank").withColumn("rank", F.col("rank") + 1)
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).withColumn("length", F.size("variant")).drop("total")  # one row


def expand(table: DataFrame) -> EventLog:
    """A log with n cases per variant, named 'case 1', 'case 2', ... by variant."""
    places = with_sum_before(table.select("variant", "n"), [F.col("variant")], "n", "base")
    copies = places.select("variant", "base", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).filter("copy > 0")
    cases = copies.withColumn("number", F.col("base") + F.col("copy"))
    cases = cases.select(F.concat(F.lit("case "), "number").alias("case_id"), F.struct("number").alias("first"), "variant")
    events = cases.select("case_id", F.posexplode("variant").alias("pos", "activity"))
    none = F.lit(None)
    events = events.select("case_id", "pos", "activity", none.cast("timestamp").alias("ts"), none.cast("string").alias("lifecycle"), none.cast("string").alias("resource"))
    return EventLog(cases.select("case_id", "first"), events)


def notation(table: DataFrame) -> DataFrame:
    """Textbook notation of each variant, most frequent first: text and n; '^n' is left out for 1."""
    body = F.concat(F.lit("<"), F.array_join("variant", ","), F.lit(">"))
    power = F.when(F.col("n") > 1, F.concat(F.lit("^"), F.col("n").cast("string"))).otherwise(F.lit(""))
    return table.select(F.concat(body, power).alias("text"), "n", "variant").orderBy(F.desc("n"), "variant")
