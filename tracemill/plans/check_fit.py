"""Fitness, precision, generalisation and simplicity of a net for a log, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nets import Net
from ..operators import conformance as C
from ..runtime import cut


def check_fit(table: DataFrame, net: Net, alignments: bool = False) -> DataFrame:
    """table: variants; fitness by replay, or the average alignment fitness."""
    replayed = cut(C.token_replay(table, net), "replayed")
    if alignments:
        shortest = net.shortest_run()
        fitness = C.alignment_fitness(C.align(table, net), shortest).select(F.col("average_fitness").alias("fitness"))
    else:
        fitness = C.replay_fitness(replayed).select("fitness")
    out = fitness.crossJoin(C.precision(table, net)).crossJoin(C.generalisation(replayed, net))  # one row each
    return out.withColumn("simplicity", F.lit(C.simplicity(net)))
