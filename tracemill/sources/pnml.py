"""Folders of PNML files as net tables, and net tables as PNML documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pnml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """net_places, net_transitions, net_arcs; net_id is the file's name.

    Elements without an id are references and are skipped; a final marking that is not declared is the single sink.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("net_id", F.col("_metadata.file_name"))
    text = "struct<text:string>"
    places = read("place", f"_id string, name {text}, initialMarking {text}").filter("_id is not null")
    final = read("finalmarkings", f"marking array<struct<place:array<struct<_idref:string,text:string>>>>")
    final = final.select("net_id", F.explode(F.flatten("marking.place")).alias("p")).select("net_id", F.col("p._idref").alias("_id"), F.trim("p.text").try_cast("int").alias("mf"))
    moves = read("transition", f"_id string, name {text}, toolspecific array<struct<_activity:string>>").filter("_id is not null")
    arcs = read("arc", f"_id string, _source string, _target string, inscription {text}").filter("_source is not null")
    arcs = arcs.select("net_id", F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce(F.trim("inscription.text").try_cast("int"), F.lit(1)).alias("weight"))
    places = places.select("net_id", F.col("_id").alias("place_id"), F.coalesce(F.trim("name.text"), "_id").alias("name"), F.coalesce(F.trim("initialMarking.text").try_cast("int"), F.lit(0)).alias("m0"))
    sinks = places.join(arcs.select("net_id", F.col("source").alias("place_id")).distinct(), ["net_id", "place_id"], "left_anti")
    single = sinks.groupBy("net_id").agg(F.min("place_id").alias("place_id"), F.count("*").alias("k")).filter("k = 1").select("net_id", "place_id", F.lit(1).alias("sink"))
    declared = final.select("net_id").distinct().withColumn("declared", F.lit(True))
    out = places.join(final.select("net_id", F.col("_id").alias("place_id"), "mf"), ["net_id", "place_id"], "left").join(single, ["net_id", "place_id"], "left").join(declared, "net_id", "left")
    out = out.select("net_id", "place_id", "name", "m0", F.when(F.col("declared"), F.coalesce("mf", F.lit(0))).otherwise(F.coalesce("sink", F.lit(0))).alias("mf"))
    silent = F.exists(F.coalesce("toolspecific", F.array().cast("array<struct<_activity:string>>")), lambda t: t["_activity"] == "$invisible$")
    name = F.coalesce(F.trim("name.text"), "_id")
    return out, moves.select("net_id", F.col("_id").alias("transition_id"), name.alias("name"), F.when(~silent, name).alias("label")), arcs


def _escaped(c: str):
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pnml_documents(places: DataFrame, transitions: DataFrame, arcs: DataFrame) -> DataFrame:
    """net_id and document."""
    join = lambda df, order, text, name: df.groupBy("net_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t_")))), lambda x: x["t_"]), "").alias(name))
    label = lambda c: F.concat(F.lit("<name><text>"), _escaped(c), F.lit("</text></name>"))
    place = F.concat(F.lit('<place id="'), _escaped("place_id"), F.lit('">'), label("name"), F.when(F.col("m0") > 0, F.concat(F.lit("<initialMarking><text>"), F.col("m0").cast("string"), F.lit("</text></initialMarking>"))).otherwise(F.lit("")), F.lit("</place>"))
    quiet = F.when(F.col("label").isNull(), F.lit('<toolspecific tool="ProM" version="6.4" activity="$invisible$"/>')).otherwise(F.lit(""))
    move = F.concat(F.lit('<transition id="'), _escaped("transition_id"), F.lit('">'), label("name"), quiet, F.lit("</transition>"))
    arc = F.concat(F.lit('<arc id="'), _escaped("source"), F.lit(" to "), _escaped("target"), F.lit('" source="'), _escaped("source"), F.lit('" target="'), _escaped("target"), F.lit('"><inscription><text>'), F.col("weight").cast("string"), F.lit("</text></inscription></arc>"))
    end = F.concat(F.lit('<place idref="'), _escaped("place_id"), F.lit('"><text>'), F.col("mf").cast("string"), F.lit("</text></place>"))
    all_ = join(places, ["place_id"], place, "p").join(join(transitions, ["transition_id"], move, "t"), "net_id", "left").join(join(arcs, ["source", "target"], arc, "a"), "net_id", "left").join(join(places.filter("mf > 0"), ["place_id"], end, "f"), "net_id", "left").fillna("")
    head = '<?xml version="1.0" encoding="UTF-8"?><pnml><net id="'
    kind = '" type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel"><page id="page">'
    body = F.concat(F.lit(head), _escaped("net_id"), F.lit(kind), "p", "t", "a", F.lit("</page><finalmarkings><marking>"), "f", F.lit("</marking></finalmarkings></net></pnml>"))
    return all_.select("net_id", body.alias("document"))


def write_pnml(places: DataFrame, transitions: DataFrame, arcs: DataFrame, path: str) -> None:
    """A folder per net with its document."""
    pnml_documents(places, transitions, arcs).withColumnRenamed("document", "value").write.partitionBy("net_id").text(path)
