import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import as_dict
from tracemill import sources as S
from tracemill.functions import format_duration, parse_timestamp, relative_difference
from tracemill.log import log_from_table
from tracemill.operators import objects
from tracemill.operators.variants import default_classifier, sequences, variants

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
<global scope="event"><string key="concept:name" value="name"/></global>
<classifier name="Both" keys="concept:name lifecycle:transition"/><classifier name="Odd" keys="'my key' org:resource"/>
<string key="creator" value="hand"/>
<trace><string key="concept:name" value="t1"/>
 <event><string key="concept:name" value="a"/><string key="lifecycle:transition" value="start"/><date key="time:timestamp" value="3924-01-01T10:00:00.000+02:00"/><int key="r" value="x1"/></event>
 <event><string key="concept:name" value="a"/><string key="lifecycle:transition" value="complete"/><date key="time:timestamp" value="3924-01-01T10:05:00.000+02:00"/></event>
 <event><string key="concept:name" value="b"/></event></trace>
<trace><string key="concept:name" value="t2"/></trace>
</log>"""


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_notation(spark):
    parse = lambda t: as_dict(S.parse_notation(spark.createDataFrame([(t,)], "value string")))
    assert parse("[<weigh parcel, stamp, send>^4, <>^3]") == {"": 3, "weigh parcel,stamp,send": 4}
    assert parse("<q>^0 <r, r>") == {"r,r": 1}
    assert parse("⟨p⟩¹⁰⁷") == {"p": 107}
    with pytest.raises(ValueError):
        parse("nothing here")


def test_csv(spark, tmp_path):
    path = write(tmp_path, "log.csv", "case|Activity|Timestamp|grams\nk7|send|2021-09-30T18:15:00|210\nk9|stamp|30/09/2021 08:00:00|\nk7|weigh|2021/09/30 07:59:59.9|205\n|nobody's||\nk7| stamp |2021-09-30 12:00:00.001|\nk9|send|01/10/2021 00:00:00|88\n", "utf-8")
    log = S.read_csv(spark, path)
    assert {r["case_id"]: ",".join(r["variant"]) for r in sequences(log).collect()} == {"k7": "weigh,stamp,send", "k9": "stamp,send"}
    S.write_csv(log, str(tmp_path / "out"))
    again = S.read_csv(spark, str(tmp_path / "out"), delimiter=",", encoding="UTF-8")
    assert as_dict(variants(again)) == as_dict(variants(log))


def test_csv_encodings(spark, tmp_path):
    latin = write(tmp_path, "latin.csv", "case,activity\n4,größer stapeln\n4,à côté\n4,5 €\n", "cp1252")
    assert {r["activity"] for r in S.read_csv(spark, latin).events.collect()} == {"größer stapeln", "à côté", "5 €"}
    marked = write(tmp_path, "bom.csv", "\ufeffcase,activity\n4,señal\n")
    assert [r["activity"] for r in S.read_csv(spark, marked).events.collect()] == ["señal"]


def test_times_and_durations(spark):
    rows = [("05/01/2023 10:00:00.250",), ("2023/01/05 10:00:00.5",), ("2023-01-05T10:00:00+02:00",), ("never",)]
    df = spark.createDataFrame(rows, "t string").select(F.unix_micros(parse_timestamp(F.col("t"))).alias("us"))
    us = [r["us"] for r in df.collect()]
    assert us[0] % 1_000_000 == 250_000 and us[1] % 1_000_000 == 500_000 and us[2] == us[1] - 500_000 - 7_200_000_000 and us[3] is None
    text = spark.createDataFrame([(10800.0,), (2 * 86400 + 5 * 3600 + 180.0,), (0.25,), (70.0,), (None,)], "s double").select(format_duration(F.col("s")))
    assert [r[0] for r in text.collect()] == ["3h", "2d 5h", "250ms", "1m 10s", "–"]
    diff = spark.createDataFrame([(2.0, 2.0), (0.0, 1.0), (4.0, 5.0)], "a double, b double").select(relative_difference(F.col("a"), F.col("b")))
    assert [r[0] for r in diff.collect()] == ["=", "new", "+25%"]


def test_xes(spark, tmp_path):
    path = write(tmp_path, "log.xes", XES)
    log = S.read_xes(spark, path)
    assert log.cases.count() == 2 and log.events.count() == 3
    classifier = default_classifier(log)
    assert {r["case_id"]: list(r["variant"]) for r in sequences(log, classifier).collect()} == {"t1": ["a", "b"], "t2": []}
    first = log.events.filter("pos = 0").select("tz_offset_min", F.unix_seconds("ts").alias("s"), "attrs").first()
    assert first["tz_offset_min"] == 120 and first["attrs"]["r"] == "x1" and first["s"] == 61662067200 + (first["s"] - 61662067200)
    assert [(c.name, c.keys) for c in log.meta["classifiers"]] == [("Both", ("activity", "lifecycle")), ("Odd", ("my key", "resource"))]
    header = S.read_xes_header(spark, path)
    assert [(r["key"], r["value"]) for r in header["attributes"].collect()] == [("creator", "hand")]
    assert [tuple(r) for r in header["globals"].collect()] == [("event", "concept:name", "name")]
    S.write_xes(log, str(tmp_path / "xes"))
    again = S.read_xes(spark, str(tmp_path / "xes"))
    assert as_dict(variants(again)) == as_dict(variants(log))
    assert again.meta["classifiers"] == log.meta["classifiers"]
    assert {r["prefix"] for r in S.read_xes_header(spark, str(tmp_path / "xes"))["extensions"].collect()} == {"concept"}  # a log's own extensions stand for the usual ones
    S.write_xes(replace(log, meta={}), str(tmp_path / "bare"))
    assert {r["prefix"] for r in S.read_xes_header(spark, str(tmp_path / "bare"))["extensions"].collect()} == {"concept", "lifecycle", "org", "time"}
    attrs = lambda x: sorted(({k: v for k, v in r["attrs"].items() if k != "time:timestamp"} for r in x.events.collect()), key=str)
    assert attrs(again) == attrs(log)


def test_xes_traces_without_names_of_their_own(spark, tmp_path):
    """Traces that share a name, or have none, stay apart, and keep their attributes over a round trip."""
    trace = lambda name, *acts: f'<trace>{name}<int key="size" value="{len(acts)}"/><boolean key="odd" value="true"/>' + "".join(f'<event><string key="concept:name" value="{a}"/><float key="cost" value="1.50"/></event>' for a in acts) + "</trace>"
    named = '<string key="concept:name" value="x"/>'
    path = write(tmp_path, "log.xes", '<log xes.version="1.0">' + trace("", "a") + trace("", "b") + trace(named, "c") + trace(named, "d", "e") + trace('<string key="concept:name" value="y"/>', "f") + "</log>")
    log = S.read_xes(spark, path)
    expected = {"a": 1, "b": 1, "c": 1, "d,e": 1, "f": 1}
    assert as_dict(variants(log)) == expected and "y" in {r["case_id"] for r in log.cases.collect()}
    S.write_xes(log, str(tmp_path / "again"))
    again = S.read_xes(spark, str(tmp_path / "again"))
    assert as_dict(variants(again)) == expected
    names = lambda x: sorted(str(sorted(r["attrs"].items())) for r in x.cases.collect())
    assert names(again) == names(log)
    assert {r["attrs"]["cost"] for r in again.events.collect()} == {"1.50"}


NESTED = """<?xml version="1.0" encoding="UTF-8"?>
<x:log xes.version="1.0" xmlns:x="http://www.xes-standard.org/">
<x:extension name="Own" prefix="own" uri="urn:own"/>
<x:global scope="trace"><x:string key="concept:name" value="?"/><x:list key="tags"><x:values><x:int key="n" value="1"/></x:values></x:list></x:global>
<x:global scope="event"><x:boolean key="own:late" value="false"/></x:global>
<x:classifier name="Name" keys="concept:name"/>
<x:container key="own:made"><x:string key="by" value="hand"/><x:date key="on" value="2020-02-29"/></x:container><x:float key="own:cost" value="1E3"/>
<x:trace/>
<x:trace><x:string key="concept:name" value="p&quot;&amp;&lt;"/><x:id key="own:id" value="00c0ffee"/>
  <x:event><x:string key="concept:name" value="weigh"/><x:date key="time:timestamp" value="2021-03-28T01:59:59.1234+02:00"/><x:string key="code" value="00700"/><x:int key="n" value="007"/><x:int key="n2" value="many"/>
    <x:list key="mixed"><x:values><x:int key="i" value="1"/><x:string key="s" value="two"/><x:int key="i" value="3"/><x:list key="deep"><x:values/></x:list></x:values></x:list>
    <x:container key="box"><x:float key="w" value="1.50"/><x:container key="in"><x:boolean key="b" value="true"/></x:container></x:container>
    <x:string key="note" value="line one&#10;line two"><x:id key="of" value="q"/></x:string></x:event>
  <x:event/></x:trace><x:trace/>
<x:trace><x:string key="concept:name" value="x"/></x:trace><x:trace><x:string key="concept:name" value="x#1"/><x:string key="concept:name" value="x##20"/></x:trace>
<x:trace><x:string key="concept:name" value="x"/></x:trace><x:trace/></x:log>"""


def flat(text):
    """Traces of a document, each with the attributes and events it holds, by the standard library; the items of a list with or without ``values``."""
    import xml.etree.ElementTree as ET

    def plain(e):
        kids = [k for c in e for k in (c if c.tag.endswith("values") else [c])]
        return (e.tag.rpartition("}")[2], e.get("key"), e.get("value"), [plain(k) for k in kids])

    root = ET.fromstring(text)
    return [plain(c) for c in root]


def documents(folder):
    import glob

    return [open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*"))]


def test_xes_keeps_all_kinds_and_nesting(spark, tmp_path):
    log = S.read_xes(spark, write(tmp_path, "n.xes", NESTED))
    S.write_xes(log, str(tmp_path / "out"))
    source = flat(NESTED)
    found = [flat(d) for d in documents(tmp_path / "out")]
    assert sorted((e for d in found for e in d if e[0] == "trace"), key=str) == sorted((e for e in source if e[0] == "trace"), key=str)
    header = lambda d: sorted((e for e in d if e[0] not in ("trace", "extension", "classifier")), key=str)
    assert all(header(d) == header(source) for d in found)
    again = S.read_xes(spark, str(tmp_path / "out"))
    assert again.meta == log.meta and log.meta["extensions"] == [{"name": "Own", "prefix": "own", "uri": "urn:own"}]
    typed = lambda x: sorted(str((r["pos"], r["typed"])) for r in x.events.collect())
    assert typed(again) == typed(log)


def test_xes_values_and_nested_lists(spark, tmp_path):
    from tracemill.sources import xes

    e = S.read_xes(spark, write(tmp_path, "n.xes", NESTED)).events.filter("activity = 'weigh'")
    got = e.select(*(xes.value_of(F.col("typed"), k, t).alias(k) for k, t in (("n", "int"), ("n2", "int"), ("code", "string"))), xes.nested(F.col("typed"), "mixed").alias("mixed"), xes.value_of(xes.nested(xes.nested(F.col("typed"), "box"), "in"), "b", "boolean").alias("b"), xes.nested(F.col("typed"), "gone").alias("gone"), "attrs", "tz_offset_min").first()
    assert (got["n"], got["n2"], got["code"], got["b"], got["gone"]) == (7, None, "00700", True, None)
    assert [(n["depth"], n["kind"], n["text"]) for n in got["mixed"]] == [(0, "int", "1"), (0, "string", "two"), (0, "int", "3"), (0, "list", None)]
    assert got["attrs"]["n2"] == "many" and "mixed" not in got["attrs"] and got["tz_offset_min"] == 120


def test_xes_names_never_meet(spark, tmp_path):
    cases = [r["case_id"] for r in S.read_xes(spark, write(tmp_path, "n.xes", NESTED)).cases.collect()]
    assert len(cases) == len(set(cases)) == 7 and "x##20" in cases and all(c.startswith(("###", "x###")) for c in cases if c not in ("x##20", 'p"&<'))


def test_xes_changed_and_added_columns_are_written(spark, tmp_path):
    log = S.read_xes(spark, write(tmp_path, "n.xes", NESTED))
    later = log.events.withColumn("activity", F.when(F.col("activity") == "weigh", "weigh again")).withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumns({"big": F.lit(1 << 40), "ok": F.lit(True), "parts": F.array(F.lit("a"), F.lit("b")), "size": F.struct(F.lit(1.5).alias("w"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))})
    S.write_xes(log.with_events(later), str(tmp_path / "out"))
    events = [e for d in documents(tmp_path / "out") for t in flat(d) if t[0] == "trace" for e in t[3] if e[0] == "event"]
    weighed = next(e[3] for e in events if ("string", "concept:name", "weigh again", []) in e[3])
    assert ("date", "time:timestamp", "2021-03-28T00:59:59.123Z", []) in weighed and ("int", "big", str(1 << 40), []) in weighed and ("boolean", "ok", "true", []) in weighed
    assert ("list", "parts", None, [("string", "parts", "a", []), ("string", "parts", "b", [])]) in weighed
    assert ("container", "size", None, [("float", "w", "1.5", []), ("container", "m", None, [("int", "k", "2", [])])]) in weighed


def test_one_xes_file_is_read_by_many_tasks(spark, tmp_path):
    many = "".join(f'<trace><string key="concept:name" value="t{k}"/><event><string key="concept:name" value="{"ab"[k % 2]}"/></event></trace>' for k in range(3000))
    path = write(tmp_path, "big.xes", f'<log xes.version="1.0">{many}</log>')
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        log = S.read_xes(spark, path)
        parts = log.cases.select(F.shiftright("first.number", 33).alias("p")).distinct().count()
        assert parts > 5 and as_dict(variants(log)) == {"a": 1500, "b": 1500}
        first = [r["case_id"] for r in log.cases.orderBy("first").collect()]
        assert first == [f"t{k}" for k in range(3000)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def ocel2():
    events = [("e1", "place order", 1, ["o1", "i1", "i2"]), ("e2", "pick item", 2, ["i1"]), ("e3", "pick item", 3, ["i2"]), ("e4", "pay order", 4, ["o1", "o1"])]
    return {
        "objectTypes": [{"name": "order"}, {"name": "item"}, {"name": "package"}],
        "objects": [{"id": "o1", "type": "order", "attributes": [{"name": "v", "value": "1", "time": "x"}, {"name": "v", "value": "2", "time": "y"}]}, {"id": "i1", "type": "item"}, {"id": "i2", "type": "item"}],
        "events": [{"id": i, "type": a, "time": f"2024-01-0{t}T00:00:00Z", "relationships": [{"objectId": o, "qualifier": ""} for o in os]} for i, a, t, os in events],
    }


def test_ocel(spark, tmp_path):
    data = ocel2()
    v1 = {"ocel:global-log": {"ocel:object-types": ["order", "item", "package"]}, "ocel:events": {e["id"]: {"ocel:activity": e["type"], "ocel:timestamp": e["time"], "ocel:omap": [r["objectId"] for r in e["relationships"]], "ocel:vmap": {}} for e in data["events"]}, "ocel:objects": {o["id"]: {"ocel:type": o["type"], "ocel:ovmap": {}} for o in data["objects"]}}
    for name, doc in (("v2.json", data), ("v1.jsonocel", v1)):
        log = S.read_ocel(spark, write(tmp_path, name, json.dumps(doc)))
        edges, ends = objects.object_centric_dfg(log)
        assert {(r["type"], r["a"], r["b"]): r["n"] for r in edges.collect()} == {("item", "place order", "pick item"): 2, ("order", "place order", "pay order"): 1, ("order", "pay order", "pay order"): 1}
        assert {r["type"]: r["objects"] for r in objects.counts_by_type(log).collect()} == {"order": 1, "item": 2, "package": 0}
        flat = objects.flatten(log, "order")
        assert [(r["activity"], (r["others"] or {}).get("ocel:item")) for r in flat.events.orderBy("pos").collect()] == [("place order", "i1, i2"), ("pay order", None)]
        assert objects.flatten(log).meta["object_type"] == "item"
    with pytest.raises(ValueError):
        S.read_ocel(spark, write(tmp_path, "other.json", '{"x": 1}'))


def read_small(spark, path, size):
    """The log of a path that is read in ranges of ``size`` bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return S.read_ocel(spark, path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def all_of(log):
    """What the questions about an object-centric log give."""
    edges, ends = objects.object_centric_dfg(log)
    plain = lambda df, *columns: sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)
    flat = objects.flatten(log, "item").events
    return [
        plain(edges), plain(ends), plain(objects.counts_by_type(log)), plain(objects.objects_at(log)), plain(flat, "case_id", "pos", "activity", "others"),
        [r["event_id"] for r in objects.events_of(log, "o1").collect()], plain(log.objects, "object_id", "type", F.array_sort(F.map_entries("attrs"))), plain(log.types, "type", "ord"),
    ]


def pack_log(n, first=0):
    """Orders with items; an object of the next document is listed with another attribute."""
    kinds, events = {}, []
    for k in range(first, first + n):
        o, i, j = f"o{k}", f"i{2 * k}", f"i{2 * k + 1}"
        kinds |= {o: "order", i: "item", j: "item"}
        at = lambda m: f"2024-01-01T{m // 60 % 24:02d}:{m % 60:02d}:00Z"
        events += [(f"p{k}", "place", at(k), [o, i, j]), (f"k{k}", 'pick "it} [now]\\\\', at(k + 1), [i, f"i{max(0, 2 * k - 1)}"]), (f"l{k}", "leave", at(k + 2), [o, i, j, "van"])]
    return kinds, events


def as_v2(kinds, events, attribute):
    return {"objectTypes": [{"name": "order"}], "objects": [{"id": o, "type": t, "attributes": [{"name": "n", "value": attribute}]} for o, t in kinds.items()], "events": [{"id": i, "type": a, "time": t, "relationships": [{"objectId": o, "qualifier": "q}"} for o in os]} for i, a, t, os in events]}


def as_v1(kinds, events, attribute):
    return {"ocel:global-log": {"ocel:version": "1.0", "ocel:object-types": ["order"]}, "ocel:events": {i: {"ocel:activity": a, "ocel:timestamp": t, "ocel:omap": os, "ocel:vmap": {}} for i, a, t, os in events}, "ocel:objects": {o: {"ocel:type": t, "ocel:ovmap": {"n": attribute}} for o, t in kinds.items()}}


@pytest.mark.parametrize("form", [as_v2, as_v1])
def test_ocel_folder_equals_one_document(spark, tmp_path, form):
    """Documents that share objects are one log: edges, ends, counts and attributes are those of the lists put together, whatever the ranges."""
    (ka, ea), (kb, eb) = pack_log(12), pack_log(12, 10)
    eb = [(i + "'", a, t, os) for i, a, t, os in eb]
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, "1.json", json.dumps(form(ka, ea, "old")))
    write(folder, "2.json", json.dumps(form(kb, eb, "new"), indent=2))
    whole = {k: "new" if k in kb else "old" for k in {**ka, **kb}}
    doc = form({**ka, **kb}, ea + eb, "?")
    for o in doc["objects"] if form is as_v2 else []:
        o["attributes"][0]["value"] = whole[o["id"]]
    for o, v in doc["ocel:objects"].items() if form is as_v1 else []:
        v["ocel:ovmap"]["n"] = whole[o]
    one = all_of(S.read_ocel(spark, write(tmp_path, "one.json", json.dumps(doc))))
    assert all_of(S.read_ocel(spark, str(folder))) == one
    assert all_of(read_small(spark, str(folder), 1500)) == one
    van = [x for x in one[6] if x[0] == "van"]
    assert van == [("van", "object", [])] and len(one[6]) == len(whole) + 1


def test_ocel_event_ids_listed_again(spark, tmp_path):
    folder = tmp_path / "twice"
    folder.mkdir()
    kinds, events = pack_log(3)
    for name in ("1.json", "2.json"):
        write(folder, name, json.dumps(as_v2(kinds, events, "x")))
    log = S.read_ocel(spark, str(folder))
    ids = [r["event_id"] for r in log.events.collect()]
    assert len(ids) == len(set(ids)) == 18 and {e[0] for e in events} <= set(ids)
    assert {r["type"]: r["objects"] for r in objects.counts_by_type(log).collect()} == {"order": 3, "item": 6, "object": 1}
    assert log.relations.count() == 2 * sum(len(e[3]) for e in events)


def test_ocel_one_document_is_read_by_many_tasks(spark, tmp_path):
    from tracemill.sources.json_records import section_members

    kinds, events = pack_log(2000)
    path = write(tmp_path, "big.json", json.dumps(as_v2(kinds, events, "x")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = section_members(spark, path).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_if(F.col("ix") > 0).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["n"] > 100 for r in found) >= 4
    log = read_small(spark, path, 100_000)
    assert (log.events.count(), log.objects.count()) == (6000, 6001)


def test_json_members_of_any_form(spark, tmp_path):
    """Members with brackets and quotes in strings, nested keys named like sections, scalars and empty sections, over ranges of any size."""
    import random

    from tracemill.sources.json_records import joined, section_members

    rng = random.Random(1)

    def value(depth=0):
        k = rng.randrange(6 if depth < 3 else 4)
        if k < 4:
            return ['a}b{"\\', 'é]\\"}', "x", 7][k]
        inner = [value(depth + 1) for _ in range(rng.randrange(3))]
        return inner if k == 4 else {rng.choice(["events", "k}", 'q"']) + str(j): v for j, v in enumerate(inner)}

    docs = []
    for n in range(4):
        docs.append({"version": "1", "events": [{"id": i, "v": value()} for i in range(rng.randrange(40))], "meta": {"s": 1, "t": ["a", "b"], "u": "z"}, "objects": {rng.choice(["o}", 'p"{', "r"]) + str(i): {"w": value()} for i in range(rng.randrange(40))}, "types": [1, 2], "none": []})
        write(tmp_path, f"{n}.json", json.dumps(docs[-1], ensure_ascii=n % 2 == 0, indent=n // 2 or None) + "\n" * (n % 2))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("40", "333", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = joined(section_members(spark, str(tmp_path))).orderBy("path", "start", "ix").collect()
        for n, doc in enumerate(docs):
            mine = [r for r in rows if r["path"].endswith(f"/{n}.json")]
            of = lambda s: [r["text"] for r in mine if r["section"] == s and r["ix"] >= 0]  # noqa: E731, B023
            assert [json.loads(t) for t in of("events")] == doc["events"]
            assert [kv for t in of("objects") for kv in json.loads("{" + t + "}").items()] == list(doc["objects"].items())
            assert [json.loads("{" + t + "}") for t in of("meta")] == [{"s": 1, "t": ["a", "b"]}]
            assert {r["section"] for r in mine if r["ix"] == -1} == {"events", "meta", "objects", "types", "none"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pnml_round_trip(spark, tmp_path):
    from tracemill.nets import Net, net_from_tables

    net = Net()
    net.place("p<1>", first=1)
    net.place("p2", last=1)
    net.transition("t1", "a & b", ["p<1>"], ["p2"])
    net.transition("t2", None, ["p2"], ["p<1>"])
    S.write_pnml(*net.tables(spark, "n1"), str(tmp_path / "nets"))
    places, transitions, arcs = S.read_pnml(spark, str(tmp_path / "nets"))
    again = net_from_tables(places, transitions, arcs, places.first()["net_id"])
    assert again.places == net.places and again.arcs == net.arcs and again.transitions["t2"] is None


def test_transition_text(spark):
    lines = spark.createDataFrame([("s0 -a-> s1, s1 -b-> {x,y}",), ("final: {x,y}",)], "value string").coalesce(1)
    edges, states = S.parse_transition_system(lines)
    assert {(r["src"], r["event"], r["dst"]) for r in edges.collect()} == {("s0", "a", "s1"), ("s1", "b", "{x,y}")}
    assert {r["state"]: (r["is_initial"], r["is_final"]) for r in states.collect()} == {"s0": (True, False), "s1": (False, False), "{x,y}": (False, True)}
    again = S.parse_transition_system(S.transition_system_text(edges, states))
    assert again[0].exceptAll(edges).count() == 0 and again[1].exceptAll(states).count() == 0


def test_fingerprints(spark, tmp_path):
    path = write(tmp_path, "x.bin", "hello")
    now = S.fingerprints(spark, path)
    assert S.mismatches(now, now).count() == 0
    assert S.mismatches(now, now.withColumn("sha256", F.lit("other"))).count() == 1


def test_empty_cases_and_nulls(spark):
    rows = spark.createDataFrame([("1", None, "start"), ("1", "a", None), ("2", "b", "complete"), (None, "c", None)], "case_id string, activity string, lifecycle string")
    log = log_from_table(rows, "case_id", "activity", lifecycle="lifecycle")
    assert as_dict(variants(log)) == {",a": 1, "b": 1}


def test_xes_traces_stay_with_their_events(spark, sf, tmp_path):
    """Cases and events come from exchanges by case of unlike sizes, whose small partitions are put together differently."""
    from tracemill.queries.base import user_days

    given = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        S.write_xes(user_days(spark, sf), str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    name = lambda kids: next(k[2] for k in kids if k[1] == "concept:name")
    found = sorted((name(e[3]), sum(k[0] == "event" for k in e[3])) for d in documents(tmp_path / "out") for e in flat(d) if e[0] == "trace")
    assert found == sorted((r["case_id"], r["count"]) for r in user_days(spark, sf).events.groupBy("case_id").count().collect())


def test_documents_tell_objects_apart_by_rows(spark):
    """Objects that events share are listed once in each document; no array of structs is compared with itself."""
    from tracemill.queries.files import _documents

    events = spark.range(60).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("pack").alias("activity"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("ord"))
    relations = spark.range(60).select(F.concat(F.lit("e"), "id").alias("event_id"), F.posexplode(F.array(F.concat(F.lit("o"), (F.col("id") % 7).cast("string")), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")))).alias("rel_ix", "object_id"))
    known = relations.select("object_id", F.when(F.col("object_id").startswith("o"), "order").otherwise("box").alias("type")).distinct()
    log = objects.object_log(events, known, relations, ["order"])
    for version, listed in ((2, lambda d: [o["id"] for o in d["objects"]]), (1, lambda d: list(d["ocel:objects"]))):
        made = _documents(log, version, size=20)
        assert "array_distinct" not in made._jdf.queryExecution().optimizedPlan().toString()
        found = [json.loads(r["value"]) for r in made.collect()]
        assert sum(len(d["events" if version == 2 else "ocel:events"]) for d in found) == 60 and len(found) > 1
        assert all(len(listed(d)) == len(set(listed(d))) <= 10 for d in found) and {o for d in found for o in listed(d)} == {f"o{k}" for k in range(7)} | {f"b{k}" for k in range(3)}


def test_documents_read_back_without_exchange(spark, sf, tmp_path):
    """Documents are small files, and their events know their objects' types: nothing is dealt out to read them, and only order lines to write them."""
    from tracemill.queries.base import order_objects
    from tracemill.queries.files import _documents

    log = order_objects(spark, sf)
    for version in (2, 1):
        made = _documents(log, version, size=1000)
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1 and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
        path = str(tmp_path / f"v{version}")
        made.write.option("maxRecordsPerFile", 1).text(path, compression="gzip")
        rows = spark.read.text(path)
        assert rows.agg(F.max(F.length("value"))).first()[0] < 1_000_000
        found = S.read_ocel(spark, path, kept=False)
        assert "Exchange" not in found.related._jdf.queryExecution().executedPlan().toString()
        plain = lambda df: df.select("event_id", "activity", "ts", F.inline("related")).select("event_id", "activity", "ts", "object_id", "rel_ix", "type")
        assert plain(found.related).exceptAll(plain(log.related)).count() == plain(log.related).exceptAll(plain(found.related)).count() == 0
        assert found.relations.count() == plain(log.related).count()


def test_types_of_a_document_are_used_if_they_are_those_of_all(spark, tmp_path):
    """An object that another document lists with another type, that none lists, or whose id has the separator in it, is looked up in all documents."""
    kinds, events = pack_log(4)
    events = [(i, a, t, [o for o in os if o in kinds]) for i, a, t, os in events]
    later = ({"i0": "box", "o9": "order"}, [("z", "late", "2024-01-02T00:00:00Z", ["o9"])])
    odd = ({"o\0x": "order"}, [("y", "odd", "2024-01-02T00:00:00Z", ["o\0x"])])
    unlisted = ({"o8": "order"}, [("x", "bare", "2024-01-02T00:00:00Z", ["o8", "i1"])])
    for k, (second, form) in enumerate([(None, as_v2), (None, as_v1), (later, as_v2), (later, as_v1), (odd, as_v2), (unlisted, as_v1)]):
        folder = tmp_path / str(k)
        folder.mkdir()
        write(folder, "1.json", json.dumps(form(kinds, events, "x")))
        if second:
            write(folder, "2.json", json.dumps(form(*second, "y")))
        log = S.read_ocel(spark, str(folder), kept=False)
        assert (log.related is None) == (second is not None)
        known = kinds | (second[0] if second else {})
        touched = sorted((e, o, known[o]) for e, _, _, os in [*events, *(second[1] if second else [])] for o in os)
        assert sorted((r["event_id"], r["object_id"], r["type"]) for r in objects.typed_relations(log).select("event_id", "object_id", "type").collect()) == touched


def test_types_within_a_document(monkeypatch):
    """Events before their objects wait for them, as long as they fit."""
    import pyarrow as pa

    from tracemill.sources import ocel

    rows = [("a", 3, None, None, "o1\0i1", 2), ("a", 3, None, None, None, 0), ("a", 2, "o1", "order", None, 0), ("a", 2, "i1", "item", None, 0), ("b", 2, "o1", "box", None, 0), ("b", 3, None, None, "o1", 1), ("b", 3, None, None, "i1", 1), ("b", 3, None, None, "o1", 2)]

    def types(size):
        out = []
        for k in range(0, len(rows), size):
            path, kind, id_, name, touched, n = zip(*rows[k : k + size])
            out.append((pa.array(path), pa.array([0] * len(path), pa.int64()), pa.array(kind, pa.int32()), pa.array(id_, pa.string()), pa.array(name, pa.string()), pa.array(touched, pa.string()), pa.array(n, pa.int32())))
        return [t for part in ocel._types_in_document(iter(out)) for t in part.to_pylist()]

    for size in (1, 3, 8):
        found = types(size)
        assert len(found) == 8 and found[0] == ["order", "item"] and found[1] == [] and found[5:] == [["box"], None, None]
    monkeypatch.setattr(ocel, "HELD", 0)
    assert types(1)[0] is None and types(1)[5] == ["box"]


def test_relations_at_hand_give_what_tables_give(spark):
    """Repeated relations, an object listed at two places, ids that are null, and events at one time."""
    pairs = "array<struct<object_id:string,rel_ix:int,type:string>>"
    rows = [
        ("e1", "a", 1, [("o1", 0, "order"), ("i1", 1, "item"), ("i2", 2, "item"), ("i1", 1, "item"), ("b1", 3, "box")]),
        ("e2", "b", 2, [("o1", 0, "order"), ("o1", 1, "order"), ("i2", 2, "item"), ("i2", 5, "item"), (None, 6, "box")]),
        ("e3", "c", 2, [("i1", 0, "item"), ("o2", 1, "order")]),
        ("e4", "c", 2, [("o1", 0, "order")]),
        ("e5", "d", 3, []),
    ]
    related = spark.createDataFrame([(e, a, t, [list(p) for p in r]) for e, a, t, r in rows], f"event_id string, activity string, t int, related {pairs}").select("event_id", "activity", F.timestamp_seconds("t").alias("ts"), F.struct("t", "activity").alias("ord"), "related")
    touches = related.select("event_id", F.inline("related"))
    events, relations, known = related.drop("related"), touches.select("event_id", "object_id", "rel_ix"), touches.filter("object_id is not null").select("object_id", "type").distinct()
    plain = lambda df: sorted(str([sorted(v.items()) if isinstance(v, dict) else v for v in r]) for r in df.collect())
    by_tables = objects.object_log(events, known, relations, ["order"])
    for settled in (False, True):
        at_hand = objects.object_log(events, known, relations, ["order"], related, settled)
        for kind in ("order", "item", "box"):
            assert plain(objects.flatten(at_hand, kind).events) == plain(objects.flatten(by_tables, kind).events)
        for a, b in zip(objects.object_centric_dfg(at_hand), objects.object_centric_dfg(by_tables)):
            assert plain(a) == plain(b)
    with pytest.raises(ValueError):
        objects.flatten(at_hand, "crate")


def test_flattening_exchanges_little(spark, sf):
    """Lines told apart, and events dealt by case: nothing else is exchanged; rows that are ordered for the map carry no event ids."""
    from tracemill.queries.base import order_objects

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan(objects.flatten(order_objects(spark, sf), "order").events).count("Exchange ") <= 2
    assert "event_id" not in plan(objects.object_centric_dfg(order_objects(spark, sf))[0])
