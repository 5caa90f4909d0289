"""XES files: elements of traces with typed, nested attributes.

The text source deals a file's bytes to tasks and cuts them behind each trace, so one file is read by many tasks; the
records are parsed by expat, each into one row per trace and one per event. Attributes are kept as ``typed``, the list
of all attribute elements in document order, each with its depth: nothing of a list, a container or an attribute of an
attribute is lost, whatever their nesting, and texts (offsets of times, leading zeros) stay as they are. What readers
want most is derived from it by columns: ``attrs``, the texts of the outermost plain attributes by key, and activity,
time, lifecycle and resource.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_timestamp, utc_offset_minutes
from ..log import BY_NAME, Classifier, EventLog
from ..runtime import cut

# The kinds of attributes, and those that hold others instead of a value.
KINDS = ("string", "date", "int", "float", "boolean", "id", "list", "container")
HOLDERS = ("list", "container")
NODES = "array<struct<depth:int,kind:string,key:string,text:string>>"
_NODE = pa.struct([("depth", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("text", pa.string())])
Node = tuple[int, str, str | None, str | None]

#: How many ways the rows of a name that traces share are dealt.
SALTS = 16


def _nodes_array(rows: list[list[Node]]) -> pa.ListArray:
    offsets, flat = [0], [n for r in rows for n in r]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    fields = [pa.array([n[k] for n in flat], f.type) for k, f in enumerate(_NODE)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_NODE)))


class _Elements:
    """Collects the attribute nodes of elements: of traces and their events, and of the parts of a header."""

    def __init__(self):
        self.traces: list[tuple[list[Node], list[list[Node]]]] = []
        self.header: list[tuple[str, dict[str, str], list[Node]]] = []
        self.top: list[Node] = []  # the log's own attributes
        self.into, self.depth = self.top, 0

    def start(self, name: str, given: dict[str, str]) -> None:
        tag = name.rpartition(":")[2]
        if tag in KINDS:
            text = given.get("value", "" if tag in ("string", "id") else None)
            self.into.append((self.depth, tag, given.get("key"), None if tag in HOLDERS else text))
            self.depth += 1
        elif tag == "trace":
            self.traces.append(([], []))
            self.into, self.depth = self.traces[-1][0], 0
        elif tag == "event" and self.traces:
            self.traces[-1][1].append([])
            self.into, self.depth = self.traces[-1][1][-1], 0
        elif tag in ("global", "extension", "classifier"):
            self.header.append((tag, given, []))
            self.into, self.depth = self.header[-1][2], 0

    def end(self, name: str) -> None:
        tag = name.rpartition(":")[2]
        if tag in KINDS:
            self.depth -= 1
        elif tag == "event" and self.traces:
            self.into, self.depth = self.traces[-1][0], 0
        elif tag in ("global", "extension", "classifier"):
            self.into, self.depth = self.top, 0

    def read(self, text: str) -> _Elements:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        parser.Parse(text, False)
        return self


def _trace_tag(spark: SparkSession, path: str) -> str:
    """``trace``, with the prefix that the files give it."""
    opened = r"<((?:[A-Za-z_][\w.\-]*:)?trace)(?:[\s/]|$)"
    found = spark.read.text(path, lineSep=">").select(F.regexp_extract("value", opened, 1).alias("tag")).filter("tag <> ''").limit(1).collect()
    return found[0]["tag"] if found else "trace"


def _parsed(tag: str):
    """A mapInArrow function from records to rows of elements; a trace's own row has pos -1."""
    begin = re.compile(f"<{tag}(?=[\\s/>])")

    def traces(text: str) -> list[tuple[list[Node], list[list[Node]]]]:
        at = begin.search(text)
        if at is None:
            return []
        body = text[at.start() :]
        tail = body.rfind("</")  # behind the last trace only traces without content may stand, and the log's end
        whole = f"<x>{body[:tail]}</x>" if re.match(r"</(?:[\w.\-]+:)?log\s*>\s*$", body[tail:]) else f"<x>{body}</{tag}></x>"
        return _Elements().read(whole).traces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            nodes: list[list[Node]] = []
            for path, start, text in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value"))):
                for own, events in traces(text):
                    name = next((n[3] for n in reversed(own) if n[0] == 0 and n[2] == "concept:name"), "") or ""
                    out += [(path, start, number, name, pos) for pos in range(-1, len(events))]
                    nodes += [own, *events]
                    number += 1
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, _nodes_array(nodes)], ["path", "start", "number", "name", "pos", "typed"])

    return run


def plain_attributes(typed: Column) -> Column:
    """The texts of the outermost attributes that hold a value, by key; the last of a repeated key."""
    own = F.filter(typed, lambda n: (n["depth"] == 0) & n["key"].isNotNull() & ~n["kind"].isin(*HOLDERS))
    keys = F.array_distinct(F.transform(own, lambda n: n["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(own, lambda n: n["key"] == k), F.lit(-1))["text"]))


def nested(typed: Column, key: str) -> Column:
    """What the outermost attribute ``key`` holds, as a list of the same form: the items of a list, the entries of a container, or attributes of an attribute."""
    marked = F.transform(typed, lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    at = F.array_max(F.transform(F.filter(marked, lambda m: (m["n"]["depth"] == 0) & (m["n"]["key"] == key)), lambda m: m["i"]))
    end = F.coalesce(F.array_min(F.transform(F.filter(marked, lambda m: (m["n"]["depth"] == 0) & (m["i"] > at)), lambda m: m["i"])), F.size(typed))
    inner = F.transform(F.slice(typed, at + 2, end - at - 1), lambda n: F.struct((n["depth"] - 1).alias("depth"), n["kind"].alias("kind"), n["key"].alias("key"), n["text"].alias("text")))
    return F.when(at.isNotNull(), inner)


def value_of(typed: Column, key: str, kind: str) -> Column:
    """The outermost attribute ``key`` as a value of its kind; null if there is none, or if its text is no such value."""
    found = F.try_element_at(F.filter(typed, lambda n: (n["depth"] == 0) & (n["key"] == key)), F.lit(-1))["text"]
    readings = {"int": found.try_cast("long"), "float": found.try_cast("double"), "boolean": F.lower(F.trim(found)) == "true", "date": parse_timestamp(found)}
    return readings.get(kind, found)


def read_xes(spark: SparkSession, path: str) -> EventLog:
    """cases and events of ``.xes`` or ``.xes.gz`` files, parsed once and kept as a table; events keep their file order.

    A case is a trace: its id is the trace's name where no other trace has it, else the name (or nothing) with ``#`` and
    the trace's number, with more ``#`` where some trace's own name looks like that. The name itself stays in the case's
    attributes. ``meta`` has what the header declares: classifiers, extensions, globals and the log's own attributes.
    """
    tag = _trace_tag(spark, path)
    rows = spark.read.text(path, lineSep=f"</{tag}>").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    elements = cut(rows.mapInArrow(_parsed(tag), f"path string, start long, number long, name string, pos int, typed {NODES}"), "xes")
    traces = elements.filter("pos = -1")
    marks = 1 + (traces.agg(F.max(F.length(F.regexp_extract("name", "(#+)[0-9]+$", 1)))).first()[0] or 0)
    shared = traces.filter("name <> ''").groupBy("name").agg(F.count("*").alias("k")).filter("k > 1").select("name", F.lit(True).alias("shared"))
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = elements.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"], "left")
    numbered = F.concat("name", F.lit("#" * marks), F.col("number").cast("string"))
    named = named.select(F.when(F.col("shared") | (F.col("name") == ""), numbered).otherwise(F.col("name")).alias("case_id"), "path", "start", "number", "pos", "typed")
    cases = named.filter("pos = -1").select("case_id", F.struct("path", "start", "number").alias("first"), plain_attributes(F.col("typed")).alias("attrs"), "typed")
    events = named.filter("pos >= 0").select("case_id", "pos", plain_attributes(F.col("typed")).alias("attrs"), "typed")
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    events = events.select("case_id", "pos", at("concept:name").alias("activity"), parse_timestamp(at("time:timestamp")).alias("ts"), at("lifecycle:transition").alias("lifecycle"), at("org:resource").alias("resource"), utc_offset_minutes(F.coalesce(at("time:timestamp"), F.lit(""))).alias("tz_offset_min"), "attrs", "typed")
    return EventLog(cases, events, _meta(_header_rows(spark, path, tag)))


HEADER = f"at int, part string, given map<string,string>, typed {NODES}"


def _header_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Extensions, globals, classifiers and the log's own attributes (part ``log``) of all files, each once, with its place in the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_Elements().read(text) for text in batch.column("value").to_pylist()]
            rows = [(k, *r) for e in found for k, r in enumerate((*e.header, ("log", {}, e.top)))]
            if rows:
                at, part, given, nodes = zip(*rows)
                columns = [pa.array(at, pa.int32()), pa.array(part), pa.array([sorted(g.items()) for g in given], pa.map_(pa.string(), pa.string())), _nodes_array(list(nodes))]
                yield pa.RecordBatch.from_arrays(columns, ["at", "part", "given", "typed"])

    heads = spark.read.text(path, lineSep=f"<{tag}").filter(F.col("value").rlike(r"<(?:[\w.\-]+:)?log[\s>]"))
    rows = heads.mapInArrow(run, HEADER)
    return rows.groupBy("part", F.array_sort(F.map_entries("given")).alias("given"), "typed").agg(F.min("at").alias("at")).select("at", "part", F.map_from_entries("given").alias("given"), "typed")


def _meta(rows: DataFrame) -> dict:
    """The header's parts as lists, as large as a header is; of several files all different parts."""
    out: dict = {"classifiers": [], "extensions": [], "globals": {}, "attributes": []}
    names = {"concept:name": "activity", "lifecycle:transition": "lifecycle", "org:resource": "resource"}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r["part"], sorted(r["given"].items()))):
        given, nodes = r["given"], [tuple(n) for n in r["typed"]]
        if r["part"] == "classifier" and given.get("keys"):
            out["classifiers"].append(Classifier(given.get("name", ""), tuple(names.get(k, k) for k in split_keys(given["keys"]))))
        elif r["part"] == "extension":
            out["extensions"].append(dict(given))
        elif r["part"] == "global":
            out["globals"].setdefault(given.get("scope", ""), []).extend(nodes)
        elif r["part"] == "log":
            out["attributes"] += nodes
    return out


def read_xes_header(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """classifiers, extensions, globals (scope, key, value) and log attributes; all small."""
    rows = cut(_header_rows(spark, path, _trace_tag(spark, path)), "xes-header")
    given = lambda part, *keys: rows.filter(F.col("part") == part).select(*(F.try_element_at("given", F.lit(k)).alias(k) for k in keys)).distinct()
    values = rows.filter("part = 'global'").select(F.try_element_at("given", F.lit("scope")).alias("scope"), F.explode(plain_attributes(F.col("typed"))))
    return {
        "classifiers": given("classifier", "name", "keys"),
        "extensions": given("extension", "name", "prefix", "uri"),
        "globals": values.distinct(),
        "attributes": rows.filter("part = 'log'").select(F.explode(plain_attributes(F.col("typed")))).distinct(),
    }


def split_keys(keys: str) -> tuple[str, ...]:
    """Keys between blanks; one with blanks stands in single quotes."""
    out, inside = [], False
    for k, part in enumerate(keys.split("'")):
        out += [part] if inside else part.split()
        inside = not inside
    return tuple(out)


def declared_classifiers(spark: SparkSession, path: str) -> list[Classifier]:
    return _meta(_header_rows(spark, path, _trace_tag(spark, path)))["classifiers"]


def available_classifiers(log: EventLog) -> list[Classifier]:
    """The plain one and the declared ones, by unique name."""
    out = {c.name: c for c in [BY_NAME, *log.meta.get("classifiers", [])]}
    return list(out.values())


# The standard extensions whose keys are written.
EXTENSIONS = {"Concept": "concept", "Lifecycle": "lifecycle", "Organizational": "org", "Time": "time"}
STANDARD = {"activity": "concept:name", "lifecycle": "lifecycle:transition", "resource": "org:resource", "ts": "time:timestamp"}
#: Characters that XML cannot hold.
BARRED = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _element(tag: str, given: dict[str, str], end: str = "/>") -> str:
    return f"<{tag} " + " ".join(f"{k}={quoteattr(BARRED.sub(chr(0xFFFD), v))}" for k, v in given.items()) + end


def xml_of(nodes: list[Node]) -> str:
    """Attribute elements from their nodes in document order; the items of a list stand in its ``values``."""
    out, open_ = [], []
    for i, (depth, kind, key, text) in enumerate(nodes):
        while len(open_) > depth:
            out.append(open_.pop())
        holds = i + 1 < len(nodes) and nodes[i + 1][0] > depth
        given = {} if key is None else {"key": key}
        given |= {} if kind in HOLDERS or text is None else {"value": text}
        out.append(_element(kind, given, ">" if holds or kind in HOLDERS else "/>"))
        if holds or kind in HOLDERS:
            out.append("<values>" if kind == "list" else "")
            open_.append(f"</values></{kind}>" if kind == "list" else f"</{kind}>")
    return "".join(out + open_[::-1])


def _header(meta: dict) -> str:
    """The log's opening tag and header elements; every file of a log has them."""
    extensions = meta.get("extensions") or [{"name": n, "prefix": p, "uri": f"http://www.xes-standard.org/{p}.xesext"} for n, p in EXTENSIONS.items()]
    parts = ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0" xes.features="nested-attributes">']
    parts += [_element("extension", e) for e in extensions]
    parts += [_element("global", {"scope": scope}, ">") + xml_of(nodes) + "</global>" for scope, nodes in meta.get("globals", {}).items()]
    key = lambda k: f"'{k}'" if " " in k else k
    parts += [_element("classifier", {"name": c.name, "keys": " ".join(key(STANDARD.get(k, k)) for k in c.keys)}) for c in meta.get("classifiers", [])]
    return "\n".join([*parts, xml_of(meta.get("attributes", []))])


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType):
        return "float"
    return "date" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "string"


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def nodes_of(value: Column, t: T.DataType, key: Column, depth: int = 0) -> Column:
    """A column of any type as attribute nodes: arrays become lists, maps and structs containers, other values what their type says; null is nothing."""
    none = F.array().cast(NODES)
    node = lambda kind, text: F.array(F.struct(F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), text.cast("string").alias("text")))
    if isinstance(t, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x: nodes_of(x, t.elementType, key, depth + 1)))
        found = F.concat(node("list", F.lit(None)), inner)
    elif isinstance(t, T.MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda e: nodes_of(e["value"], t.valueType, e["key"], depth + 1)))
        found = F.concat(node("container", F.lit(None)), inner)
    elif isinstance(t, T.StructType):
        found = F.concat(node("container", F.lit(None)), *(nodes_of(value[f.name], f.dataType, F.lit(f.name), depth + 1) for f in t.fields))
    else:
        kind = _kind(t)
        found = node(kind, _time(value) if kind == "date" else value)
    return F.when(value.isNull(), none).otherwise(found)


def _written(df: DataFrame, known: dict[str, str], skip: tuple[str, ...]) -> tuple[Column, Column]:
    """The nodes to write, without known columns, and those columns' values by their standard keys as (key, kind, text, same): same where the text that was read means the same time."""
    own = [f for f in df.schema.fields if f.name not in known and f.name not in (*skip, "attrs", "typed")]
    none = F.array().cast(NODES)
    if "typed" in df.columns:
        base = F.coalesce(F.col("typed"), none)
    elif "attrs" in df.columns:
        entries = F.filter(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull() & ~e["key"].isin(*known.values()))
        base = F.transform(entries, lambda e: F.struct(F.lit(0).alias("depth"), F.lit("string").alias("kind"), e["key"].alias("key"), e["value"].alias("text")))
    else:
        base = none
    more = [nodes_of(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in own]
    held = []
    for c, k in known.items():
        if c in df.columns:
            timed = _kind(df.schema[c].dataType) == "date"
            same = parse_timestamp(value_of(base, k, "string")).eqNullSafe(F.col(c).cast("timestamp")) if timed and "typed" in df.columns else F.lit(False)
            held.append(F.struct(F.lit(k).alias("key"), F.lit(_kind(df.schema[c].dataType)).alias("kind"), (_time(F.col(c)) if timed else F.col(c).cast("string")).alias("text"), same.alias("same")))
    values = F.array(*held) if held else F.array().cast("array<struct<key:string,kind:string,text:string,same:boolean>>")
    return F.concat(base, *more), values


def with_known(nodes: list[Node], known: list[tuple[str, str, str | None, bool]]) -> list[Node]:
    """Nodes with the values of known columns: the last outermost attribute of that key takes the text, or goes with all it holds where the column is null."""
    for key, kind, text, same in known:
        at = next((i for i in range(len(nodes) - 1, -1, -1) if nodes[i][0] == 0 and nodes[i][2] == key), None)
        if at is None:
            if text is not None:
                nodes = [*nodes, (0, kind, key, text)]
        elif same:
            continue
        elif text is None:
            end = next((i for i in range(at + 1, len(nodes)) if nodes[i][0] == 0), len(nodes))
            nodes = nodes[:at] + nodes[end:]
        elif text != nodes[at][3]:
            nodes = [*nodes[:at], (0, nodes[at][1], key, text), *nodes[at + 1 :]]
    return nodes


def write_xes(log: EventLog, path: str) -> None:
    """One ``trace`` element per case with all attributes of cases and events, element by element as they were read; columns that were added have the kind of their type, times to the millisecond.

    The header has the extensions, globals, classifiers and attributes of ``meta``. A case's elements are written as they
    come, in order, so no task holds a case.
    """
    cases = log.cases
    known = {}
    if "typed" not in cases.columns and "attrs" not in cases.columns:  # a trace that was read keeps its own name, or none
        cases, known = cases.withColumn("name_", F.col("case_id")), {"name_": "concept:name"}
    of_case, of_event = _written(cases, known, ("case_id", "first")), _written(log.events, STANDARD, ("case_id", "pos", "tz_offset_min"))
    rows = cases.select("case_id", F.lit(-1).cast("long").alias("pos"), of_case[0].alias("nodes"), of_case[1].alias("known"))
    rows = rows.unionByName(log.events.select("case_id", F.col("pos").cast("long").alias("pos"), of_event[0].alias("nodes"), of_event[1].alias("known")))
    header = _header(log.meta)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield line([header])
        open_ = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = xml_of(with_known([tuple(n.values()) for n in r["nodes"]], [tuple(k.values()) for k in r["known"]]))
                if r["pos"] == -1:
                    out += ["</trace>"] if open_ else []
                    open_ = True
                out.append(f"<trace>{own}" if r["pos"] == -1 else f"<event>{own}</event>")
            yield line(out)
        yield line(["</trace></log>" if open_ else "</log>"])

    # by a value of the id: an exchange by the id itself would be left out where both sides of the union come dealt by it, and they are not dealt alike
    rows.repartition(F.xxhash64("case_id")).sortWithinPartitions("case_id", "pos").mapInArrow(lines, "value string").write.text(path)
