"""RDF/XML ontology files as relations: concepts, edges and restriction properties.

A file is cut into byte ranges. A first pass over them counts how far the tags of each range lead down or up, once for each state that the range may begin
in (outside, in a comment, in a CDATA section); from one row for each range it follows at which depth every range begins. A second
pass then finds the class elements that begin in its range below the root, and turns each into rows. So no task reads more than its
ranges and the rest of their last elements, and the driver holds the ranges and the head of the file. A task has as many ranges as make up ``RANGE`` bytes.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

_OWL, _RDF, _RDFS, _SKOS, _XML = (
    "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}",
    "{http://www.w3.org/2004/02/skos/core#}", "{http://www.w3.org/XML/1998/namespace}",
)


def _id(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("#", "/").rstrip("/").rsplit("/", 1)[-1]


def _texts(node, tag: str, lang: str) -> list[str]:
    """Literals in a language, else in English, else without one."""
    found: dict[str, list[str]] = {}
    for x in node.findall(tag):
        found.setdefault(x.get(f"{_XML}lang", ""), []).append(x.text or "")
    return found.get(lang) or found.get("en") or found.get("", [])


def _restriction(node) -> tuple[str | None, str | None]:
    prop, value = node.find(f"{_OWL}onProperty"), node.find(f"{_OWL}someValuesFrom")
    resource = lambda x: None if x is None else _id(x.get(f"{_RDF}resource"))
    return resource(prop), resource(value)


#: Bytes of a range, of the head that is read for the root's tag, and of what is read on for an element that leaves its range.
RANGE, HEAD, STEP = 32 << 20, 1 << 20, 1 << 16
_TOKEN = re.compile(rb"""<!--|<!\[CDATA\[|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[.*?\]\s*)*>|<(/?)([^\s/>!?]+)(?:[^>"']|"[^"]*"|'[^']*')*?(/?)>""", re.DOTALL)
_CLOSED_BY = {b"<!--": b"-->", b"<![CDATA[": b"]]>"}
_STATES = (b"", b"-->", b"]]>")
#: What doesn't follow the ``<`` of a tag.
_NO_NAME = (b" ", b"\t", b"\r", b"\n", b"<", b">", b"=")
_CLASS = "concept string, label string, label_parent string, alt_label array<string>, definition array<string>, edges array<struct<parent:string,parent_pos:int>>, properties array<struct<prop_pos:int,property_type:string,prop:string,value:string>>, unknown array<string>"


def _described(node, lang: str) -> tuple | None:
    """A class element as the row of ``_CLASS``; None if it has no name.

    A named superclass is an edge; the parts of an intersection or union are edges or restrictions in
    turn, and their type is kept; a restriction to a class is simple.
    """
    own = _id(node.get(f"{_RDF}about"))
    if own is None:
        return None
    edges, properties, unknown = [], [], []
    labels, alt, parent = (_texts(node, tag, lang) for tag in (f"{_RDFS}label", f"{_SKOS}altLabel", f"{_SKOS}prefLabel"))
    stack = [(x, "simple") for tag in (f"{_RDFS}subClassOf", f"{_OWL}equivalentClass") for x in node.findall(tag)][::-1]
    while stack:
        x, kind = stack.pop()
        target = _id(x.get(f"{_RDF}resource") or (x.get(f"{_RDF}about") if x.tag in (f"{_OWL}Class", f"{_RDF}Description") else None))
        if target:
            edges.append((target, len(edges)))
        elif x.tag == f"{_OWL}Restriction":
            prop, value = _restriction(x)
            if prop and value:
                properties.append((len(properties), kind, prop, value))
            elif (inner := x.find(f"{_OWL}someValuesFrom")) is not None and len(inner):
                stack.extend((y, kind if kind != "simple" else "res_simple") for y in reversed(list(inner)))
            else:
                unknown.append(x.tag)
        else:
            if not len(x):
                unknown.append(x.tag)
            inner_kind = {f"{_OWL}intersectionOf": "and", f"{_OWL}unionOf": "or"}.get(x.tag, kind)
            stack.extend((y, inner_kind) for y in reversed(list(x)))
    return own, labels[0] if labels else "", parent[0] if parent else "", [*labels[:1], *alt], _texts(node, f"{_SKOS}definition", lang), edges, properties, unknown


def parse(file, lang: str = "en") -> tuple[list, list, list, list]:
    """From a path or an open file of small size, rows of concepts, edges and properties, and what was not understood."""
    rows = [r for node in ET.parse(file).getroot().findall(f"{_OWL}Class") if (r := _described(node, lang))]
    return (
        [r[:5] for r in rows], [(r[0], *e) for r in rows for e in r[5]],
        [(r[0], nr, kind, {prop: value}) for r in rows for nr, kind, prop, value in r[6]], [(r[0], tag) for r in rows for tag in r[7]])


class _Bytes:
    """A file from a place on, read as far as it is asked for."""

    def __init__(self, path: str, start: int, size: int):
        self.file, self.start = open(path, "rb"), start  # noqa: SIM115  closed by ``tokens``
        self.file.seek(start)
        self.data = self.file.read(size)

    def more(self) -> bool:
        got = self.file.read(STEP)
        self.data += got
        return bool(got)

    def find(self, what: bytes, at: int, stop: int) -> int:
        """The end of the next ``what`` if it lies at or before ``stop``, else -1; nothing beyond ``stop`` is looked at."""
        while (found := self.data.find(what, at, stop)) < 0:
            at = max(at, len(self.data) - len(what) + 1)
            if len(self.data) >= stop or not self.more():
                return -1
        return found + len(what)


def _tokens(source: _Bytes, at: int, stop: Callable[[], int]):
    """Starts, ends, opening (1), closing (-1) or other (0), and names of the tags from a place on; of those that begin before ``stop``, or all while it is asked for more.

    A comment or CDATA section has its closing mark as name, and -1 as end if it doesn't end before ``stop``; it is the last one then. So is a mark that begins no
    tag, as there are where a range is read in a state that it doesn't begin in.
    """
    while True:
        start = source.data.find(b"<", at)
        if start < 0 and stop() > len(source.data) and source.more():
            continue
        if start < 0 or start >= stop():
            return
        if len(source.data) - start < len(b"<![CDATA["):
            source.more()
        for mark, close in _CLOSED_BY.items():
            if source.data.startswith(mark, start):
                end = source.find(close, start + len(mark), stop())
                yield start, end, 0, close
                break
        else:
            while not (found := _TOKEN.match(source.data, start)):
                if source.data[start + 1 : start + 2] in _NO_NAME or not source.more():
                    return
            end = found.end()
            kind = 0 if not found.group(2) or found.group(3) else -1 if found.group(1) else 1
            yield start, end, kind, found.group(2) or b""
        if end < 0:
            return
        at = end


def _begin(source: _Bytes, state: bytes, at: int, end: int) -> int:
    """Where the tags of a range begin in the state that it begins in; -1 if the state lasts beyond its end."""
    return at if not state else source.find(state, max(at - len(state) + 1, 0), end)


def _scan(path: str, start: int, size: int) -> list[tuple[int, int]]:
    """For each state that a range may begin in: how far down its tags lead, and the state in which the next one begins."""
    out = []
    back = min(start, 2)  # a closing mark can lie across the start
    for state in _STATES:
        source = _Bytes(path, start - back, size + back)
        end = size + back
        at = _begin(source, state, back, end)
        down, after = 0, state if at < 0 else b""
        if not after:
            for _, e, kind, name in _tokens(source, at, lambda end=end: end):
                down += kind
                after = name if e < 0 else b""
        source.file.close()
        out.append((down, _STATES.index(after)))
    return out


def _classes(path: str, start: int, size: int, state: int, depth: int):
    """The bytes of the class elements right below the root that begin in a range, whatever prefix they have."""
    back = min(start, 2)
    source = _Bytes(path, start - back, size + back)
    end, own, limit = size + back, None, [size + back]
    at = _begin(source, _STATES[state], back, end)
    if at >= 0:
        for s, e, kind, name in _tokens(source, at, lambda: limit[0]):
            local = name.rsplit(b":", 1)[-1]
            if own is None and kind == 1 and depth == 1 and local == b"Class" and s < end:
                own, limit[0] = s, 1 << 62  # to its end, wherever that is
            elif own is None and not kind and depth == 1 and local == b"Class" and s < end:
                yield source.data[s:e]
            depth += kind
            if own is not None and depth == 1 and kind == -1:
                yield source.data[own:e]
                own, limit[0] = None, end
                if e >= end:
                    break
    source.file.close()


def _mounted(path: str) -> str:
    at = urlparse(str(path))
    if at.scheme not in ("", "file"):
        raise ValueError(f"an ontology is read in ranges from a mounted folder, not from {at.scheme}://")
    return at.path


def classes(spark: SparkSession, path: str, lang: str = "en", range_bytes: int = RANGE) -> DataFrame:
    """A row of ``_CLASS`` for every named class below the root of an RDF/XML file that all executors see."""
    path = _mounted(path)
    size = os.path.getsize(path)
    n = max(1, -(-size // range_bytes))
    tasks = min(n, max(-(-size // RANGE), 2 * spark.sparkContext.defaultParallelism))
    with open(path, "rb") as f:
        head = f.read(HEAD)
    root = next((m for m in _TOKEN.finditer(re.sub(rb"<!--.*?-->", lambda c: b" " * len(c.group()), head, flags=re.DOTALL)) if m.group(2)), None)
    if root is None:
        raise ValueError(f"no element in the first {HEAD} bytes of {path}")
    before, after = head[: root.end()], b"</" + root.group(2) + b">"

    def scan(batches):
        for batch in batches:
            found = [_scan(path, i * range_bytes, range_bytes) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x for pair in f for x in pair] for f in found], pa.list_(pa.int64()))], ["id", "found"])

    state, depth, begins = 0, 0, []
    for r in sorted(spark.range(0, n, 1, tasks).mapInArrow(scan, "id long, found array<bigint>").collect()):  # a row for each range
        begins.append((r.id, state, depth))
        down, state = r.found[2 * state : 2 * state + 2]
        depth += down

    def read(batches):
        for batch in batches:
            for i, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for element in _classes(path, i * range_bytes, range_bytes, state, depth):
                    node = ET.fromstring(before + element + after)[0]
                    row = _described(node, lang) if node.tag == f"{_OWL}Class" else None
                    held += [row] if row else []
                    if len(held) == 1000:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    edge, prop = pa.struct([("parent", pa.string()), ("parent_pos", pa.int32())]), pa.struct([("prop_pos", pa.int32()), ("property_type", pa.string()), ("prop", pa.string()), ("value", pa.string())])
    kinds = [pa.string()] * 3 + [pa.list_(pa.string())] * 2 + [pa.list_(edge), pa.list_(prop), pa.list_(pa.string())]
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ \w)", _CLASS)]

    def made(rows):
        columns = [list(c) for c in zip(*rows, strict=True)]
        for at, kind in ((5, edge), (6, prop)):
            columns[at] = [[dict(zip((f.name for f in kind), x, strict=True)) for x in own] for own in columns[at]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ranges = spark.createDataFrame(begins, "i long, state int, depth long").repartitionByRange(tasks, "i")
    return ranges.mapInArrow(read, _CLASS)


def load(spark: SparkSession, path: str, lang: str = "en", range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The concept, edge and property relations of an ontology file, and what was not understood (concept_id, tag)."""
    rows = storage.table(spark, classes(spark, path, lang, range_bytes), "classes")
    concepts = rows.select(F.col("concept").alias("id"), "label", "label_parent", "alt_label", "definition")
    edges = rows.select(F.col("concept").alias("child"), F.inline("edges"))
    properties = rows.select(F.col("concept").alias("concept_id"), F.inline("properties"))
    label = lambda c: concepts.groupBy(F.col("id").alias(c)).agg(F.max("label").alias(f"{c}_label"))
    named = properties.join(label("prop"), "prop", "left").join(label("value"), "value", "left")
    pair = lambda k, v: F.map_from_arrays(F.array(k), F.array(v))
    named = named.select("concept_id", "prop_pos", "property_type", pair("prop", "value").alias("ids"), pair(F.coalesce("prop_label", "prop"), F.coalesce("value_label", "value")).alias("labels"))
    return concepts, edges, named, rows.select(F.col("concept").alias("concept_id"), F.explode("unknown").alias("tag"))


def cache(spark: SparkSession, path: str, folder: str, rebuild: bool = False, range_bytes: int = RANGE) -> tuple[DataFrame, ...]:
    """The concept, edge and property relations from Parquet, converted first where they are not there; ``folder``/unknown has what was not understood."""
    names = ("concept", "edge", "property", "unknown")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/unknown/_SUCCESS")
    if rebuild or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        for name, df in zip(names, load(spark, path, range_bytes=range_bytes), strict=True):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in names[:3])
