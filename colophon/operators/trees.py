"""Records as ordered trees: one row for each node, with its path and its place in document order.

A node has ``pre``, its number in document order, and ``last``, the number of the last node below it, so what lies
under a node is a range of numbers, and sub-documents and look-ups are joins by record with a range condition. ``path``
has a step for each node from the root, its local tag and, after ``=``, its name attribute. Values written to another
field come after all others there (``moved``), as in a record whose fields have one parent for each address.

Text that is no XML gives no nodes.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import bounded_batches
from colophon.shipping import ship

#: Begins a step of a path; no XML text can hold it.
STEP = "\x1f"
NODE = "pre int, last int, parent int, moved int, tag string, name string, attributes map<string, string>, path string, text string"
#: Nodes of a record that a rename moves at most.
MOST_MOVED = 101

_COLUMNS = [column.split()[0] for column in NODE.replace("map<string, string>", "map").split(", ")]
_TEXT = pa.string()


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1] if "}" in name else name


def _add_nodes(xml: str | None, kinds: dict[tuple, int], parents: list[int], of: list[int], texts: list[str | None]) -> None:
    """Append the nodes of one document in order, and what tags, attributes and places are new to ``kinds``; without recursion, so depth is no limit."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return
    first, open_ = len(parents), [(root, -1, -1)]
    while open_:
        element, parent, above = open_.pop()
        kind = kinds.setdefault((above, element.tag, *element.items()), len(kinds))
        if len(element):
            pre = len(parents) - first
            open_ += [(child, pre, kind) for child in reversed(element)]
        parents.append(parent)
        of.append(kind)
        texts.append(element.text or None)


def _last_below(parents: list[int]) -> list[int]:
    """The number of the last node below each node of one document."""
    last = list(range(len(parents)))
    for i in range(len(parents) - 1, 0, -1):
        if last[i] > last[parents[i]]:
            last[parents[i]] = last[i]
    return last


def _trees_of(documents: pa.Array) -> pa.Array:
    """The list of nodes of each document; nodes of the same place, tag and attributes share one entry of ``kinds``."""
    kinds: dict[tuple, int] = {}
    parents, of, texts, ends, last = [], [], [], [0], []
    for xml in documents.to_pylist():
        _add_nodes(xml, kinds, parents, of, texts)
        last += _last_below(parents[ends[-1] :])
        ends.append(len(parents))
    tags, names, attributes, paths = [], [], [], []
    for above, tag, *items in kinds:
        found = {_local(k): v for k, v in items}
        tags.append(_local(tag))
        names.append(found.get("name"))
        attributes.append(list(found.items()))
        paths.append((paths[above] if above >= 0 else "") + STEP + tags[-1] + (f"={found['name']}" if "name" in found else ""))
    pre = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    numbers = [pa.array(np.asarray(x, np.int32)) for x in (pre, last, parents, np.zeros(ends[-1]))]
    at = pa.array(of, pa.int32())
    shared = [pa.array(x, t).take(at) for x, t in ((tags, _TEXT), (names, _TEXT), (attributes, pa.map_(_TEXT, _TEXT)), (paths, _TEXT))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*numbers, *shared, pa.array(texts, _TEXT)], _COLUMNS))


def nodes(df: DataFrame, xml: str, key: str = "record_id") -> DataFrame:
    """The key and the columns of ``NODE`` for each element of each document.

    Trees are dealt out by the key, each as one row, so that joins and windows by record need no shuffle of their nodes.
    """
    ship(df.sparkSession)
    bounded_batches()
    # Called non-deterministic, so that the filter that Spark infers from the inline is not computed by parsing again.
    parse = F.arrow_udf(_trees_of, f"array<struct<{NODE}>>").asNondeterministic()
    return df.select(key, parse(F.col(xml)).alias("_nodes")).repartition(F.col(key)).select(key, F.inline("_nodes"))


def _pattern(address: str, with_field: bool = True) -> str:
    """A field address as a pattern of paths."""
    parts, field = address.split("."), "value"
    if ":" in parts[-1]:
        parts[-1], field = parts[-1].split(":", 1)
    steps = [f"(?:{STEP}[^{STEP}]*)*{STEP}element(?:=[^{STEP}]*)?" if p == "*" else f"{STEP}element={re.escape(p)}" for p in parts if p != "$"]
    return "".join(steps) + (f"{STEP}field={re.escape(field)}" if with_field and "$" not in parts else "")


def at(address: str) -> Column:
    """Nodes of a field address (``a.b:field``, ``*``), or of the element if it ends in ``$``."""
    return F.col("path").rlike(rf"\A{STEP}metadata{_pattern(address)}\z")


def with_sibling(tree: DataFrame, field: str, name: str, key: str = "record_id") -> DataFrame:
    """The nodes, with the first value of a field beside each (of the same parent) as column ``name``."""
    beside = Window.partitionBy(key, "parent")
    value = F.when((F.col("tag") == "field") & (F.col("name") == field), F.struct("pre", "text"))
    return tree.withColumn(name, F.min(value).over(beside)["text"])


def sub_documents(tree: DataFrame, element: str, key: str = "record_id") -> DataFrame:
    """The nodes under each element of an address, by the element's number ``root``; ``path`` begins below it.

    Elements of an address without ``*`` have one depth, so the one that a node is under is the last before it.
    """
    if "*" not in element.split("."):
        before = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
        seen = tree.withColumn("_root", F.last(F.when(at(f"{element}.$"), F.struct("pre", "last", F.length("path").alias("skip"))), ignorenulls=True).over(before))
        under = seen.where(F.col(key).isNotNull() & (F.col("pre") > F.col("_root.pre")) & (F.col("pre") <= F.col("_root.last")))
        return under.withColumns({"path": F.expr("substring(path, _root.skip + 1)"), "root": F.col("_root.pre")}).drop("_root")
    roots = tree.where(at(f"{element}.$")).select(key, F.col("pre").alias("root"), F.col("last").alias("end"), F.length("path").alias("skip"))
    below = tree.join(roots, key).where((F.col("pre") > F.col("root")) & (F.col("pre") <= F.col("end")))
    return below.withColumn("path", F.expr("substring(path, skip + 1)")).drop("end", "skip")


def look_up(tree: DataFrame, element: str, discriminator: str, value: str, wanted: str, key: str = "record_id") -> DataFrame:
    """For each record the first ``wanted`` under the first element whose first ``discriminator`` has the value.

    Both are field names, or addresses below the element. Records without such an element give no row.
    """
    below = lambda name: F.col("path").rlike(rf"\A{_pattern(name) if '.' in name or ':' in name else f'{STEP}field={re.escape(name)}'}\z") & F.col("text").isNotNull()
    first = lambda name: F.min(F.when(below(name), F.struct("pre", "text")))["text"]
    each = sub_documents(tree, element, key).where(below(discriminator) | below(wanted)).groupBy(key, "root").agg(first(discriminator).alias("is"), first(wanted).alias("value"))
    return each.where(F.col("is") == value).groupBy(key).agg(F.min_by("value", "root").alias("value"))


def rename(tree: DataFrame, condition: Column, target: str, most: int = MOST_MOVED, key: str = "record_id") -> DataFrame:
    """Field nodes with text that meet a condition become values of the target address, at its end and in their order.

    Of each record the first ``most`` are moved. ``transformed`` tells whether any was.
    """
    goes = F.coalesce(condition, F.lit(False)) & F.col("text").isNotNull()
    order = Window.partitionBy(key)
    counted = tree.withColumn("_n", F.sum(goes.cast("int")).over(order.orderBy("pre")))
    moves = goes & (F.col("_n") <= most)
    path = STEP + "metadata" + "".join(f"{STEP}element={p}" for p in target.split(":")[0].split(".")) + f"{STEP}field={target.split(':')[1] if ':' in target else 'value'}"
    out = counted.withColumns({"path": F.when(moves, path).otherwise(F.col("path")), "moved": F.when(moves, F.col("moved") + 1).otherwise(F.col("moved")), "transformed": F.max(moves).over(order)})
    return out.drop("_n")


def fields(tree: DataFrame, key: str = "record_id") -> DataFrame:
    """The occurrences of all fields: key, field (its address), pos and value, in document order."""
    found = tree.where((F.col("path").rlike(rf"{STEP}field=[^{STEP}]*\z")) & F.col("text").isNotNull())
    name = F.substring_index("path", f"{STEP}field=", -1)
    address = F.concat(F.array_join(F.regexp_extract_all("path", F.lit(f"{STEP}element=([^{STEP}]*)"), 1), "."), F.when(name == "value", "").otherwise(F.concat(F.lit(":"), name)))
    numbered = found.withColumn("pos", F.row_number().over(Window.partitionBy(key, "path").orderBy("moved", "pre")) - 1)
    return numbered.select(key, address.alias("field"), "pos", F.col("text").alias("value"))
