"""Field addresses (``a.b.c[:field]``, ``*``, ``$``) compiled to XPath over the record tree."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The steps of the record tree, which addresses are written against.
ROOT = "/*[local-name()='metadata']"
ELEMENT, FIELD = "local-name()='element'", "local-name()='field'"


def _quoted(name: str) -> str:
    """An XPath string literal."""
    return f"'{name}'" if "'" not in name else f'"{name}"'


def xpath_of(address: str) -> str:
    """The node path of an address: elements by name, ``*`` for any element below, ``$`` to stop at the element."""
    if not address:
        return f"{ROOT}/*[{FIELD} and @name='value']"
    parts, field = address.split("."), "value"
    if ":" in parts[-1]:
        parts[-1], field = parts[-1].split(":", 1)
    path = ROOT
    for part in parts:
        if part == "$":
            return path
        path += f"//*[{ELEMENT}]" if part == "*" else f"/*[{ELEMENT} and @name={_quoted(part)}]"
    return f"{path}/*[{FIELD} and @name={_quoted(field)}]"


def occurrences(xml: Column, address: str) -> Column:
    """Non-empty text values of an address, in document order."""
    return F.filter(F.xpath(xml, F.lit(f"{xpath_of(address)}/text()")), lambda v: v != "")


def first_occurrence(xml: Column, address: str) -> Column:
    return F.get(occurrences(xml, address), F.lit(0))


def node_count(xml: Column, xpath: str) -> Column:
    """Nodes with text under an XPath."""
    return F.size(F.xpath(xml, F.lit(f"{xpath}/text()")))


# What ElementTree and XPath may read differently: comments, CDATA sections, declarations, and prefixes.
_UNUSUAL = r"<[!?]|</?[^<>\s]+:|\sxmlns:"


def _fields_of(root: ElementTree.Element, address: str) -> list[str] | None:
    """What ``occurrences`` gives for a tree without prefixes; None if a field has nodes below it, where text is in pieces."""
    local = lambda node: node.tag.rsplit("}", 1)[-1]
    parts, field, sort = address.split(".") if address else [], "value", False
    if parts and ":" in parts[-1]:
        parts[-1], field = parts[-1].split(":", 1)
    found = [root] if local(root) == "metadata" else []
    for part in parts:
        if part == "*":
            found, sort = list({id(n): n for above in found for n in above.iter() if n is not above and local(n) == "element"}.values()), True
        else:
            found = [n for above in found for n in above if local(n) == "element" and n.get("name") == part]
    found = [n for above in found for n in above if local(n) == "field" and n.get("name") == field]
    if any(len(n) for n in found):
        return None
    if sort and len(found) > 1:
        wanted = {id(n) for n in found}
        found = [n for n in root.iter() if id(n) in wanted]
    return [n.text for n in found if n.text]


def all_occurrences(xml: Column, addresses: list[str]) -> list[Column]:
    """``occurrences`` for several addresses: a plain document is parsed once for all of them, any other by XPath for each."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[list[str]] | None:
            try:
                root = ElementTree.fromstring(text) if text else None
            except ElementTree.ParseError:
                return None
            out = [_fields_of(root, a) for a in addresses] if root is not None else [None]
            return None if None in out else out

        return texts.map(one)

    if any("$" in a.split(".") for a in addresses):
        return [occurrences(xml, a) for a in addresses]
    plain = read(F.when(~xml.rlike(_UNUSUAL), xml))
    return [F.when(plain.isNotNull(), F.get(plain, F.lit(i))).otherwise(occurrences(xml, a)) for i, a in enumerate(addresses)]
