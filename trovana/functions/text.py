"""Text functions of the catalog: folding, stable ids, name parts, boundaries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters that part the components of a name.
SEPARATORS = "/\\-_. "
#: The same as a class of a regular expression.
SEPARATOR_CLASS = r"[/\\\-_. ]"


def fold_text(value: str) -> str:
    """Case, diacritics and width folded away; the scalar twin of ``fold``."""
    if value.isascii():
        return value.lower()
    out = []
    for ch in value:
        if unicodedata.east_asian_width(ch) in "FH":
            ch = unicodedata.normalize("NFKC", ch)
        out += [c for c in unicodedata.normalize("NFD", ch.casefold() if ch != "ß" else ch) if not unicodedata.combining(c)]
    return unicodedata.normalize("NFC", "".join(out)).lower()


@F.pandas_udf(T.StringType())
def _fold_wide(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(lambda x: None if x is None else fold_text(x), na_action="ignore")


def fold(text: Column) -> Column:
    """Folded text, to be stored with the catalog; of rows in plain ASCII only a null goes into the Arrow call."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(_fold_wide(F.when(~plain, text)))


@F.arrow_udf(T.LongType())
def _fnv(values: pa.Array) -> pa.Array:
    """FNV-1a 64 of each value's bytes, as a signed number: byte by byte, for all values of a batch that have one there."""
    raw = values.fill_null("").cast(pa.large_binary())
    n = len(raw)
    if not n:
        return pa.array([], pa.int64())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, n + 1, 8 * raw.offset)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, shorter = offsets[:-1][order], -sizes[order]
    h = np.full(n, 14695981039346656037, np.uint64)
    for k in range(int(sizes.max())):
        some = int(np.searchsorted(shorter, -k))
        h[:some] = (h[:some] ^ data[begin[:some] + k]) * np.uint64(0x100000001B3)
    out = np.empty(n, np.uint64)
    out[order] = h
    return pa.array(out.view(np.int64))


def stable_id(path: Column) -> Column:
    """FNV-1a 64 of the UTF-8 path as DECIMAL(20,0), 0 becoming 1. Each byte needs the result of the one before: an expression would be interpreted byte by byte."""
    h = F.coalesce(_fnv(path), F.lit(0)).cast("decimal(20,0)")
    return F.when(h == 0, F.lit(1)).when(h < 0, h + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)")


def last_component(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(name == "", path).otherwise(name)


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(path, r"/+[^/]*/*$", "")
    return F.when((up == "") & path.startswith("/"), "/").otherwise(up)


def extension(name: Column) -> Column:
    """Lower-cased part behind the last dot; none for a name that only begins with one or ends with one."""
    return F.lower(F.regexp_extract(name, r"^.*[^/.].*\.([^./ ]+)$|^[^/.]+\.([^./ ]+)$", 1))


def is_hidden_path(path: Column) -> Column:
    """Some component begins with a dot and is neither ``.`` nor ``..``."""
    return path.rlike(r"(^|/)\.(?!/|$|\./|\.$)")


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def depth_penalty(path: Column) -> Column:
    return F.least(F.lit(120), 4 * (F.length(path) - F.length(F.replace(path, F.lit("/")))))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
