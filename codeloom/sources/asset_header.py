"""Class and parent class from the header of a binary asset."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only so many bytes of a file are looked at.
HEAD = 256 * 1024
# Fixed values of the format.
MAGIC = 0x9E2A83C1
VERSIONS = (-6, -7, -8)
GENERATED = ("BlueprintGeneratedClass", "WidgetBlueprintGeneratedClass", "AnimBlueprintGeneratedClass", "GameplayAbilityBlueprintGeneratedClass")
LOCALISED_SINCE = 516


class Broken(Exception):
    """The bytes are not a header as the format has it."""


class Reader:
    """Reads little-endian numbers and counted strings one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, at: int | None = None) -> int:
        where = self.at if at is None else at
        if where < 0 or where + 4 > len(self.data):
            raise Broken
        if at is None:
            self.at += 4
        return struct.unpack_from("<i", self.data, where)[0]

    def skip(self, size: int) -> None:
        self.at += size
        if self.at > len(self.data):
            raise Broken

    def string(self) -> str:
        """A count, then that many bytes, or for a negative count that many two-byte units, the last of them null."""
        count = self.number()
        size = count if count >= 0 else -2 * count
        start = self.at
        self.skip(size)
        if not count:
            return ""
        return self.data[start : self.at - 1].decode("utf-8", "replace") if count > 0 else self.data[start : self.at - 2].decode("utf-16-le", "replace")


def _within(value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise Broken
    return value


def _tables(data: bytes) -> tuple[list[tuple[str | None, str | None]], list[tuple[int, int]]]:
    """The imports as (class, name) and the exports as (class index, super index)."""
    r = Reader(data)
    if len(data) < 32 or r.number() & 0xFFFFFFFF != MAGIC:
        raise Broken
    version = r.number()
    if version not in VERSIONS:
        raise Broken
    r.skip(4)
    file_version = r.number()
    newer = r.number() if version <= -8 else 0
    r.skip(4)
    r.skip(20 * _within(r.number(), 0, 1000))
    r.skip(4)
    r.string()
    r.skip(4)
    n_names, names_at = _within(r.number(), 0, 500_000), r.number()
    if newer > 0:
        r.skip(8)
    if file_version >= LOCALISED_SINCE:
        r.string()
        r.skip(8)
    n_exports, exports_at = _within(r.number(), 0, 100_000), r.number()
    n_imports, imports_at = _within(r.number(), 0, 100_000), r.number()
    depends_at = r.number()
    for place in (names_at, exports_at, imports_at):
        _within(place, 1, len(data) - 1)
    import_size = _within((exports_at - imports_at) // n_imports if n_imports else 0, 28, 64)
    export_size = _within((depends_at - exports_at) // n_exports if n_exports else 0, 56, 200)
    names_reader, names = Reader(data, names_at), []
    for _ in range(n_names):
        names.append(names_reader.string())
        names_reader.skip(4)
    name = lambda i: names[i] if 0 <= i < len(names) else None
    if imports_at + (n_imports - 1) * import_size + 28 > len(data):
        raise Broken
    imports = [(name(r.number(b + 8)), name(r.number(b + 20))) for b in range(imports_at, imports_at + n_imports * import_size, import_size)]
    whole = exports_at + n_exports * export_size <= len(data)
    count = n_exports if whole else min(1, (len(data) - exports_at) // export_size)
    exports = [(r.number(b), r.number(b + 4)) for b in range(exports_at, exports_at + count * export_size, export_size)]
    return imports, exports if whole else exports[:1] and [(*exports[0][:1], 0)]


def asset_classes(data: bytes | None) -> tuple[str | None, str | None]:
    """(asset class, parent class): of the export that is made of a generated class, and its super class; without such a
    class the class of the first export, and no parent. Anything that is no such header gives nulls."""
    try:
        imports, exports = _tables(bytes(data or b"")[:HEAD])
    except (Broken, struct.error):
        return None, None
    imported = lambda index: imports[-index - 1] if index < 0 and -index - 1 < len(imports) else (None, None)
    made_of = next((i for i, (kind, name) in enumerate(imports) if kind == "Class" and name in GENERATED), None)
    if made_of is not None:
        for class_index, super_index in exports:
            if class_index == -made_of - 1:
                return imports[made_of][1], imported(super_index)[1]
    return (imported(exports[0][0])[1] if exports else None), None


def _classes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([asset_classes(d) for d in data], columns=["asset_class", "parent_class"])


_CLASSES = T.StructType([T.StructField("asset_class", T.StringType()), T.StructField("parent_class", T.StringType())])


def header_classes(content: Column) -> Column:
    """``asset_classes`` of a binary column, as a struct; only the head of each file leaves the JVM."""
    return F.pandas_udf(_classes, _CLASSES)(F.substring(content, 1, HEAD))
