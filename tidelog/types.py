"""Values, types and row schemas.

A value is one of eight kinds with a total order that goes by kind first (Ent < Int < Float < Text < Bool <
Tuple < Bytes < Code) and is strict about kinds: 1, 1.0 and entity 1 are three values.  In DataFrames columns
of known type are plain Spark types; columns of type Any hold the order-preserving binary encoding below, so
that equality, hashing and order agree with the values' own.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Ent(int):
    """An opaque identity, 0 or more."""

    def __new__(cls, value: int) -> Ent:
        if value < 0:
            raise ValueError("an entity is 0 or more")
        return super().__new__(cls, value)

    def __repr__(self) -> str:
        return f"Ent({int(self)})"


class Code(bytes):
    """A serialised behaviour."""


class Ty(Enum):
    ENT = "Ent"
    INT = "Int"
    FLOAT = "Float"
    TEXT = "Text"
    BOOL = "Bool"
    TUPLE = "Tuple"
    BYTES = "Bytes"
    CODE = "Code"
    ANY = "Any"

    @property
    def spark(self) -> T.DataType:
        return {Ty.ENT: T.LongType(), Ty.INT: T.LongType(), Ty.FLOAT: T.DoubleType(), Ty.TEXT: T.StringType(), Ty.BOOL: T.BooleanType()}.get(self, T.BinaryType())


_RANK = {Ty.ENT: 0, Ty.INT: 1, Ty.FLOAT: 2, Ty.TEXT: 3, Ty.BOOL: 4, Ty.TUPLE: 5, Ty.BYTES: 6, Ty.CODE: 7}
_INT = range(-(1 << 63), 1 << 63)


def type_of(v: object) -> Ty:
    """The kind of a Python value; anything else is refused, so are integers beyond 64 bits and floats that are no numbers."""
    if isinstance(v, bool):
        return Ty.BOOL
    if isinstance(v, Ent):
        return Ty.ENT
    if isinstance(v, int) and v in _INT:
        return Ty.INT
    if isinstance(v, float) and math.isfinite(v):
        return Ty.FLOAT
    if isinstance(v, str):
        return Ty.TEXT
    if isinstance(v, tuple):
        return Ty.TUPLE
    if isinstance(v, Code):
        return Ty.CODE
    if isinstance(v, bytes):
        return Ty.BYTES
    raise TypeError(f"{v!r} is no value")


def key(v: object) -> tuple:
    """A Python key that compares and hashes as the value does."""
    t = type_of(v)
    if t is Ty.TUPLE:
        return (5, tuple(key(x) for x in v))
    if t is Ty.TEXT:
        return (3, v.encode("utf-8", "surrogatepass"))
    if t is Ty.FLOAT:
        return (2, v + 0.0)
    return (_RANK[t], bytes(v) if t in (Ty.BYTES, Ty.CODE) else int(v))


def row_key(row: Sequence) -> tuple:
    return tuple(key(v) for v in row)


def _escaped(b: bytes) -> bytes:
    return b.replace(b"\x00", b"\x00\xff") + b"\x00\x01"


def encode(v: object) -> bytes:
    """The value as bytes whose order is the values' order."""
    t = type_of(v)
    head = bytes([0x10 + _RANK[t]])
    if t in (Ty.ENT, Ty.INT):
        return head + struct.pack(">Q", (int(v) + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)
    if t is Ty.FLOAT:
        bits = struct.unpack(">Q", struct.pack(">d", v + 0.0))[0]
        return head + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))
    if t is Ty.TEXT:
        return head + _escaped(v.encode("utf-8"))
    if t is Ty.BOOL:
        return head + bytes([v])
    if t is Ty.TUPLE:
        return head + b"".join(encode(x) for x in v) + b"\x00"
    return head + _escaped(bytes(v))


def decode(data: bytes) -> object:
    v, at = _decode(bytes(data), 0)
    if at != len(data):
        raise ValueError("bytes after the value")
    return v


def _decode(d: bytes, at: int) -> tuple[object, int]:
    rank, at = d[at] - 0x10, at + 1
    if rank in (0, 1):
        n = struct.unpack_from(">Q", d, at)[0] - (1 << 63)
        return (Ent(n) if rank == 0 else n), at + 8
    if rank == 2:
        bits = struct.unpack_from(">Q", d, at)[0]
        return struct.unpack(">d", struct.pack(">Q", bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)))[0], at + 8
    if rank == 4:
        return bool(d[at]), at + 1
    if rank == 5:
        out = []
        while d[at] != 0:
            v, at = _decode(d, at)
            out.append(v)
        return tuple(out), at + 1
    if rank not in (3, 6, 7):
        raise ValueError("unknown kind of value")
    out, start = bytearray(), at
    while True:
        z = d.index(b"\x00", start)
        out += d[start:z]
        if d[z + 1] == 1:
            raw = bytes(out)
            return (raw.decode("utf-8") if rank == 3 else Code(raw) if rank == 7 else raw), z + 2
        out.append(0)
        start = z + 2


def to_cell(v: object, ty: Ty) -> object:
    """A checked value as what a DataFrame column of type ty holds."""
    t = type_of(v)
    if ty is not Ty.ANY and t is not ty:
        raise TypeError(f"{v!r} is {t.value}, not {ty.value}")
    if ty in (Ty.ANY, Ty.TUPLE):
        return encode(v)
    if ty in (Ty.ENT, Ty.INT):
        return int(v)
    return v + 0.0 if ty is Ty.FLOAT else bytes(v) if ty in (Ty.BYTES, Ty.CODE) else v


def from_cell(c: object, ty: Ty) -> object:
    if ty in (Ty.ANY, Ty.TUPLE):
        return decode(c)
    return Ent(c) if ty is Ty.ENT else Code(c) if ty is Ty.CODE else bytes(c) if ty is Ty.BYTES else c


@dataclass(frozen=True)
class Schema:
    """Named, typed columns; their order is the row's layout."""

    columns: tuple[tuple[str, Ty], ...]

    @staticmethod
    def of(*columns: tuple[str, Ty] | str) -> Schema:
        out = tuple((c, Ty.ANY) if isinstance(c, str) else c for c in columns)
        if len({n for n, _ in out}) != len(out):
            raise ValueError("a column name repeats")
        return Schema(out)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def types(self) -> list[Ty]:
        return [t for _, t in self.columns]

    def __len__(self) -> int:
        return len(self.columns)

    def check(self, row: Sequence) -> None:
        """Arity first, then types."""
        if len(row) != len(self.columns):
            raise TypeError(f"a row of {len(row)} values for {len(self.columns)} columns")
        for v, (name, ty) in zip(row, self.columns, strict=True):
            if ty is not Ty.ANY and type_of(v) is not ty:
                raise TypeError(f"column {name}: {v!r} is {type_of(v).value}, not {ty.value}")

    def extends(self, older: Schema) -> bool:
        """Additive evolution: the older columns are an exact prefix."""
        return self.columns[: len(older.columns)] == older.columns

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", ty.spark, False, {"ty": ty.value}) for i, (_, ty) in enumerate(self.columns)])


class SchemaCatalog:
    """Versions of each relation's schema by edition."""

    def __init__(self) -> None:
        self.versions: dict[str, list[tuple[int, Schema]]] = {}

    def put(self, rel: str, edition: int, schema: Schema) -> None:
        old = self.versions.setdefault(rel, [])
        if old:
            if old[-1][1] == schema:
                return
            if edition <= old[-1][0]:
                raise ValueError(f"{rel}: a new schema needs a later edition than {old[-1][0]}")
            if not schema.extends(old[-1][1]):
                raise ValueError(f"{rel}: only columns at the end may be added")
        old.append((edition, schema))

    def at(self, rel: str, edition: int) -> Schema | None:
        return next((s for e, s in reversed(self.versions.get(rel, [])) if e <= edition), None)

    def latest(self, rel: str) -> Schema | None:
        return self.versions[rel][-1][1] if self.versions.get(rel) else None


def sort_rows(rows: Iterable[Sequence]) -> list:
    return sorted(rows, key=row_key)
