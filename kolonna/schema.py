"""Column specifications: words such as ``index uint32 ad_id``, their compact form, and their Spark types."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as T

#: Fixed values of the compact form: a mark for the kind of column, and one for the kind of index.
KIND_MARKS = {"int": "#", "uint": "@", "trie": "%", "string": "$", "lz4": "*", "binary": "&", "bit": "!"}
INDEX_MARKS = {"": "", "index": "+", "wide": "="}
#: Kinds without a counterpart there: passed through as they are.
EXTENSIONS = {"double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}

_SIZED = {"int": (8, 16, 32, 64), "uint": (8, 16, 32, 64), "trie": (16, 32)}
_SIGNED = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
# the next wider signed type holds all unsigned values
_UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
_DECIMAL = re.compile(r"decimal\((\d+),(\d+)\)$")


@dataclass(frozen=True)
class Field:
    """One column of a table. ``bits`` is 0 where the kind has one size or the default one."""

    name: str
    kind: str = "trie"
    bits: int = 0
    index: str = ""
    partition: bool = False
    explicit: bool = True  # the kind was written, not left out
    derived: bool = False  # of a nested result: the rules on predicates do not apply
    spark_type: T.DataType | None = None

    @classmethod
    def parse(cls, spec: str) -> Field:
        """From words: ``[[wide] index] [kind[bits]] name``."""
        *words, name = spec.split(" ")
        if not name:
            raise ValueError(f"no column name in {spec!r}")
        index, kind, bits = "", "", 0
        for word in words:
            if word == "wide":
                if index:
                    raise ValueError(f"'wide' after another index marker in {spec!r}")
                index = "wide"
            elif word == "index":
                index = index or "index"
            elif kind:
                raise ValueError(f"two kinds in {spec!r}")
            else:
                kind, bits = cls._kind(word, spec)
        return cls(name, kind or "trie", bits, index, explicit=bool(kind))

    @staticmethod
    def _kind(word: str, spec: str) -> tuple[str, int]:
        if word in EXTENSIONS or _DECIMAL.match(word):
            return word, 0
        found = re.fullmatch(r"(uint|int|trie|string|lz4|binary|bit)(\d*)", word)
        if not found:
            raise ValueError(f"unknown kind {word!r} in {spec!r}")
        kind, digits = found.groups()
        if digits and int(digits) not in _SIZED.get(kind, ()):
            raise ValueError(f"illegal size {digits} in {spec!r}")
        return kind, int(digits or 0)

    @property
    def compact(self) -> str:
        """The compact form, such as ``+@4ad_id``."""
        mark = KIND_MARKS.get(self.kind, f"<{self.kind}>") if self.explicit else ""
        return f"{INDEX_MARKS[self.index]}{mark}{self.bits // 8 or ''}{self.name}"

    @property
    def type(self) -> T.DataType:
        if self.spark_type is not None:
            return self.spark_type
        if self.kind == "int":
            return _SIGNED[self.bits or 32]
        if self.kind == "uint":
            return _UNSIGNED[self.bits or 32]
        if self.kind == "bit":
            return T.ByteType()
        if self.kind == "binary":
            return T.BinaryType()
        if found := _DECIMAL.match(self.kind):
            return T.DecimalType(int(found[1]), int(found[2]))
        return EXTENSIONS.get(self.kind, T.StringType())

    @property
    def default(self) -> object:
        """What stands for a missing value of a stored table; extensions have none."""
        if self.kind in ("int", "uint", "bit"):
            return 0
        if self.kind == "binary":
            return bytearray()
        return "" if self.kind in ("trie", "string", "lz4") else None

    @property
    def bounds(self) -> tuple[int, int] | None:
        """The least and the greatest value of an integer kind."""
        if self.kind == "bit":
            return 0, 1
        if self.kind == "int":
            return -(1 << ((self.bits or 32) - 1)), (1 << ((self.bits or 32) - 1)) - 1
        return (0, (1 << (self.bits or 32)) - 1) if self.kind == "uint" else None

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, (T.NumericType,))

    @property
    def family(self) -> str:
        """Join columns are of one family: all string kinds are, integers by sign and size."""
        if self.kind in ("trie", "string", "lz4"):
            return "string"
        if self.derived and isinstance(self.type, T.StringType):
            return "string"
        if self.kind == "int" and not self.derived:
            return _SIGNED[self.bits or 32].simpleString()
        return f"{self.kind}{self.bits or 32}" if self.kind == "uint" and not self.derived else self.type.simpleString()

    @property
    def description(self) -> str:
        """For people, such as ``index uint32 ad_id``; a star marks the partition column."""
        words = {"index": ["index"], "wide": ["wide index"]}.get(self.index, [])
        size = {"int": self.bits or 32, "uint": self.bits or 32, "trie": self.bits or 32}.get(self.kind, "")
        kind = self.type.simpleString() if self.derived else f"{self.kind}{size}"
        return " ".join([*words, kind, ("*" if self.partition else "") + self.name])

    def to_json(self) -> dict:
        return {"name": self.name, "kind": self.kind, "bits": self.bits, "index": self.index, "partition": self.partition, "explicit": self.explicit, "derived": self.derived, "type": self.type.json()}

    @classmethod
    def from_json(cls, held: dict) -> Field:
        import json

        kept = T._parse_datatype_json_value(json.loads(held["type"])) if held["derived"] else None
        return cls(held["name"], held["kind"], held["bits"], held["index"], held["partition"], held["explicit"], held["derived"], kept)


def parse_fields(specs: Iterable[str | Field], partition: str | None = None) -> list[Field]:
    """The fields of column specs; the partition column must be there, indexed and a plain string."""
    fields = [s if isinstance(s, Field) else Field.parse(s) for s in specs]
    names = [f.name for f in fields]
    if doubled := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns named twice: {', '.join(sorted(doubled))}")
    if partition is not None:
        if partition not in names:
            raise ValueError(f"no column {partition!r} to partition by")
        at = names.index(partition)
        if not fields[at].index or not isinstance(fields[at].type, T.StringType):
            raise ValueError(f"the partition column {partition!r} must be an indexed string")
        fields[at] = replace(fields[at], partition=True)
    return fields


def derived_field(name: str, kind: T.DataType) -> Field:
    """A column of a nested result: Spark's type, usable in every predicate."""
    known = {T.StringType: "string", T.BinaryType: "binary"}
    return Field(name, known.get(type(kind), "int" if isinstance(kind, T.IntegralType) else kind.simpleString()), 0, "index", derived=True, spark_type=kind)
