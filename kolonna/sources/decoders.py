"""Decoders: how a line becomes named values. Each is a function of one line, and knows its form over a DataFrame of lines."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "value"
#: A column of this name is true where a line could not be decoded.
BROKEN = "_broken"


class Decoder:
    """``decode(line)`` gives a dict; ``native`` the same over a whole DataFrame, as string columns."""

    def __call__(self, line: Any) -> dict:
        raise NotImplementedError

    def native(self, lines: DataFrame, names: list[str]) -> DataFrame:
        raise NotImplementedError


class JsonDecoder(Decoder):
    """One JSON object a line."""

    def __call__(self, line: str) -> dict:
        return json.loads(line)

    def native(self, lines: DataFrame, names: list[str]) -> DataFrame:
        corrupt = "_corrupt"
        shape = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(corrupt, T.StringType())])
        parsed = lines.select(F.from_json(F.col(LINE), shape, {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"}).alias("r"))
        broken = F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull()
        return parsed.select(*[F.col("r").getField(n).alias(n) for n in names], broken.alias(BROKEN))


class DelimitedDecoder(Decoder):
    """Values between delimiters, without quoting; white space at the end of the line is no part of it. A short line lacks its last values."""

    def __init__(self, names: Iterable[str], delimiter: str = ",") -> None:
        self.names, self.delimiter = list(names), delimiter
        if not delimiter:
            raise ValueError("the delimiter is not empty")

    def __call__(self, line: str) -> dict:
        return dict(zip(self.names, line.rstrip().split(self.delimiter)))

    def native(self, lines: DataFrame, names: list[str]) -> DataFrame:
        import re

        parts = F.split(F.regexp_replace(F.col(LINE), r"\s+$", ""), re.escape(self.delimiter))
        found = {n: F.get(F.col("p"), F.lit(i)) for i, n in enumerate(self.names)}
        return lines.select(parts.alias("p")).select(*[found.get(n, F.lit(None).cast("string")).alias(n) for n in names], F.lit(False).alias(BROKEN))


class FixedWidthDecoder(Decoder):
    """Values at fixed places: (first place, name) in order; each ends where the next begins. The name ``_`` is passed over."""

    def __init__(self, places: Iterable[tuple[int, str]]) -> None:
        self.places = list(places)
        if not self.places or any(a[0] >= b[0] for a, b in zip(self.places, self.places[1:])):
            raise ValueError("places count up")

    def _cuts(self) -> list[tuple[str, int, int | None]]:
        ends = [p for p, _ in self.places[1:]] + [None]
        return [(name, begin, end) for (begin, name), end in zip(self.places, ends) if name != "_"]

    def __call__(self, line: str) -> dict:
        return {name: line[begin:end].strip() for name, begin, end in self._cuts()}

    def native(self, lines: DataFrame, names: list[str]) -> DataFrame:
        def cut(begin: int, end: int | None) -> SparkColumn:
            return F.trim(F.substring(F.col(LINE), begin + 1, (1 << 30) if end is None else end - begin))

        found = {name: cut(begin, end) for name, begin, end in self._cuts()}
        return lines.select(*[found.get(n, F.lit(None).cast("string")).alias(n) for n in names], F.lit(False).alias(BROKEN))


class KeyValueDecoder(Decoder):
    """Records (key, value) of two sequences: the names apply to the elements of the key, then of the value."""

    def __init__(self, names: Iterable[str]) -> None:
        self.names = list(names)

    def __call__(self, line: tuple) -> dict:
        key, value = line
        return dict(zip(self.names, [*key, *value]))


json_decoder = JsonDecoder()
csv_decoder = DelimitedDecoder
fixed_width_decoder = FixedWidthDecoder
kv_decoder = KeyValueDecoder
