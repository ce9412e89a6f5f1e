import pytest
from pyspark.sql import types as T

from kolonna.schema import Field, derived_field, parse_fields


def compact(*specs):
    return [f.compact for f in parse_fields(specs)]


def test_compact_forms():
    assert compact("wide index uint32 x", "index string y", "int16 z", "lz4 a", "trie32 b", "binary c") == ["=@4x", "+$y", "#2z", "*a", "%4b", "&c"]
    assert compact("wide index x", "index int y", "uint z", "trie b", "c", "index bit d") == ["=x", "+#y", "@z", "%b", "c", "+!d"]


@pytest.mark.parametrize("spec", ["wide wide index x", "index wide x", "index blah16 x", "uint24 x", "int16 uint8 x", "trie8 x", "trie64 x", "string8 x", "index "])
def test_illegal_specs(spec):
    with pytest.raises(ValueError):
        Field.parse(spec)


def test_types_defaults_and_bounds():
    kinds = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint": T.LongType(), "uint64": T.DecimalType(20, 0), "int8": T.ByteType(), "int64": T.LongType(), "bit": T.ByteType(), "lz4": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "decimal(9,2)": T.DecimalType(9, 2)}
    for word, kind in kinds.items():
        assert Field.parse(f"{word} x").type == kind
    assert Field.parse("uint16 x").bounds == (0, 65535) and Field.parse("int x").bounds == (-(2**31), 2**31 - 1) and Field.parse("bit x").bounds == (0, 1)
    assert [Field.parse(s).default for s in ("int x", "bit x", "x", "lz4 x", "double x")] == [0, 0, "", "", None]


def test_partition_rules_and_names():
    assert parse_fields(["index string d", "x"], "d")[0].partition
    for specs, part in ((["string d"], "d"), (["index int d"], "d"), (["index string d"], "e")):
        with pytest.raises(ValueError):
            parse_fields(specs, part)
    with pytest.raises(ValueError):
        parse_fields(["x", "int x"])
    assert Field.parse("_Upper").name == "_Upper"


def test_descriptions_families_json():
    f = parse_fields(["wide index uint32 a", "index string d", "b", "bit c", "index trie16 e"], "d")
    assert [x.description for x in f] == ["wide index uint32 a", "index string *d", "trie32 b", "bit c", "index trie16 e"]
    assert f[1].family == f[2].family == f[4].family and f[0].family != Field.parse("int32 z").family
    for x in [*f, derived_field("q", T.ArrayType(T.LongType()))]:
        assert Field.from_json(x.to_json()) == x
