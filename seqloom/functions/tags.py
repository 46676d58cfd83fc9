"""Types and numbers of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer_type(v: Column) -> Column:
    """The narrowest type letter that holds the integer; null beyond 32 bits. The bounds and letters are fixed values of the format."""
    out = F.when((v > 2**32 - 1) | (v < -(2**31)), F.lit(None).cast("string"))
    for bound, letter in ((2**31 - 1, "I"), (2**16 - 1, "i"), (2**15 - 1, "S"), (2**8 - 1, "s"), (2**7 - 1, "C")):
        out = out.when(v > bound, letter)
    return out.when(v >= -(2**7), "c").when(v >= -(2**15), "s").otherwise("i")


def value_type(type_and_value: Column) -> Column:
    """The type letter that a value type:value is stored with: integers as narrow as can be, others as given."""
    given, value = F.substring(type_and_value, 1, 1), F.regexp_extract(type_and_value, "^.:(.*)$", 1)
    return F.when(given == "i", integer_type(value.try_cast("bigint"))).otherwise(given)


def id_number(key: Column, letter: Column) -> Column:
    """Two letters of the key and the type letter as one integer."""
    return F.ascii(F.substring(key, 1, 1)) * 65536 + F.ascii(F.substring(key, 2, 1)) * 256 + F.ascii(letter)


def id_text(number: Column) -> Column:
    """The inverse of id_number, three letters."""
    return F.concat(F.chr(F.shiftright(number, 16) % 256), F.chr(F.shiftright(number, 8) % 256), F.chr(number % 256))
