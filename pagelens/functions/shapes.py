"""Types from short texts, without a session (Spark's own parser needs one)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}


def shape(text: str) -> T.DataType:
    """struct<a:long,b:array<string>> and the like."""
    parts = re.findall(r"\w+|[<>:,]", text)

    def read(k: int) -> tuple[T.DataType, int]:
        name = parts[k]
        if name == "array":
            inner, k = read(k + 2)
            return T.ArrayType(inner), k + 1
        if name == "struct":
            fields, k = [], k + 1
            while parts[k] != ">":
                kind, end = read(k + 3)
                fields.append(T.StructField(parts[k + 1], kind))
                k = end
            return T.StructType(fields), k + 1
        return _PLAIN[name](), k + 1

    return read(0)[0]
