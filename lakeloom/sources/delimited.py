"""CSV, pipe-delimited and JSON-described tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL type names and what columns of them become; lengths in brackets are ignored.
TYPES = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(), "int2": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "int4": T.IntegerType(),
    "integer": T.IntegerType(), "int8": T.LongType(), "bigint": T.LongType(), "double": T.DoubleType(), "float8": T.DoubleType(), "real": T.DoubleType(), "float": T.DoubleType(),
    "float4": T.DoubleType(), "numeric": T.DoubleType(), "decimal": T.DoubleType(), "timestamp": T.TimestampNTZType(), "date": T.DateType(), "varchar": T.StringType(),
    "bpchar": T.StringType(), "char": T.StringType(), "text": T.StringType(), "varbinary": T.BinaryType(),
}


def column_type(name: str) -> T.DataType:
    key = name.lower().split("(")[0].strip()
    if key not in TYPES:
        raise ValueError(f"unknown column type: {name}")
    return TYPES[key]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", quote: str = '"', escape: str = '"', null: str = "", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=escape, nullValue=null, header=header, mode="FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\", header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=delimiter, quote=quote, escape=escape, header=header, emptyValue="").csv(path)


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited lines whose text values are filled with blanks."""
    df = spark.read.schema(schema).options(sep="|", quote="", mode="FAILFAST").csv(path)
    return df.select(*(F.rtrim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema))


def described_schemas(spark: SparkSession, path: str) -> dict[str, dict]:
    """Of a JSON description {table: {column_names_and_types, primary_key_col_idx, row_data_path}}: schema, key and path of each."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    out = {}
    for name, t in json.loads(text).items():
        schema = T.StructType([T.StructField(c, column_type(k)) for c, k in t["column_names_and_types"]])
        out[name] = {"schema": schema, "key": [schema.names[i] for i in t.get("primary_key_col_idx", [])], "path": t.get("row_data_path")}
    return out


def read_described(spark: SparkSession, path: str, name: str, folder: str = "") -> DataFrame:
    """A described table's rows; the data file's first line holds (name, type) pairs, so the description's schema holds."""
    t = described_schemas(spark, path)[name]
    return read_csv(spark, f"{folder}{t['path']}", t["schema"], header=True)
