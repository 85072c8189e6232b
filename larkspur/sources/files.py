"""COPY FROM and COPY TO as CSV, and Arrow output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "__malformed"


def copy_from(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = ",", header: bool = False, quote: str = '"', null: str = "") -> DataFrame:
    """Rows of a delimited file or folder, by position onto schema.  Fields equal to `null`, and \\N, are NULL; a field that doesn't fit is an error."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(StructType([*fields.fields, StructField(_BAD, StringType())])).option("columnNameOfCorruptRecord", _BAD).option("mode", "PERMISSIVE")
    reader = reader.option("sep", delimiter).option("header", header).option("quote", quote).option("escape", quote)
    rows = reader.option("nullValue", null).option("emptyValue", "").option("enforceSchema", True).csv(path)
    # The hash has the scan read a column of the file too, without which a count would read the bad lines only, and Spark refuses that.
    bad = F.col(_BAD).isNotNull() & (F.xxhash64(*fields.names) >= F.lit(-(1 << 63)))
    fails = F.raise_error(F.concat(F.lit("invalid input for COPY: "), F.col(_BAD))).cast("boolean")
    return rows.where(F.when(bad, fails).otherwise(True)).drop(_BAD)


def copy_to(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, single_file: bool = False, null: str = "") -> None:
    """df as delimited files; NULL is `null`, an empty string is \"\".  single_file puts all rows through one task."""
    out = df.coalesce(1) if single_file else df
    out.write.option("sep", delimiter).option("header", header).option("nullValue", null).option("emptyValue", '""').option("escape", '"').csv(path)


def to_arrow(df: DataFrame) -> pa.Table:
    """The rows at the driver as an Arrow table."""
    return df.toArrow()
