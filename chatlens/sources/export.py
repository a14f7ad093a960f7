"""Write report rows out (the reference serves them as JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame

_FORMATS = ("json", "parquet", "csv", "orc")


def export(df: DataFrame, path: str, fmt: str = "json",
           mode: str = "overwrite") -> None:
    """Write a report DataFrame with its own column names.

    Timestamps are written without zone (ISO text in JSON/CSV), arrays stay
    arrays in JSON/parquet/ORC; CSV cannot hold arrays, so they are joined
    with ", " the way the UI prints tool lists.
    """
    if fmt not in _FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}; use one of {_FORMATS}")
    if fmt == "csv":
        from pyspark.sql import functions as F
        from pyspark.sql.types import ArrayType
        df = df.select([
            F.array_join(F.col(f.name), ", ").alias(f.name)
            if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema.fields])
        df.write.mode(mode).option("header", True).csv(path)
        return
    df.write.mode(mode).format(fmt).save(path)
