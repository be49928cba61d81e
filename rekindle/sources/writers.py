"""CSV and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.functions.scalars import finite_or_null


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write the table as CSV with header and as JSON lines, each a folder of part files.

    JSON knows no NaN and no infinity: such numbers become null there. CSV keeps them as text.
    """
    files = {"csv": f"{path.rstrip('/')}.csv", "json": f"{path.rstrip('/')}.json"}
    df.write.mode(mode).csv(files["csv"], header=True, escape='"')
    names = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema}
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    rows = df.select(*[(finite_or_null(c) if n in numbers else c).alias(n) for n, c in names.items()])
    rows.write.mode(mode).json(files["json"])
    return files
