"""JSON schema text in one form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(text: str, sort: bool = False) -> str | None:
    """Compact text in the document's order, or with all keys sorted; of a repeated key the last value. Null for
    what is no JSON."""
    try:
        return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False, sort_keys=sort)
    except (ValueError, RecursionError):
        return None


def with_canonical(df: DataFrame, text: str) -> DataFrame:
    """Adds canonical and normalized; each distinct text is read once."""

    @F.pandas_udf("canonical string, normalized string")
    def forms(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(canonical(t), canonical(t, True)) for t in texts], columns=["canonical", "normalized"])

    one = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_r", forms(text))
    return df.join(one, text, "left").select(*df.columns, "_r.canonical", "_r.normalized")
