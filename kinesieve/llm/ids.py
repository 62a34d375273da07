"""Document ids on their way through pandas, which would turn whole numbers beside nulls into floats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, missing, text): ids as longs without nulls, and a flag where there was none."""
    number = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(number, F.lit(0)).cast("long").alias("doc_id"), number.isNull().alias("missing"), "text")


def identified(pdf: pd.DataFrame) -> list[int | None]:
    """The ids of rows of with_ids(), None where there was none."""
    return [None if gone else doc for doc, gone in zip(pdf["doc_id"].tolist(), pdf["missing"].tolist())]
