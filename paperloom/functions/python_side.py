"""The few small per-value helpers that the JVM has no function for (Arrow batches)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescape_entities(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda name: unicodedata.normalize("NFKD", name), na_action="ignore")
