"""Intent of questions by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell an intent, in order of preference, and the chart that answers it.
INTENTS = (("Trend", "line", ("trend", "tend")), ("Outliers", "bar", ("outlier", "anom")), ("Breakdown", "bar", ("break", "quebra")))


def _choose(text: Column, which: int) -> Column:
    out = F.lit(("Compare", "bar")[which])
    for intent, chart, words in reversed(INTENTS):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, (intent, chart)[which]).otherwise(out)
    return out


def classify_intent(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``intent`` and ``chart``; without a keyword, or without text, Compare and bar."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumns({"intent": _choose(text, 0), "chart": _choose(text, 1)})
