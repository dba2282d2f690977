"""Answer cache over the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsiq.operators.windows import latest_per

KEY = ["user_id", "article_id", "question", "lang"]


def cache_hits(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Requests answered from the log: the newest row of the same question, if it has text.

    A newer empty row makes the question a miss even when older rows have text.
    """
    newest = latest_per(logs, KEY, [F.col("asked_at").desc(), F.col("qa_log_id").desc()])
    hit = newest.where(F.coalesce("response_text", F.lit("")) != "")
    return requests.join(hit.select(*KEY, "qa_log_id", "response_text", "feedback"), KEY)
