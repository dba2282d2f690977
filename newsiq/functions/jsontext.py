"""JSON found inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsiq.functions.text import _c, let

#: Cuts a text into escapes, quotes, braces and what lies between them; nothing is left out.
_TOKEN = r'(?s)\\.|["{}]|[^"{}\\]+|\\'


def first_json(x: Column | str) -> Column:
    """First balanced JSON object of a text; NULL when there is none.

    Braces inside strings and escaped signs do not count.  The tokens of the
    text from its first brace on are folded with the depth, whether a string
    is open, and the place; the object ends where the depth is 0 again.
    """
    state = lambda depth, quoted, at, end: F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), end.alias("end"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = s["at"] + F.length(token)
        closes = ~s["quoted"] & (token == "}") & (s["depth"] == 1)
        return state(depth, s["quoted"] != (token == '"'), at, F.when(s["end"] > 0, s["end"]).when(closes, at).otherwise(0))

    def found(text: Column) -> Column:
        start = state(F.lit(0), F.lit(False), F.lit(0), F.lit(0))
        end = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), 0), start, step)["end"]
        return let(end, lambda n: F.when(n > 0, F.substring(text, F.lit(1), n)))

    text = _c(x)
    return F.when(F.contains(text, F.lit("{")), let(F.substring(text, F.instr(text, F.lit("{")), F.length(text)), found))
