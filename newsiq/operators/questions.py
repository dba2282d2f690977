"""Question-side expressions: search terms, rewrites, intents and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions.text import HAN, _c, let

# Rewrite modes and the drift threshold stored with a rewrite.
REWRITE_MODES = ("none", "entity_expansion", "hyde", "decomposition", "context_completion")
DRIFT_THRESHOLD = 0.82
# Sentences appended by two of the rewrite modes.
HYDE_SUFFIX = (
    "Hypothetical answer evidence should mention the concrete entities, dates, numbers, and event outcomes in the question."
)
CONTEXT_SUFFIX = (
    "Complete missing conversation context using only the current eval case and retrieved corpus evidence."
)

_W = "[A-Za-z0-9_]"
_BOUND = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def lexical_terms(question: Column | str, limit: int = 10) -> Column:
    """Search terms: spaced tokens of two or more characters, then Han windows of four."""
    text = F.regexp_replace(F.lower(F.coalesce(_c(question), F.lit(""))), r"[^\p{L}\p{N}\s]", " ")
    spaced = F.filter(F.split(text, r"\s+"), lambda t: (F.length(t) >= 2) & ~t.rlike(f"^[{HAN}]+$"))
    han = F.regexp_replace(text, f"[^{HAN}]", "")
    def four(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(v) - 1, F.lit(2))
        cut = F.transform(starts, lambda i: F.substring(v, i, F.lit(4)))
        return F.when(F.length(v) >= 2, cut).otherwise(F.array().cast("array<string>"))

    windows = F.filter(let(han, four), lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(F.concat(spaced, windows)), 1, limit)


def entity_terms(question: Column | str, lexicon: list[str] | None = None, limit: int = 12) -> Column:
    """Lexicon hits, capitalised runs, amounts and code-like words, in that order."""
    text = F.coalesce(_c(question), F.lit(""))
    cap = r"[A-Z][A-Za-z0-9$.-]*"
    runs = F.regexp_extract_all(text, F.lit(rf"{_BOUND}{cap}(?:\s+{cap}){{0,3}}{_BOUND}"), F.lit(0))
    money = F.regexp_extract_all(text, F.lit(r"(?iu)\$?\d+(?:\.\d+)?\s?(?:M|B|亿|万|万美元|亿美元)?"), F.lit(0))
    code = F.regexp_extract_all(
        text,
        F.lit(rf"{_BOUND}[a-z]+[A-Z][A-Za-z0-9_-]*{_BOUND}|{_BOUND}[a-z]+(?:search|ctl|cli){_BOUND}"),
        F.lit(0),
    )
    hits = F.array().cast("array<string>")
    if lexicon:
        low = F.lower(text)
        hits = F.filter(F.array(*[F.lit(t) for t in lexicon]), lambda t: F.contains(low, F.lower(t)))
    found = F.array_distinct(F.concat(hits, runs, money, code))
    return F.slice(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: F.length(t) >= 2), 1, limit)


def expanded_queries(question: Column | str, lexicon: list[str] | None = None) -> Column:
    """The question and, when not empty and different, its entities plus first six terms."""
    original = F.trim(F.coalesce(_c(question), F.lit("")))
    terms = F.concat(entity_terms(original, lexicon), F.slice(lexical_terms(original), 1, 6))
    return F.filter(F.array_distinct(F.array(original, F.array_join(terms, " "))), lambda q: q != "")


def rewritten(question: Column | str, mode: Column | str, lexicon: list[str] | None = None) -> Column:
    """Struct (rewrite_mode, rewritten_query, accepted, drift_threshold) of one rewrite."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    mode = F.when(mode.isin(*REWRITE_MODES), mode).otherwise("none")
    original = F.trim(F.coalesce(_c(question), F.lit("")))
    queries = expanded_queries(original, lexicon)
    second = F.get(queries, F.lit(1))
    text = (
        F.when(mode == "none", original)
        .when(
            mode == "entity_expansion",
            F.when(
                second.isNotNull(), F.concat(original, F.lit("\n\nKey entities and exact terms: "), second)
            ).otherwise(original),
        )
        .when(mode == "hyde", F.concat(original, F.lit(f"\n\n{HYDE_SUFFIX}")))
        .when(mode == "decomposition", F.array_join(queries, "\n"))
        .otherwise(F.concat(original, F.lit(f"\n\n{CONTEXT_SUFFIX}")))
    )
    accepted = mode.isin("none", "decomposition") | ((mode == "entity_expansion") & F.contains(text, original))
    return F.struct(
        mode.alias("rewrite_mode"),
        text.alias("rewritten_query"),
        accepted.alias("accepted"),
        F.lit(DRIFT_THRESHOLD).alias("drift_threshold"),
    )


def rewrite(df: DataFrame, mode: str, question: str = "question", lexicon: list[str] | None = None) -> DataFrame:
    """Add the rewrite and the query a replay would run (the original when rejected)."""
    out = df.withColumn("_r", rewritten(question, mode, lexicon))
    return out.select(
        "*",
        "_r.*",
        F.when(F.col("_r.accepted"), F.col("_r.rewritten_query")).otherwise(F.col(question)).alias("effective_query"),
    ).drop("_r")


# Patterns of intents, first match wins, and the names and question words that entities are told by.
INTENTS = (
    ("comparison", "compare|versus| vs |比较|对比"),
    ("ambiguous follow-up", "follow|previous|that|it|上述|刚才|这家公司|该公司"),
    ("low-context/conflicting evidence", "conflict|contradict|insufficient|低上下文|冲突"),
    ("multi-hop", "and|multi-hop|between|同时|以及|之间"),
)
NAMES = r"[A-Z][A-Za-z0-9$.-]+|\$[0-9]|OpenAI|Anthropic|Google|Microsoft|Okta|xAI"
ASKING = ("What", "When", "Why", "How", "Where", "Who")


def intent(question: Column | str, context: Column | str | None = None) -> Column:
    """Six intents by ordered rules over the lower-cased question and context."""
    q = F.coalesce(_c(question), F.lit(""))
    ctx = F.coalesce(_c(context), F.lit("")) if context is not None else F.lit("")
    text = F.lower(F.concat(q, F.lit(" "), ctx))
    named = F.array_except(F.regexp_extract_all(q, F.lit(NAMES), F.lit(0)), F.array(*[F.lit(w) for w in ASKING]))
    worded = [F.when(text.rlike(pattern), kind) for kind, pattern in INTENTS]
    return F.coalesce(*worded, F.when((F.size(named) >= 2) | q.rlike(r"\$[0-9]"), "entity-heavy"), F.lit("simple"))


def plan(df: DataFrame, question: str = "question", context: str | None = None) -> DataFrame:
    """One row per sub-query: plan_id, intent, subquery_id, query, purpose."""
    q = F.coalesce(F.col(question), F.lit(""))
    ctx = F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    base = F.trim(q)
    sub = lambda i, text, why: F.struct(
        F.lit(i).alias("subquery_id"), text.alias("query"), F.lit(why).alias("purpose")
    )
    out = df.withColumn("intent", intent(question, context))
    follow = F.regexp_replace(F.concat(ctx, F.lit("\n"), base), r"^\s+|\s+$", "")
    subs = (
        F.when(
            F.col("intent") == "comparison",
            F.array(
                sub("sq1", base, "retrieve first side of comparison"),
                sub("sq2", base, "retrieve second side of comparison"),
            ),
        )
        .when(
            F.col("intent") == "multi-hop",
            F.array(
                sub("sq1", base, "retrieve first hop evidence"), sub("sq2", base, "retrieve second hop evidence")
            ),
        )
        .when(F.col("intent") == "ambiguous follow-up", F.array(sub("sq1", follow, "complete follow-up context")))
        .otherwise(F.array(sub("sq1", base, "retrieve direct evidence")))
    )
    digest = F.sha2(F.concat_ws(":", F.col("intent"), q, ctx), 256)
    out = out.withColumn("plan_id", F.concat(F.lit("agentic-"), F.substring(digest, 1, 12)))
    return out.select("*", F.inline(subs))
