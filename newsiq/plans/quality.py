"""Row checks: domain rules, structured analyses, run notes, metric bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.functions import text as tx

# Domain rules by table kind.
GOLD_RULES = {
    "relevance_grade_range": "relevance_grade BETWEEN 0 AND 3",
    "review_status_domain": "review_status IN ('pending', 'approved', 'rejected')",
    "hard_negative_zero_grade": "evidence_role IS DISTINCT FROM 'hard_negative' OR relevance_grade = 0",
}
# Article types of an analysis.
ARTICLE_TYPES = (
    "company_news", "product_launch", "technical_report", "research_paper",
    "policy_regulation", "funding_market", "career_community", "other",
)
NOTES_VERSION = "rag-eval-run-notes-v1"


def validate(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, violations): every rule is SQL text; NULL counts as passed, as in a CHECK.

    Violations carry the names of all broken rules.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in rules.items()]))
    out = df.withColumn("broken_rules", broken)
    return out.where(F.size("broken_rules") == 0).drop("broken_rules"), out.where(F.size("broken_rules") > 0)


_BLOCK = T.StructType(
    [
        T.StructField("facts", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("evidence", T.StringType())]))),
        T.StructField("why_it_matters", T.StringType()),
        T.StructField("deeper_interpretation", T.StringType()),
        T.StructField("limitations_or_uncertainties", T.ArrayType(T.StringType())),
    ]
)
ANALYSIS = T.StructType([T.StructField("article_type", T.StringType()), T.StructField("en", _BLOCK), T.StructField("zh", _BLOCK)])


def _cut(x: Column, cap: int) -> Column:
    return F.trim(F.substring(tx.squeeze(x), 1, cap))


def _sentences(x: Column) -> Column:
    return F.size(F.filter(F.split(tx.squeeze(x), "[.!?。！？]+"), lambda s: F.trim(s) != ""))


def validate_analysis(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with a cleaned ``analysis`` struct, rejects with the first ``error``).

    Facts 3 to 6 with text and evidence, at least 3 and 5 sentences in the two
    paragraphs, 2 to 5 limitations, in both languages; texts are cut to their
    caps and an unknown article type becomes ``other``.
    """
    parsed = df.withColumn("_a", F.from_json(json_col, ANALYSIS))
    is_object = F.col(json_col).rlike(r"^\s*\{")
    # bound once, so that a filter on the error does not parse the text per check
    out = parsed.withColumn("error", tx.let(F.col("_a"), lambda a: _first_error(a, is_object)))

    def block(b: Column) -> Column:
        return F.struct(
            F.transform(b["facts"], lambda f: F.struct(_cut(f["text"], 360).alias("text"), _cut(f["evidence"], 80).alias("evidence"))).alias("facts"),
            _cut(b["why_it_matters"], 1000).alias("why_it_matters"),
            _cut(b["deeper_interpretation"], 1600).alias("deeper_interpretation"),
            F.transform(b["limitations_or_uncertainties"], lambda x: _cut(x, 260)).alias("limitations_or_uncertainties"),
        )

    kind = F.when(F.col("_a.article_type").isin(*ARTICLE_TYPES), F.col("_a.article_type")).otherwise("other")
    good = out.where(F.col("error").isNull())
    good = good.withColumn("analysis", F.struct(kind.alias("article_type"), block(F.col("_a.en")).alias("en"), block(F.col("_a.zh")).alias("zh")))
    return good.drop("_a", "error"), out.where(F.col("error").isNotNull()).drop("_a")


def _first_error(a: Column, is_object: Column) -> Column:
    """Message of the first broken rule of a parsed analysis, else NULL."""
    checks = [(~is_object | a.isNull(), "analysis must be an object")]

    def text(x: Column, name: str) -> list:
        return [(x.isNull(), f"{name} must be a string"), (tx.squeeze(x) == "", f"{name} is empty")]

    def each(items: Column, check) -> Column:
        """First message among the elements, which are few."""
        found = F.array_compact(F.transform(items, check))
        return F.get(found, F.lit(0))

    def fact(prefix: str):
        def check(f: Column, i: Column) -> Column:
            at = F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]"))
            out = F.when(f.isNull(), F.concat(at, F.lit(" must be an object")))
            for part in ("text", "evidence"):
                out = out.when(f[part].isNull(), F.concat(at, F.lit(f".{part} must be a string")))
                out = out.when(tx.squeeze(f[part]) == "", F.concat(at, F.lit(f".{part} is empty")))
            return out

        return check

    def limitation(prefix: str):
        def check(x: Column, i: Column) -> Column:
            at = F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]"))
            return F.when(x.isNull(), F.concat(at, F.lit(" must be a string"))).when(
                tx.squeeze(x) == "", F.concat(at, F.lit(" is empty"))
            )

        return check

    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]
    rule = lambda c, m: parts.append(F.when(F.coalesce(c, F.lit(False)), F.lit(m)))
    for lang in ("en", "zh"):
        b = a[lang]
        size = lambda x: F.coalesce(F.size(x), F.lit(-1))
        rule(b.isNull(), f"{lang} block must be an object")
        rule(~size(b["facts"]).between(3, 6), f"{lang}.facts must contain 3-6 fact objects")
        parts.append(each(b["facts"], fact(f"{lang}.facts")))
        for part, least, cap in (("why_it_matters", 3, 1000), ("deeper_interpretation", 5, 1600)):
            for c, m in text(b[part], f"{lang}.{part}"):
                rule(c, m)
            rule(_sentences(_cut(b[part], cap)) < least, f"{lang}.{part} must contain at least {least} sentences")
        rule(~size(b["limitations_or_uncertainties"]).between(2, 5), f"{lang}.limitations_or_uncertainties must contain 2-5 strings")
        parts.append(each(b["limitations_or_uncertainties"], limitation(f"{lang}.limitations_or_uncertainties")))
    return F.coalesce(*parts)


_NOTES = T.StructType(
    [
        T.StructField("notes_schema_version", T.StringType()),
        T.StructField("valid_for_strategy_selection", T.StringType()),
        T.StructField("invalid_reason", T.StringType()),
        T.StructField("corpus_health_run_id", T.StringType()),
    ]
)


def parse_notes(runs: DataFrame, notes: str = "notes") -> DataFrame:
    """Add validity fields; notes that are not JSON of the known version are invalid."""
    out = runs.withColumn("_n", F.from_json(notes, _NOTES))
    known = F.coalesce(F.col("_n.notes_schema_version") == NOTES_VERSION, F.lit(False))
    return out.select(
        *runs.columns,
        (known & F.coalesce(F.col("_n.valid_for_strategy_selection") == "true", F.lit(False))).alias("valid_for_strategy_selection"),
        F.when(known, F.col("_n.invalid_reason")).otherwise("legacy_or_nonconforming_notes").alias("invalid_reason"),
        F.when(known, F.col("_n.corpus_health_run_id")).alias("corpus_health_run_id"),
    )


def metric_bounds(case_results: DataFrame, runs: DataFrame) -> DataFrame:
    """Strategies with a case metric above 1, which would be a fault of the metric."""
    joined = case_results.join(runs.select("run_id", "strategy"), "run_id")
    out = joined.groupBy("strategy").agg(F.max("recall_at_10").alias("max_recall_at_10"), F.max("ndcg_at_10").alias("max_ndcg_at_10"))
    return out.where((F.col("max_recall_at_10") > 1) | (F.col("max_ndcg_at_10") > 1))
