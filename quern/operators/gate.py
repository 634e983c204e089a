"""Quality score and quality gate, for one mode or all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import frontmatter, text
from quern.functions.constants import MODE_FIELDS, MODE_PURPOSE, MODES


def score(fm: Column, body: Column) -> Column:
    """A fifth each for title, tags, sources, a hundred words, and a link."""
    met = [
        F.coalesce(fm["title"] != "", F.lit(False)),
        F.size(frontmatter.gate_list(fm["tags"])) > 0,
        F.size(frontmatter.gate_list(fm["sources"])) > 0,
        text.word_count(body) >= 100,
        body.rlike(text.LINK),
    ]
    return F.round(sum((m.cast("int") for m in met), F.lit(0)) * F.lit(0.2), 1)


def thresholds(mode: str = "developer") -> dict:
    return dict(zip(MODE_FIELDS, MODES.get(mode, MODES["developer"])))


def modes(spark: SparkSession) -> DataFrame:
    """The five presets, with what each is for."""
    rows = [(m, MODE_PURPOSE[m], *v) for m, v in MODES.items()]
    return spark.createDataFrame(rows, "mode string, purpose string, min_words int, min_words_reject int, min_frontmatter_fields int, required_frontmatter array<string>, min_quality_score double, reject_quality_score double")


def gate(arts: DataFrame, limits: dict | None = None) -> DataFrame:
    """``arts`` with score, words, accepted and messages: the one reason to reject, or all warnings.

    Checks go in order (words, required keys, score); a rejection drops the warnings before it. The score is
    rejected at the threshold itself, words only under it.
    """
    t = {**thresholds(), **(limits or {})}
    need = F.array(*[F.lit(x) for x in t["required_frontmatter"]]).cast("array<string>")
    out = arts.withColumn("score", score(F.col("fm"), F.col("body"))).withColumn("words", text.word_count(F.col("body")))
    missing, n = F.array_except(need, F.map_keys("fm")), F.size("fm")
    few, low = t["min_words_reject"], float(t["reject_quality_score"])
    s = F.col("score").cast("string")
    reject = (
        F.when(F.col("words") < few, F.concat(F.lit("word count "), F.col("words").cast("string"), F.lit(f" below reject threshold {few}")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required frontmatter: "), F.array_join(missing, ", ")))
        .when(F.col("score") <= low, F.concat(F.lit("quality score "), s, F.lit(f" at or below reject threshold {low}")))
    )
    warn = F.array_compact(
        F.array(
            F.when(F.col("words") < t["min_words"], F.concat(F.lit("word count "), F.col("words").cast("string"), F.lit(f" below minimum {t['min_words']}"))),
            F.when(n < t["min_frontmatter_fields"], F.concat(F.lit("only "), n.cast("string"), F.lit(f" frontmatter fields (minimum {t['min_frontmatter_fields']})"))),
            F.when(F.col("score") < float(t["min_quality_score"]), F.concat(F.lit("quality score "), s, F.lit(f" below minimum {float(t['min_quality_score'])}"))),
        )
    )
    out = out.withColumn("__reject", reject)
    return out.withColumn("accepted", F.col("__reject").isNull()).withColumn("messages", F.when(F.col("__reject").isNotNull(), F.array("__reject")).otherwise(warn)).drop("__reject")
