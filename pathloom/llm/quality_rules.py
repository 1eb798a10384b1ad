"""Quality rules with adaptive thresholds.

Statistics of each document go into a KLL quantile sketch for each language and source. Sketches
merge, so partial ones are built where the data lie and joined in the shuffle; those of sources
with under `min_group` documents are replaced by the merged sketches of their language. From a
sketch's quartiles q1 and q3 come the fences

    high = q3 + fence * (q3 - q1) + slack,    low = q1 - fence * (q3 - q1) - slack

each with the statistic's own slack, which keeps groups of equal values from rejecting small
differences. A second, shuffled or broadcast, join (Spark chooses by size) brings the fences to the
documents; one outside of any fence is rejected, with the rules it broke.

The sketch is exact up to `k` documents of a group and has a rank error of about 2 / k beyond.

Defined results: a null or empty text has no words and no statistics but n_words = 0: it breaks
the rule "empty". Null language or source is a group of its own. Null and repeated doc_ids are
judged row by row. A value on a fence is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common

#: statistic: (which fence counts, slack)
RULES = {
    "symbol_share": ("high", 0.05),
    "upper_share": ("high", 0.15),
    "bar_share": ("high", 0.10),
    "mark_share": ("high", 0.10),
    "distinct_share": ("low", 0.05),
    "word_length": ("both", 1.5),
}


@dataclass(frozen=True)
class RuleParams:
    k: int = 4096
    fence: float = 3.0
    min_group: int = 20


def statistics() -> dict[str, Column]:
    """By word or by character; null for texts without words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[ \n\t\r]+"), lambda w: F.length(w) > 0)
    n, chars = F.size("__pl_words"), F.length(F.regexp_replace(text, r"[ \n\t\r]+", ""))
    share = lambda classes, by: F.try_divide(F.regexp_count(text, F.lit(classes)), by)
    return {
        "__pl_words": words,
        "n_words": n,
        "symbol_share": share(r"[#$%&*@^~_=+<>{}\\]", chars),
        "upper_share": share("[A-Z]", chars),
        "bar_share": share(r"\|", n),
        "mark_share": share("!", n),
        "distinct_share": F.try_divide(F.size(F.array_distinct("__pl_words")), n),
        "word_length": F.try_divide(chars, n),
    }


def measured(docs: DataFrame) -> DataFrame:
    """The id, group and statistics of each document; texts are read once and left behind."""
    made = statistics()
    have = [c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", *have, made["__pl_words"].alias("__pl_words"), "text").select("doc_id", "lang", "source", *[made[c].alias(c) for c in ("n_words", *RULES)])


def thresholds(stats: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """lang, source and the fences of every statistic."""
    some = stats.filter("n_words > 0")
    sketches = some.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c, F.lit(p.k)).alias(c) for c in RULES])
    sketches = common.stored(sketches)  # one row a group: read for the groups and for the languages
    whole = sketches.groupBy("lang").agg(*[F.kll_merge_agg_double(c, F.lit(p.k)).alias(f"{c}_all") for c in RULES])
    both = sketches.alias("s").join(whole.alias("w"), F.col("s.lang").eqNullSafe(F.col("w.lang")))
    out = []
    for c, (side, slack) in RULES.items():
        sketch = F.when(F.col("n") < p.min_group, F.col(f"{c}_all")).otherwise(F.col(f"s.{c}"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        spread = p.fence * (q3 - q1) + slack
        if side != "high":
            out.append((q1 - spread).alias(f"{c}_low"))
        if side != "low":
            out.append((q3 + spread).alias(f"{c}_high"))
    return both.select(F.col("s.lang").alias("lang"), F.col("s.source").alias("source"), *out)


def judge(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """doc_id, lang, source, the statistics, broken (the rules, in order) and keep, for every document."""
    stats = common.stored(measured(docs))
    fences = thresholds(stats, p).withColumnsRenamed({"lang": "__pl_lang", "source": "__pl_source"})
    same = F.col("lang").eqNullSafe(F.col("__pl_lang")) & F.col("source").eqNullSafe(F.col("__pl_source"))
    tests = [F.when(F.col("n_words") == 0, "empty")]
    for c, (side, _) in RULES.items():
        over = F.col(c) > F.col(f"{c}_high") if side != "low" else F.lit(False)
        under = F.col(c) < F.col(f"{c}_low") if side != "high" else F.lit(False)
        tests.append(F.when(over | under, c))
    broken = F.array_join(F.array_compact(F.array(*tests)), " ")
    joined = stats.join(fences, same, "left").withColumn("broken", broken)
    return joined.select("doc_id", "lang", "source", "n_words", *[F.round(c, 6).alias(c) for c in RULES], "broken", (F.col("broken") == "").alias("keep"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


def oracle(p: RuleParams = RuleParams()) -> str:
    cut, tests = [], []
    for c, (side, slack) in RULES.items():
        q = lambda x, by: f"quantile_disc({c}, {x}) FILTER (WHERE n_words > 0) OVER (PARTITION BY {by})"  # noqa: B023, E731
        for x, name in ((0.25, "q1"), (0.75, "q3")):
            cut.append(f"CASE WHEN size < {p.min_group} THEN {q(x, 'lang')} ELSE {q(x, 'lang, source')} END AS {c}_{name}")
        spread = f"({p.fence} * ({c}_q3 - {c}_q1) + {slack})"
        over, under = f"{c} > {c}_q3 + {spread}", f"{c} < {c}_q1 - {spread}"
        tests.append(f"CASE WHEN {over if side == 'high' else under if side == 'low' else f'{over} OR {under}'} THEN '{c}' END")
    return rf"""
WITH words AS (
  SELECT *, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda w: length(w) > 0) AS w, length(regexp_replace(text, '[ \n\t\r]+', '', 'g')) AS chars FROM documents
), stats AS (
  SELECT doc_id, lang, source, CAST(len(w) AS INTEGER) AS n_words, len(regexp_extract_all(text, '[#$%&*@^~_=+<>{{}}\\]')) / nullif(chars, 0) AS symbol_share,
         len(regexp_extract_all(text, '[A-Z]')) / nullif(chars, 0) AS upper_share, len(regexp_extract_all(text, '\|')) / nullif(len(w), 0) AS bar_share,
         len(regexp_extract_all(text, '!')) / nullif(len(w), 0) AS mark_share, len(list_distinct(w)) / nullif(len(w), 0) AS distinct_share, chars / nullif(len(w), 0) AS word_length
  FROM words
), sized AS (SELECT *, count(*) FILTER (WHERE n_words > 0) OVER (PARTITION BY lang, source) AS size FROM stats
), cut AS (SELECT *, {", ".join(cut)} FROM sized
), judged AS (SELECT *, concat_ws(' ', CASE WHEN n_words = 0 THEN 'empty' END, {", ".join(tests)}) AS broken FROM cut)
SELECT doc_id, lang, source, n_words, {", ".join(f"round({c}, 6) AS {c}" for c in RULES)}, broken, broken = '' AS keep FROM judged
"""


ORACLE = oracle()
