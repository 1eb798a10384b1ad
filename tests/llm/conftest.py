import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river ran under the old stone bridge and children threw small sticks into the water to see which came out first"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, spread over partitions."""

    def build(rows, extra=False):
        data = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
        df = spark.createDataFrame(data, SCHEMA).repartition(3)
        if extra:  # names that operators use for their results
            from pyspark.sql import functions as F

            names = "keep quality_score lang_id code_bits margin lines_removed benchmark_items contaminated dropped words_removed pii similarity keeper_id window_id verdict broken licence shard n h sig k1".split()
            df = df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts."""
    long = " ".join(f"word{k % 5000} {PROSE}" for k in range(4000))
    return [
        (1, PROSE, "en", "a"),
        (1, PROSE, "en", "a"),
        (2, None, "en", "a"),
        (None, PROSE, "en", "b"),
        (None, None, None, None),
        (3, "", "en", "a"),
        (4, long, "en", "b"),
        (5, "word", None, "a"),
        (6, "two\n\nlines\n", "de", None),
        (7, "first text of seven, told at some length here", "de", "c"),
        (7, "second text of seven, of another kind altogether", "de", "c"),
        (8, "日本語の文章です。ここには空白がありません。", "ja", "c"),
        (9, " \n\t ", "en", "a"),
    ]
