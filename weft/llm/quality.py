"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

All measures of a text are column expressions over its words and lines; the rules are rows of a
table (measure, least, most) and compile into one boolean expression. There's no shuffle: each row
is judged where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Frequent function words of the corpus' languages.
STOP_WORDS = (
    "the of and to in is that it for was on with as at by this be are from or an have not which "
    "de la le les et des en un une du que qui dans pour par sur est au aux pas avec ou "
    "der die das und den von zu mit ist im ein eine auf dem nicht des sich auch als für "
    "el los las del se por con una para su al lo como más o y"
).split()

#: (measure, least, most): a text is kept if every measure lies within. Ratios are of words or of lines with a word.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.3),
    ("repeat_word_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
)


def compile_rules(rules: tuple[tuple[str, float | None, float | None], ...]) -> Column:
    """One boolean column: every measure within its bounds."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (F.col(name) >= F.lit(least))
        if most is not None:
            out = out & (F.col(name) <= F.lit(most))
    return out


def _windows(words: Column, n_words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(n_words - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and the ratios of every whole text; null and blank texts have zeros."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("inner", F.trim("text", F.lit(BLANK)))
    rows = rows.withColumn("words", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", BLANKS)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    n_words = F.size("words")
    rows = rows.withColumn("hashes", _windows(F.col("words"), n_words))
    # where all windows differ, as in most texts, nothing repeats; else sorted (hash, place) pairs show which windows
    # have an equal neighbour, and each of them covers its words up to the next one's start
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs))
    same = F.filter("pairs", lambda p, i: (p.h == F.get("pairs", i - 1).h) | (p.h == F.get("pairs", i + 1).h))
    rows = rows.withColumn("places", F.sort_array(F.transform(same, lambda p: p.i)))
    cover = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s.n + F.least(F.lit(3), i - s.last)).alias("n"), i.alias("last")), lambda s: s.n)
    counts = rows.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x, F.lit(BLANK)).endswith("...") | F.rtrim(x, F.lit(BLANK)).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x, F.lit(BLANK)).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
    )
    per_word, per_line = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbol_ratio": F.col("n_symbols") / per_word,
            "stop_ratio": F.col("n_stop_words") / per_word,
            "dup_line_ratio": F.col("n_dup_lines") / per_line,
            "repeat_word_ratio": F.col("n_repeat_words") / per_word,
            "ellipsis_line_ratio": F.col("n_ellipsis_lines") / per_line,
            "bullet_line_ratio": F.col("n_bullet_lines") / per_line,
        }
    )


def judge(docs: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and the ratios, for every row.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed and
    within every rule. Words are runs without ASCII white space; null texts are empty (and fail). Repeated
    rows are judged each, null ids too; extra columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = measures(docs, id_col, text_col).withColumn("base_failed", failed)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & compile_rules(rules)).alias("kept"), *[name for name, _, _ in rules if name != "n_words"])
