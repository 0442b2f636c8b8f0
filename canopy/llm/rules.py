"""Quality rules: a threshold table compiled into one Spark projection.

Each metric is a Spark expression on the text; ``THRESHOLDS`` gives the range
in which a clean document lies.  ``compile_rules`` turns the table into one
boolean expression, so a rule costs no pass and no user function.

Defined results: a null or empty text has no words and fails the base rules.
Every row is judged by itself, so repeated rows get equal verdicts.  Extra
columns are carried along by ``clean`` and ignored by ``assess``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import plain, plain_name, words

WINDOW = 8

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by", "at", "from", "this", "are",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "dans", "est", "que", "qui", "pour", "par", "sur", "pas", "au", "avec",
    "der", "die", "und", "das", "den", "von", "zu", "ist", "mit", "im", "nicht", "ein", "eine", "sich", "dem", "des", "für", "als", "auf",
    "el", "los", "las", "y", "se", "del", "con", "no", "su", "al", "lo", "como", "más", "o",
)

#: (metric, least, most); None leaves a side open.  Ratios are to words or to lines with a word.
THRESHOLDS = (
    ("word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("shout_ratio", None, 0.25),
    ("stop_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
)

_P = "__rules_"


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the metrics in columns whose names start with ``__rules_``.

    The windows of eight words are compared by 64-bit hashes within a document.
    Only a document in which a hash recurs pays for locating the windows.
    """
    c = lambda name: F.col(_P + name)
    out = df.withColumn(_P + "text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        _P + "words": words(c("text")),
        _P + "lines": F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        _P + "n_symbols": F.length(F.regexp_replace(c("text"), r"[^#*$%&|<>]+", "")).cast("long"),
        _P + "n_shouts": F.length(F.regexp_replace(c("text"), r"[^!?]+", "")).cast("long"),
    })
    out = out.withColumns({
        _P + "n_words": F.size(c("words")).cast("long"),
        _P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
        _P + "n_stops": F.size(F.filter(c("words"), lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        _P + "n_lines": F.size(c("lines")).cast("long"),
        _P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        _P + "n_bullets": F.size(F.filter(c("lines"), lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        _P + "hashes": F.transform(c("words"), lambda w: F.xxhash64(w)),
    }).drop(_P + "words", _P + "lines", _P + "text")
    out = out.withColumn(
        _P + "windows",
        F.when(c("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(c("hashes")) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(c("hashes"), i, F.lit(WINDOW))))),
    )
    out = out.withColumn(_P + "recurs", F.coalesce(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), F.lit(False)))
    out = out.withColumn(_P + "sorted", F.when(c("recurs"), F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    out = out.withColumn(
        _P + "at",
        F.sort_array(F.transform(F.filter(c("sorted"), lambda x, k: same(x, F.get(c("sorted"), k - 1)) | same(x, F.get(c("sorted"), k + 1))), lambda x: x["i"])),
    )
    covered = F.aggregate(F.transform(c("at"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c("at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumn(_P + "n_repeat_words", F.when(c("recurs"), covered).otherwise(0).cast("long"))
    return out.drop(*[_P + x for x in ("hashes", "windows", "sorted", "at", "recurs")])


def metric(name: str) -> Column:
    c = lambda x: F.col(_P + x)
    per = {
        "word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "shout_ratio": ("n_shouts", "n_words"), "stop_ratio": ("n_stops", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_line_ratio": ("n_bullets", "n_lines"),
    }
    top, below = per[name]
    return F.coalesce(c(top) / F.nullif(c(below), F.lit(0)), F.lit(0.0))


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean expression: true where every metric lies in its range."""
    tests = [metric(m) >= least for m, least, _ in thresholds if least is not None] + [metric(m) <= most for m, _, most in thresholds if most is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in recurring windows."""
    return (F.col(_P + "n_words") < 20) | (100 * F.col(_P + "n_repeat_words") > 30 * F.col(_P + "n_words"))


def assess(df: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: the counts, whether the base rules fail, and whether it is kept."""
    c = lambda x: F.col(_P + x).alias(x)
    m = measured(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return m.select(
        "doc_id", c("n_words"), c("word_chars"), c("n_symbols"), c("n_dup_lines"), c("n_repeat_words"),
        base_failed().alias("base_failed"), (~base_failed() & compile_rules(thresholds)).alias("kept"),
    )


def clean(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows whose text passes the base rules and the table, with all their columns.

    The filter also reads a column that isn't deterministic, which keeps the
    optimizer from pushing it below the metrics, where each would be made many times.
    """
    names, text, df = df.columns, plain_name(df, text), plain(df)
    judged = measured(df, text).withColumns({_P + "kept": ~base_failed() & compile_rules(thresholds), _P + "here": F.spark_partition_id()})
    return judged.where(F.col(_P + "kept") & (F.col(_P + "here") >= 0)).select(*df.columns).toDF(*names)


def oracle(thresholds=THRESHOLDS) -> str:
    """The same in DuckDB SQL."""
    per = {
        "word_length": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)", "shout_ratio": "n_shouts / nullif(n_words, 0)", "stop_ratio": "n_stops / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "bullet_line_ratio": "n_bullets / nullif(n_lines, 0)",
    }
    tests = [f"coalesce({per[m]}, 0.0) >= {a}" for m, a, _ in thresholds if a is not None] + [f"coalesce({per[m]}, 0.0) <= {b}" for m, _, b in thresholds if b is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
wins AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM wins) WHERE n > 1),
cover AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_shouts,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stops, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullets, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cover ON cover.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""
