"""Operator 1: line-first quality rules, in DataFrame functions only.

Each line is judged alone (punctuation, navigation, boilerplate, symbols); failing lines go; a document that loses too large a
share of its words goes too. Base counts of the whole text stand beside the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import SPACE, SPACE_CHARS

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: How a sentence ends: a mark, then closing quotes and brackets, then white space.
SENTENCE_END = r'[.!?…:;]["”’»)\]]*[\x20\x09-\x0D]*\z'


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the document rule."""

    #: A line of at least so many words must end as a sentence does, quotes and brackets apart (punctuation rule).
    unpunctuated_words: int = 12
    #: A line fails if it has more exclamation and question marks than this share of its words, when it has four words or more.
    shouting_share: float = 0.5
    #: A line fails if its separators | > » · • reach this share of its words, two at least (navigation rule).
    separator_share: float = 0.3
    #: A line fails if its symbols #*$%&|<> are more than this many for each word.
    symbols_per_word: float = 0.5
    #: Phrases that mark boilerplate, in lower case; a line of at most boilerplate_words words with one of them fails.
    boilerplate: tuple[str, ...] = (
        "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "click here", "sign in to", "subscribe to our",
        "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "newsletter abonnieren",
        "politique de confidentialité", "conditions d’utilisation", "tous droits réservés", "cliquez ici", "abonnez-vous à",
        "política de privacidad", "política de cookies", "términos de uso", "todos los derechos reservados", "haga clic aquí", "suscríbase a",
    )
    boilerplate_words: int = 30
    #: A document goes if it keeps less than this share of its words.
    least_kept_share: float = 0.5
    least_words: int = 10
    most_repeated_percent: int = 20


def _count(text: Column, pattern: str) -> Column:
    """Characters of text in the class that pattern is the complement of."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def with_words(df: DataFrame, text: str, words: str) -> DataFrame:
    """Adds the array of words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    t = F.btrim(F.col(text), F.lit(SPACE_CHARS))
    return df.withColumn(words, F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")))


def _counted(line: Column) -> Column:
    """A struct of a line and the number of its words."""
    trimmed = F.btrim(line, F.lit(SPACE_CHARS))
    n = F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")
    return F.struct(line.alias("line"), n.alias("n"))


def _stays(x: Column, r: Rules) -> Column:
    """Whether a line passes all rules; a line without a word does."""
    line, n = x["line"], x["n"]
    shouts = _count(line, "[^!?]+")
    bars = _count(line, "[^|>»·•]+")
    symbols = _count(line, "[^#*$%&|<>]+")
    phrase = F.lower(line).rlike("|".join(r.boilerplate)) if r.boilerplate else F.lit(False)
    counted = ((n >= 4) & (shouts > n * r.shouting_share)) | ((bars >= 2) & (bars >= n * r.separator_share)) | (symbols > n * r.symbols_per_word)
    # most lines have none of these characters, and need no counts
    bad = (line.rlike("[!?|>»·•#*$%&<]") & counted) | ((n >= r.unpunctuated_words) & ~line.rlike(SENTENCE_END)) | ((n <= r.boilerplate_words) & phrase)
    return (n == 0) | ~bad


def quality(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with base counts and the verdict of the line rules.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), n_kept_words
    (long, words on lines that stay), clean_text (lines that stay, joined by line feeds). Null is an empty text: no words, so
    base_failed and not kept. Columns of docs with these names are replaced, others stay, whatever their names. Rows are judged alone:
    copies get equal verdicts.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "clean_text")
    names, at = docs.columns, docs.columns.index(text)
    # own columns have numbers in here, so that no name clashes
    df = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_t", F.coalesce(F.col(f"c{at}"), F.lit("")))
    df = with_words(df, "_t", "_w")
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    w5 = F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_w5", w5)
    # only texts with a window found twice go through the sort
    ordered = F.array_sort(F.transform("_w5", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_o", F.when(F.size(F.array_distinct("_w5")) < F.size("_w5"), ordered))
    twice = F.filter("_o", lambda x, i: (x["h"] == F.get(F.col("_o"), i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(F.col("_o"), i + 1)["h"]).eqNullSafe(True))
    df = df.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW - F.greatest(i, a["end"])).cast("long")).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("n_symbols", _count(F.col("_t"), "[^#*$%&|<>]+"))
    df = df.withColumn("_l", F.transform(F.split("_t", "\n"), _counted))
    df = df.withColumn("_lw", F.filter("_l", lambda x: x["n"] > 0))
    df = df.withColumn("n_dup_lines", (F.size("_lw") - F.size(F.array_distinct(F.transform("_lw", lambda x: x["line"])))).cast("long"))
    df = df.withColumn("_k", F.filter("_l", lambda x: _stays(x, rules)))
    df = df.withColumn("n_kept_words", F.aggregate("_k", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    df = df.withColumn("clean_text", F.array_join(F.transform("_k", lambda x: x["line"]), "\n"))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated_percent))
    # always true, and never pushed down: a filter by `kept` would else repeat all that stands above inside its condition
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn("kept", here & ~F.col("base_failed") & (F.col("n_kept_words") >= F.col("n_words") * rules.least_kept_share))
    own = [i for i, c in enumerate(names) if c not in new or i == at]
    return df.select(*[f"c{i}" for i in own], *new).toDF(*[names[i] for i in own], *new)


def _sql_stays(r: Rules) -> str:
    phrase = " or ".join(f"contains(lower(x.line), '{p}')" for p in r.boilerplate)
    chars = lambda c: f"length(regexp_replace(x.line, '{c}', '', 'g'))"
    return f"""(x.n = 0 or not (
        (x.n >= {r.unpunctuated_words} and not regexp_matches(x.line, '{SENTENCE_END}'))
        or (x.n >= 4 and {chars('[^!?]+')} > x.n * {r.shouting_share})
        or ({chars('[^|>»·•]+')} >= 2 and {chars('[^|>»·•]+')} >= x.n * {r.separator_share})
        or {chars('[^#*$%&|<>]+')} > x.n * {r.symbols_per_word}
        or (x.n <= {r.boilerplate_words} and ({phrase}))))"""


def quality_sql(r: Rules = Rules()) -> str:
    """DuckDB SQL for the query's rows."""
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
win as (
  select rid, i, hash_key, count(*) over (partition by rid, hash_key) as c
  from (select rid, i, array_to_string(ws[i:i+4], ' ') as hash_key
        from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5))),
cov as (
  select rid, sum(least(5, coalesce(nxt - i, 5))) as n
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from win where c > 1) group by rid),
lines as (
  select *, list_transform(string_split(t, chr(10)), lambda x: {{'line': x, 'n': len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))}}) as ls from w),
s as (
  select lines.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(list_filter(ls, lambda x: x.n > 0)) - len(list_distinct(list_transform(list_filter(ls, lambda x: x.n > 0), lambda x: x.line))) as n_dup_lines,
    coalesce(cov.n, 0) as n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(ls, lambda x: {_sql_stays(r)}), lambda x: x.n)), 0) as n_kept_words
  from lines left join cov using (rid)),
f as (select *, n_words < {r.least_words} or 100 * n_repeat_words > {r.most_repeated_percent} * n_words as base_failed from s)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, (not base_failed and n_kept_words >= n_words * {r.least_kept_share}) as kept, n_kept_words::bigint as n_kept_words
from f
"""
