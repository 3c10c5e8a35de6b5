"""Quality rules from counts and from distribution divergence, in built-in functions only.

Two histograms of a text, of character classes and of the common words of its
language, are held against those of the language: the mean over the documents
of that language that pass the counting rules, every document weighing alike.
The Jensen-Shannon distance to each (0: alike, 1: nothing in common) must stay
under its limit. Texts of fewer words than a guard are not judged by distance,
since a few words give no histogram.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import lasting

SPACE = r"\x20\x09-\x0D"
WINDOW = 5

#: Character classes, as regular expression classes, most common first. What is in none of them is the last class.
CLASSES = {
    "small": "[a-z]",
    "space": f"[{SPACE}]",
    "capital": "[A-Z]",
    "stop": r"[.,;:!?'\"()\-]",
    "digit": "[0-9]",
    "letter": r"\p{L}",
}
AROUND = rf"[{SPACE}.,;:!?'\"()\-]"
SYMBOLS = "#*$%&|<>"
STOPS = ".,;:!?'\"()-"

#: Very common words of each language.
COMMON = {
    "en": "the of and to in is that for it as was with on by an at be this are or",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "es": "de la que el en y a los del se las por un para con no una su al es",
}


@dataclass(frozen=True)
class Limits:
    """A text is kept if each distance is at most its limit, or the text has fewer words than the guard.

    Chance alone moves the word histogram of a short text, the more the fewer
    words it has, so its limit is ``words + words_slack / n_words``.
    """

    guard: int = 50
    classes: float = 0.30
    words: float = 0.26
    words_slack: float = 4.5
    #: Up to so many languages their references are sent to all tasks; beyond, they are joined by a shuffle.
    broadcast_languages: int = 2_000


def _length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def _counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """One narrow row for each row of ``docs``: the base counts and the two histograms."""
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    t = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(text_col, F.lit("")).alias("t"))
    t = t.withColumn("w", F.array_remove(F.split("t", f"[{SPACE}]+"), ""))
    n = F.size("w")
    at = lambda i, k: F.get(F.col("w"), i + k)
    runs = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    t = t.withColumn("g", F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<bigint>")))

    # Runs found twice, with their places: only texts that have such pay for the sort.
    t = t.withColumn(
        "s",
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    same = lambda x, k: F.coalesce(F.get(F.col("s"), k)["h"] == x["h"], F.lit(False))
    t = t.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    steps = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # Class after class is taken out of what is left, so that only the first pass reads the whole text.
    before, each = "t", []
    for name, chars in CLASSES.items():
        t = t.withColumn(f"r_{name}", F.regexp_replace(before, f"{chars}+", ""))
        each.append(_length(before) - _length(f"r_{name}"))
        before = f"r_{name}"
    # Words count in any case, and with stop characters around them.
    bare = F.transform("w", lambda x: F.btrim(F.lower(x), F.lit(STOPS)))
    among = lambda listed: F.filter(bare, lambda x: x.isin(listed.split()))
    hits = F.lit(None).cast("array<string>")
    for name, listed in COMMON.items():
        hits = F.when(F.col("lang") == name, among(listed)).otherwise(hits)
    t = t.select(
        "id",
        "lang",
        n.cast("long").alias("n_words"),
        _length(F.array_join("w", "")).alias("word_chars"),
        (_length(before) - _length(F.translate(before, SYMBOLS, ""))).alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.array(*each, _length(before)).alias("classes"),
        hits.alias("hits"),
    )
    # One expression for all languages: a tally written out for each word makes code too long to be compiled.
    listed = F.lit(None).cast("array<string>")
    for name, words in COMMON.items():
        listed = F.when(F.col("lang") == name, F.array(*map(F.lit, words.split()))).otherwise(listed)
    t = t.withColumn("listed", listed)
    words = F.transform("listed", lambda w: (F.size("hits") - F.size(F.array_remove("hits", w))).cast("long"))
    t = t.withColumn("words", words).drop("hits", "listed")
    # The last bin of the word histogram: all words that are not among the common ones.
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("words", F.concat("words", F.array(F.greatest(F.col("n_words") - total, F.lit(0).cast("long")))))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def divergence(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, square root) of two arrays of shares; null if either is."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def _references(rows: DataFrame) -> DataFrame:
    """(lang, class_ref, word_ref): the mean shares of each language's documents that pass the counting rules."""
    good = rows.where(~F.col("base_failed"))
    mean = lambda col, n: F.array(*[F.avg(F.get(F.col(col), F.lit(k))) for k in range(n)])
    return good.groupBy("lang").agg(
        mean("class_share", len(CLASSES) + 1).alias("class_ref"), mean("word_share", max(len(w.split()) for w in COMMON.values()) + 1).alias("word_ref")
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", limits: Limits = Limits()) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept).

    A row for every row of ``docs``, repeated and null ids included; other
    columns are ignored. A null text counts as empty and fails the base rules.
    Rows without a language, or of one without common words here, have a null
    word distance, which fails nothing.
    """
    rows = _counts(docs, id_col, text_col, lang_col)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = lasting(rows.withColumns({"class_share": _shares("classes"), "word_share": _shares("words")}).drop("classes", "words"))
    refs = lasting(_references(rows))
    if refs.count() <= limits.broadcast_languages:
        refs = F.broadcast(refs)
    refs = refs.withColumnRenamed("lang", "__lang")
    rows = rows.join(refs, rows["lang"].eqNullSafe(refs["__lang"]), "left")
    rows = rows.withColumns({"class_distance": divergence("class_share", "class_ref"), "word_distance": divergence("word_share", "word_ref")})
    near = lambda d, limit: F.coalesce(d, F.lit(0.0)) <= limit
    word_limit = F.lit(limits.words) + F.lit(limits.words_slack) / F.col("n_words")
    alike = (F.col("n_words") < limits.guard) | (near("class_distance", F.lit(limits.classes)) & near("word_distance", word_limit))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    return rows.select(F.col("id").alias(id_col), *counts, (~F.col("base_failed") & alike).alias("kept"))
