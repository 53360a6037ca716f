"""Quality rules by distribution divergence, in SQL functions only.

A document's character classes and its common words are counted into two histograms. Each is compared
with the histograms of every reference language by the Jensen-Shannon distance (base 2, 0 to 1); the
nearest language counts. A histogram of too few characters or words says little and is not judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmtrace.llm.common import WHITE, WORD_BREAK, whole, without

# Shares of character classes in edited prose (white space, lower case, upper case, digits,
# symbols #*$%&|<>, the rest), and of the commonest words among all words, rounded.
CLASS_SHARES = {
    "en": [0.165, 0.785, 0.022, 0.004, 0.001, 0.023],
    "de": [0.150, 0.775, 0.045, 0.004, 0.001, 0.025],
    "fr": [0.165, 0.778, 0.022, 0.004, 0.001, 0.030],
    "es": [0.165, 0.782, 0.022, 0.004, 0.001, 0.026],
}
WORD_SHARES = {
    "en": {"the": 0.061, "of": 0.035, "and": 0.027, "to": 0.023, "a": 0.019, "in": 0.018, "is": 0.011, "that": 0.010, "it": 0.009, "for": 0.009, "was": 0.008, "on": 0.007},
    "de": {"der": 0.040, "die": 0.038, "und": 0.027, "in": 0.019, "den": 0.014, "von": 0.012, "zu": 0.012, "das": 0.011, "mit": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.007},
    "fr": {"de": 0.055, "la": 0.033, "le": 0.025, "et": 0.022, "les": 0.020, "des": 0.015, "en": 0.013, "un": 0.011, "du": 0.010, "une": 0.010, "que": 0.009, "est": 0.008},
    "es": {"de": 0.062, "la": 0.038, "que": 0.028, "el": 0.026, "en": 0.024, "y": 0.023, "los": 0.015, "se": 0.011, "del": 0.011, "un": 0.010, "las": 0.009, "por": 0.008},
}
SYMBOLS = "#*$%&|<>"

MIN_WORDS, MAX_REPEATED = 50, 50
#: Histograms of fewer characters or words are not judged.
LEAST_CHARS, LEAST_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.185, 0.30

_OWN = (
    "_words _windows _lines _pairs _places _n_words _word_chars _n_symbols _n_dup_lines _n_repeat_words _white _low _up "
    "_digit _known _classes _common _class_distance _word_distance _base_failed _kept _rest _words_0 _words_1 _words_2 _words_3"
).split()
#: Signs of the common words start here, one byte each.
_FIRST_SIGN = 48
_COMMON = sorted({w for shares in WORD_SHARES.values() for w in shares})


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the array; the first of them included.

    Windows are compared by 64-bit hashes. Only arrays that repeat a window at all are sorted.
    """
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))
    return windows


def _covered(places: Column) -> Column:
    """Positions covered by windows of three that start at sorted ``places``."""
    n = F.size(places)
    gaps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)


def _twins(sorted_pairs: Column) -> Column:
    """Positions of hashes that occur more than once, in ``h, i`` structs sorted by hash."""
    n = F.size(sorted_pairs)
    inner = F.filter(
        sorted_pairs,
        lambda x, k: ((k > 0) & (F.get(sorted_pairs, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(sorted_pairs, k + 1)["h"] == x["h"])),
    )
    return F.sort_array(F.transform(inner, lambda x: x["i"]))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words``, ``_rest`` and ``_known``.

    Words are runs without white space (U+0020, U+0009 to U+000D); a null text has none. ``_rest`` is the text without
    lower-case letters, ``_known`` the signs of its common words.
    """
    text = whole(text_col)
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Only a text without words gives an empty piece.
    words = F.array_remove(F.split(F.btrim(text, F.lit(WHITE)), WORD_BREAK), "")
    # Most characters are lower-case letters: all other classes are counted on what they leave.
    one = docs.select("*", words.alias("_words"), F.regexp_replace(text, r"\p{Ll}+", "").alias("_rest"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    # The words end here: no later step carries them on.
    two = one.select(
        *own, "_rest", F.size("_words").cast("long").alias("_n_words"), _signs(F.col("_words")).alias("_known"),
        repeated_words(F.col("_words")).alias("_windows"), lines.alias("_lines"),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    doubled = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines")
    three = two.select(*own, "_rest", "_n_words", "_known", doubled, F.when(repeats, pairs).alias("_pairs"))
    four = three.withColumn("_places", F.when(F.col("_pairs").isNotNull(), _twins(F.col("_pairs")))).drop("_pairs")
    return four.select(
        *own,
        "_rest",
        "_known",
        "_n_words",
        (F.length(text) - _count(F.col("_rest"), WORD_BREAK)).cast("long").alias("_word_chars"),
        _count(F.col("_rest"), f"[{SYMBOLS}]+").cast("long").alias("_n_symbols"),
        "_n_dup_lines",
        F.when(F.col("_places").isNotNull(), _covered(F.col("_places"))).otherwise(0).cast("long").alias("_n_repeat_words"),
    )


def _signs(words: Column) -> Column:
    """One sign for each word that is a common one, in one string; words go without marks at their ends and in lower case."""
    trimmed = lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))
    sign = F.create_map(*[x for i, w in enumerate(_COMMON) for x in (F.lit(w), F.lit(chr(_FIRST_SIGN + i)))])
    return F.array_join(F.transform(F.filter(words, lambda w: trimmed(w).isin(*_COMMON)), lambda w: F.element_at(sign, trimmed(w))), "")


def _information(shares: Column) -> Column:
    """The sum of p * log2(p) over an array of shares."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of shares and fixed ones; null for null shares.

    The square root of the entropy of the mean less the mean entropy: one logarithm a bin and language.
    """
    fixed = sum(q * math.log2(q) for q in reference if q > 0)
    middle = F.zip_with(shares, F.array(*[F.lit(q) for q in reference]), lambda p, q: (p + q) / 2)
    return F.sqrt(F.greatest((_information(shares) + F.lit(fixed)) / 2 - _information(middle), F.lit(0.0)))


def _full(shares: list[float]) -> list[float]:
    """Shares that add up to one: the first ones as given, and what they leave."""
    return [*shares, 1 - sum(shares)]


def histograms(base: DataFrame, text_col: str = "text") -> DataFrame:
    """``base`` (of ``base_statistics``) with ``_classes`` (six shares) and ``_common`` (counts of the common words).

    A text without characters has null shares.
    """
    length = F.length(whole(text_col))
    rest = F.col("_rest")
    white, low, up, digit = (length - F.col("_word_chars"), length - F.length(rest), _count(rest, r"\p{Lu}+"), _count(rest, "[0-9]+"))
    counted = base.select("*", *[c.cast("double").alias(n) for n, c in (("_white", white), ("_low", low), ("_up", up), ("_digit", digit))])
    symbols = F.col("_n_symbols").cast("double")
    classes = F.array("_white", "_low", "_up", "_digit", symbols, length - F.col("_white") - F.col("_low") - F.col("_up") - F.col("_digit") - symbols)
    shares = F.when(length > 0, F.transform(classes, lambda n: n / length))
    signs = [chr(_FIRST_SIGN + i) for i in range(len(_COMMON))]
    common = [(F.length("_known") - F.length(F.replace("_known", F.lit(c), F.lit("")))).cast("double") for c in signs]
    return counted.select(*[F.col(f"`{c}`") for c in base.columns], shares.alias("_classes"), F.array(*common).alias("_common"))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, ``_class_distance``, ``_word_distance``, ``_base_failed`` and ``_kept``.

    ``_base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    ``_kept`` is false then; else it is false if a judged histogram lies farther from every language than its
    limit. Null and empty texts fail the base rule. No row is dropped; repeated rows are judged each. Columns
    of ``docs`` that have the name of one of the operator's own are replaced.
    """
    docs = without(docs, *_OWN)
    seen = histograms(base_statistics(docs, text_col), text_col)
    spot = {w: i for i, w in enumerate(_COMMON)}
    languages = []
    for i, shares in enumerate(WORD_SHARES.values()):
        own = [F.get("_common", F.lit(spot[w])) / F.col("_n_words") for w in shares]
        rest = F.lit(1.0)
        for c in own:
            rest = rest - c
        languages.append(F.when(F.col("_n_words") >= LEAST_WORDS, F.array(*own, F.greatest(rest, F.lit(0.0)))).alias(f"_words_{i}"))
    # The arrays of shares are made before the distances, which read each of them several times.
    seen = seen.select("*", *languages)
    class_distance = F.least(*[distance(F.col("_classes"), shares) for shares in CLASS_SHARES.values()])
    word_distance = F.least(*[distance(F.col(f"_words_{i}"), _full(list(shares.values()))) for i, shares in enumerate(WORD_SHARES.values())])
    base_failed = (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEATED)
    told = seen.select(
        "*",
        F.when(F.length(whole(text_col)) >= LEAST_CHARS, class_distance).alias("_class_distance"),
        word_distance.alias("_word_distance"),
        base_failed.alias("_base_failed"),
    )
    near = (F.coalesce("_class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("_word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return told.withColumn("_kept", ~F.col("_base_failed") & near).drop("_rest", "_known", "_classes", "_common", *[f"_words_{i}" for i in range(len(WORD_SHARES))])
