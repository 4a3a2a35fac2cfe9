"""Column functions over transcripts: tokens, phrases, questions, backchannel wording, type-token ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duologue.functions import lexicon


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: as a lambda's argument, not as an expression that lambdas inside would repeat."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Runs of a-z and apostrophes of the lower-cased text, apostrophes taken out, empties dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit("'"), F.lit(""))), lambda x: x != "")


def count_in(toks: Column, words: Iterable[str]) -> Column:
    vocabulary = F.array(*map(F.lit, sorted(words)))
    return F.size(F.filter(toks, lambda x: F.array_contains(vocabulary, x)))


def count_phrases(toks: Column, phrases: Iterable[str]) -> Column:
    """Places in the tokens where a phrase starts; overlapping ones all count."""
    by_length: dict[int, list[str]] = {}
    for p in sorted(set(phrases)):
        by_length.setdefault(len(p.split()), []).append(p)

    def starts(t: Column, n: int, group: list[str]) -> Column:
        listed = F.array(*map(F.lit, group))
        if n == 1:
            return F.size(F.filter(t, lambda x: F.array_contains(listed, x)))
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, lambda i: F.array_contains(listed, F.array_join(F.slice(t, i, n), " "))))

    return bound(toks, lambda t: sum((starts(t, n, group) for n, group in sorted(by_length.items())), F.lit(0)))


def question_type(text: Column) -> Column:
    """tag, wh, yes_no, declarative or null, in that order of precedence."""

    def judge(toks: Column) -> Column:
        first = F.try_element_at(toks, F.lit(1))
        return (
            F.when(text.rlike(lexicon.TAG_QUESTION), F.lit("tag"))
            .when(first.isin(*lexicon.WH_WORDS), F.lit("wh"))
            .when(first.isin(*lexicon.YES_NO_OPENERS), F.lit("yes_no"))
            .when((F.size(toks) > 0) & F.rtrim(text).endswith("?"), F.lit("declarative"))
        )

    return bound(tokens(text), judge)


def type_token_ratio(toks: Column, window: int = 100) -> Column:
    """Distinct over all below one window, else the mean over whole windows; null without tokens."""

    def ratio(t: Column) -> Column:
        n = F.size(t)
        starts = F.sequence(F.lit(0), F.floor(n / window).cast("int") - 1)
        ratios = F.transform(starts, lambda k: F.size(F.array_distinct(F.slice(t, k * window + 1, window))) / F.lit(float(window)))
        mean = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.floor(n / window)
        return F.when(n == 0, F.lit(None).cast("double")).when(n < window, F.size(F.array_distinct(t)) / n).otherwise(mean)

    return bound(toks, ratio)


def is_backchannel_text(text: Column, max_words: int = 4) -> Column:
    words = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]", "")), lambda x: x != "")
    known = F.array(*map(F.lit, lexicon.BACKCHANNELS))
    every = F.forall(words, lambda x: F.array_contains(known, x))
    return (F.size(words) > 0) & (F.size(words) <= max_words) & (F.array_contains(known, F.array_join(words, "")) | every)


def content_words(text: Column, least: int = 4) -> Column:
    """The tokens that are long enough and no stopwords, in order, repeats included."""
    # a set of constants, hashed once for a query
    return F.filter(tokens(text), lambda x: (F.length(x) >= least) & ~x.isin(*lexicon.stopwords()))


def content_terms(text: Column, least: int = 4) -> Column:
    """Distinct content words and bigrams of neighbours among them, in time proportional to the text."""

    def with_pairs(kept: Column) -> Column:
        after = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
        before = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.array_distinct(F.concat(kept, F.zip_with(before, after, lambda a, b: F.concat_ws(" ", a, b))))

    return bound(content_words(text, least), with_pairs)
