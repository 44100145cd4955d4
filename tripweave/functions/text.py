"""Text columns: tokens, stop words, document text and search patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def document_text(name: Column, category: Column, description: Column, article: Column) -> Column:
    """Name, category and description on one line, a blank line, then the article."""
    return F.concat(
        name, F.lit(". Category: "), category, F.lit(". "),
        F.coalesce(description, F.lit("")), F.lit("\n\n"), article,
    )


def contains_pattern(term: Column) -> Column:
    """LIKE pattern for "contains". % and _ in the term stay wildcards; a backslash
    before any other character stands for nothing, as it does not escape anything."""
    return F.concat(F.lit("%"), F.regexp_replace(term, r"\\([^%_\\])", "$1"), F.lit("%"))


def grams(text: Column, longest: int = 3) -> Column:
    """The empty string and every distinct substring of 1..longest characters."""
    low = F.lower(text)

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: low.substr(i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    parts = [of_length(n) for n in range(1, longest + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *parts))


def probe_gram(term: Column, longest: int = 3) -> Column:
    """A gram that every text matching the "contains" pattern must have: the start of the
    longest run without wildcards, or the empty string when there is no such run."""
    runs = F.regexp_extract_all(F.lower(term), F.lit(r"[^%_\\]+"), F.lit(0))
    sized = F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    best = F.try_element_at(F.sort_array(sized, asc=False), F.lit(1))
    return F.coalesce(F.substring(best["run"], 1, longest), F.lit(""))
