"""English word stems after the published Porter2 rules, as SQL expressions.

The rules are a chain of steps; each gives new columns from those of the steps before. They
are written in functions that every SQL engine has, so the twin of a query can run the same
rules in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The word lists and suffix tables of the published algorithm.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
          "ate", "iti", "ous", "ive", "ize", "ion")

WORD, STEM = "word", "stem"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '({pattern})', 0) <> ''"


def _suffix(word: str, suffixes) -> str:
    """The longest suffix a word has; the leftmost match of an anchored choice is the longest."""
    return f"regexp_extract({word}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 0)"


def _base(word: str, suffix: str) -> str:
    return f"left({word}, length({word}) - length({suffix}))"


def _short(text: str) -> str:
    """Whether a text ends in a short syllable."""
    return _has(text, "(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


def _region(text: str) -> str:
    """Length up to the first consonant behind a vowel, that included; all if there is none."""
    found = f"regexp_extract({text}, '^.*?[aeiouy][^aeiouy]', 0)"
    return f"CASE WHEN {found} = '' THEN length({text}) ELSE length({found}) END"


def steps() -> list[dict[str, str]]:
    """Columns of each step, from the column `word` to the column `stem`."""
    marked = f"CASE WHEN {WORD} LIKE 'y%' THEN concat('Y', substr({WORD}, 2)) ELSE {WORD} END"
    for vowel in "aeiouy":
        marked = f"replace({marked}, '{vowel}y', '{vowel}Y')"
    prefix = " ".join(f"WHEN m LIKE '{p}%' THEN {len(p)}" for p in LONG_PREFIXES)
    plural = ("CASE WHEN m LIKE '%sses' THEN left(m, length(m) - 2) "
              "WHEN m LIKE '%ied' OR m LIKE '%ies' THEN left(m, length(m) - CASE WHEN length(m) > 4 THEN 2 ELSE 1 END) "
              f"WHEN m LIKE '%s' AND m NOT LIKE '%us' AND m NOT LIKE '%ss' AND {_has('left(m, length(m) - 2)', '[aeiouy]')} "
              "THEN left(m, length(m) - 1) ELSE m END")
    past = (f"CASE WHEN s1 LIKE 'eed%' THEN CASE WHEN length(b1) >= r1 THEN concat(b1, 'ee') ELSE w1 END "
            f"WHEN s1 = '' OR NOT {_has('b1', '[aeiouy]')} THEN w1 "
            f"WHEN {_has('b1', '(at|bl|iz)$')} THEN concat(b1, 'e') "
            f"WHEN {_has('b1', '(' + '|'.join(DOUBLES) + ')$')} THEN left(b1, length(b1) - 1) "
            f"WHEN length(b1) <= r1 AND {_short('b1')} THEN concat(b1, 'e') ELSE b1 END")
    ending = f"CASE WHEN {_has('w2', '.[^aeiouy][yY]$')} THEN concat(left(w2, length(w2) - 1), 'i') ELSE w2 END"
    second = (f"CASE WHEN s3 = '' OR length(b3) < r1 OR (s3 = 'ogi' AND right(b3, 1) <> 'l') "
              f"OR (s3 = 'li' AND NOT {_has('b3', '[cdeghkmnrt]$')}) THEN w3 ELSE concat(b3, {_case('s3', SECOND, chr(39) * 2)}) END")
    third = (f"CASE WHEN s4 = '' OR length(b4) < CASE s4 WHEN 'ative' THEN r2 ELSE r1 END THEN w4 "
             f"ELSE concat(b4, {_case('s4', THIRD, chr(39) * 2)}) END")
    fourth = f"CASE WHEN s5 = '' OR length(b5) < r2 OR (s5 = 'ion' AND NOT {_has('b5', '[st]$')}) THEN w5 ELSE b5 END"
    last = (f"CASE WHEN w6 LIKE '%e' AND (length(b6) >= r2 OR (length(b6) >= r1 AND NOT {_short('b6')})) THEN b6 "
            "WHEN w6 LIKE '%ll' AND length(b6) >= r2 THEN b6 ELSE w6 END")
    return [
        {"m": marked},
        {"r1": f"CASE {prefix} ELSE {_region('m')} END", "w1": plural},
        {"r2": f"r1 + {_region('substr(m, r1 + 1)')}", "s1": _suffix("w1", ("eed", "eedly", "ed", "edly", "ing", "ingly"))},
        {"b1": _base("w1", "s1")}, {"w2": past}, {"w3": ending},
        {"s3": _suffix("w3", SECOND)}, {"b3": _base("w3", "s3")}, {"w4": second},
        {"s4": _suffix("w4", THIRD)}, {"b4": _base("w4", "s4")}, {"w5": third},
        {"s5": _suffix("w5", FOURTH)}, {"b5": _base("w5", "s5")}, {"w6": fourth},
        {"b6": "left(w6, length(w6) - 1)"}, {"w7": f"lower({last})"},
        {STEM: f"CASE WHEN length({WORD}) <= 2 OR {WORD} IN ({_quoted(sorted(UNCHANGED))}) THEN {WORD} "
               f"WHEN {WORD} IN ({_quoted(IRREGULAR)}) THEN {_case(WORD, IRREGULAR, WORD)} "
               f"WHEN w1 IN ({_quoted(sorted(UNCHANGED_AFTER_PLURAL))}) THEN w1 ELSE w7 END"},
    ]


def with_stem(rows: DataFrame, word: str, out: str) -> DataFrame:
    """Adds (or replaces) `out`, the stems of a column of lower-case words. For distinct words.

    Store the result before filters or joins on the stems: Spark would push a condition on
    them down through all steps and write them out in full.
    """
    kept = [F.col(c) for c in rows.columns if c != out]
    stepped = rows.select(F.struct(*rows.columns).alias("_row"), F.col(word).alias(WORD))
    for step in steps():
        stepped = stepped.withColumns({name: F.expr(text) for name, text in step.items()})
    return stepped.select("_row.*", F.col(STEM).alias("_stem")).select(*kept, F.col("_stem").alias(out))


def stems_sql(source: str) -> str:
    """CTEs that end in `stems` (word, stem) for a subquery with a column `word`."""
    parts = [f"step0 AS (SELECT DISTINCT word FROM {source})"]
    for n, step in enumerate(steps(), 1):
        parts.append(f"step{n} AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in step.items())} FROM step{n - 1})")
    return ", ".join(parts) + f", stems AS (SELECT word, stem FROM step{len(parts) - 1})"


def probe(stem: Column, longest: int) -> Column:
    """The beginning that every word with the stem has: all but its last two letters, as the
    rules change no more than that, and at least the first one."""
    return F.substring(stem, 1, F.least(F.greatest(F.length(stem) - 2, F.lit(1)), F.lit(longest)))
