"""Standard forms and similarities of titles, authors, series and identifiers, as column expressions.

The patterns are kept as data, so that the SQL in `plans.oracles` applies the same replacements."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow

# Fixed values.
ARTICLES = "a|an|the|la|le|les|el|los|las|der|die|das|de|het|il|lo|gli|le"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
COUNT_TO_TEN = "one|two|three|four|five|six|seven|eight|nine|ten"

# Ordered replacements by the empty string, on trimmed lower-case text; $ is the end of the text.
TITLE_STEPS = (
    rf"^({ARTICLES})\s+",
    r"\s*[:\-–—]\s*a\s+novel\s*$",
    rf"\s*\(?\s*(unabridged|abridged|complete|full|extended|directors?\s*cut|special\s*edition|remastered|enhanced|dramatized?|multi-?voice|full\s*cast)\s*\)?$",
    rf"\s*\(?(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|1st|2nd|3rd|4th|5th|6th|7th|8th|9th|10th|\d+(?:st|nd|rd|th)?)\s*(edition|ed\.?|revised|rev\.?|updated|unabridged|abridged|complete|expanded)\)?.*$",
    r"\s*\([^)]*\)",
    rf"\s*\(?(volume|vol\.?|part|pt\.?|book|bk\.?)\s*(\d+|[ivx]+|{COUNT_TO_TEN})\b.*$",
)
AUTHOR_STEPS = (
    rf"\s*[-–—]\s*(translator|editor|narrator|contributor|adapted by|foreword by|introduction by|translated by|afterword by|preface by|illustrator|co-author|with|and|et al|illustrated by|compiled by|selected by|retold by)\b.*$",
    rf"\s+(jr\.?|sr\.?|iii?|iv|v|vi|vii|viii|ix|x|ph\.?d\.?|m\.?d\.?|esq\.?|b\.?a\.?|m\.?a\.?|m\.?s\.?|d\.?d\.?s\.?|r\.?n\.?|prof\.?|dr\.?)\s*$",
    r"^(by|written by|authored by|from|from the)\s+",
    r"\s*\(\s*\d{4}\s*[-–—]?\s*\d{0,4}\s*\)",
)
SERIES_STEPS = (
    rf"^({ARTICLES})\s+",
    rf"\s*(series|saga|cycle|trilogy|quartet|chronicles|collection|anthology)\s*$",
    rf"\s*(book|vol\.?|volume|part|pt\.?)\s*(\d+|[ivx]+|{COUNT_TO_TEN}).*$",
)
# Digits for a whole word.
DIGITS = {w: str(n) for words in (NUMBERS, ROMAN) for n, w in enumerate(words, 1)}

_SPACE = r"[\s   -     　﻿]"


def _accents() -> tuple[str, str]:
    """Characters whose decomposition starts with an ASCII letter, and these letters; then the marks,
    which go."""
    pairs = [(c, d[0]) for c in map(chr, range(0x80, 0x2E80)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _accents()


def java(pattern: str) -> str:
    """The pattern for Java: $ only at the very end, Unicode spaces, word ends between ASCII letters."""
    pattern = pattern.replace(r"\b", r"(?![A-Za-z0-9_])")
    pattern = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    return pattern.replace(r"\s", _SPACE)


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def words_to_digits(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.coalesce(F.element_at(table, w), w)), "")


def _standard(c: Column, steps: tuple[str, ...], digits: bool) -> Column:
    out = trim(F.lower(F.coalesce(c, F.lit(""))))
    for pattern in steps:
        out = F.regexp_replace(out, java(pattern), "")
    out = words_to_digits(out) if digits else out
    return squeeze(F.regexp_replace(strip_accents(out), rf"[^A-Za-z0-9_\s  - ]", ""))


def standard_title(c: Column) -> Column:
    """Lower case, without article, subtitle, production, edition and volume marks; numbers as digits."""
    return _standard(c, TITLE_STEPS, True)


def standard_author(c: Column) -> Column:
    return _standard(c, AUTHOR_STEPS, False)


def standard_series(c: Column) -> Column:
    return _standard(c, SERIES_STEPS, True)


def standard_text(c: Column) -> Column:
    return squeeze(strip_accents(trim(F.lower(F.coalesce(c, F.lit(""))))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_isbn(c: Column) -> Column:
    return _let(F.upper(F.regexp_replace(c.cast("string"), rf"[-]|{_SPACE}", "")), lambda out: F.when(F.char_length(out).isin(10, 13), out))


def _isbn_digits(c: Column) -> Column:
    """The digits as numbers; X is ten."""
    return F.transform(F.split(c, ""), lambda d: F.when(d == "X", 10).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))))


def _weighted(digits: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(digits, F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d * w, F.lit(0))), F.lit(0), lambda a, b: a + b)


def _to_10(c: Column, digits: Column) -> Column:
    last = (10 - _weighted(F.slice(digits, 1, 12), [1, 3] * 6) % 10) % 10
    check = (11 - _weighted(F.slice(digits, 4, 9), [*range(10, 1, -1)]) % 11) % 11
    ok = c.rlike(r"^978\d{10}$") & (last == F.get(digits, F.lit(12)))
    return F.when(ok, F.concat(F.substring(c, 4, 9), F.when(check == 10, "X").otherwise(check.cast("string"))))


def _to_13(c: Column, digits: Column) -> Column:
    # 38: what the digits 978 add to the sum.
    last = (10 - (38 + _weighted(F.slice(digits, 1, 9), [3, 1, 3, 1, 3, 1, 3, 1, 3])) % 10) % 10
    ok = c.rlike(r"^\d{9}[\dX]$") & (_weighted(F.slice(digits, 1, 10), [*range(10, 0, -1)]) % 11 == 0)
    return F.when(ok, F.concat(F.lit("978"), F.substring(c, 1, 9), last.cast("string")))


def isbn13_to_10(c: Column) -> Column:
    """For a 978 number with a right check digit, else null."""
    return _let(c, lambda x: _let(_isbn_digits(x), lambda d: _to_10(x, d)))


def isbn10_to_13(c: Column) -> Column:
    """For a number with a right check digit, else null."""
    return _let(c, lambda x: _let(_isbn_digits(x), lambda d: _to_13(x, d)))


def isbn_variants(c: Column) -> Column:
    """The cleaned number and its other form, without nulls or repeats."""

    def forms(clean: Column, digits: Column) -> Column:
        return F.array_distinct(F.array_compact(F.array(clean, F.when(F.char_length(clean) == 10, _to_13(clean, digits)).otherwise(_to_10(clean, digits)))))

    variants = _let(clean_isbn(c), lambda clean: _let(_isbn_digits(clean), lambda d: forms(clean, d)))
    return F.when(c.isNotNull(), variants).otherwise(F.array().cast("array<string>"))


def clean_asin(c: Column) -> Column:
    return _let(F.upper(F.regexp_replace(c, _SPACE, "")), lambda out: F.when((F.char_length(out) == 10) & out.rlike("^[A-Z]"), out))


def asins(c: Column) -> Column:
    """The cleaned ASIN in an array, which is empty if there is none."""
    return F.array_compact(F.array(clean_asin(c)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity with half transpositions counted as halves."""
    return arrow.jaro(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return arrow.jaro_winkler(F.lower(a), F.lower(b))


def tokens(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: F.char_length(t) > 2))


def token_jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(either == 0, 0.0).otherwise(both / either)


def _mixed(x: Column, y: Column, levenshtein: float, winkler: float) -> Column:
    """For trimmed lower-case texts."""

    def mix(s: Column) -> Column:
        either = (F.char_length(s["x"]) == 0) | (F.char_length(s["y"]) == 0)
        return F.when(s["x"] == s["y"], 1.0).when(either, 0.0).otherwise(levenshtein_similarity(s["x"], s["y"]) * levenshtein + s["j"] * winkler)

    return _let(F.struct(x.alias("x"), y.alias("y"), arrow.jaro_winkler(x, y).alias("j")), mix)


def blended(a: Column, b: Column, levenshtein: float = 0.4, winkler: float = 0.6) -> Column:
    return F.when((F.char_length(a) == 0) != (F.char_length(b) == 0), 0.0).otherwise(_mixed(F.lower(trim(a)), F.lower(trim(b)), levenshtein, winkler))


def _backwards(c: Column) -> Column:
    return F.array_join(F.reverse(F.split(c, " ")), " ")


def author_similarity(a: Column, b: Column) -> Column:
    return author_similarity_of(a, b, standard_text(a), standard_text(b))


def author_similarity_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """author_similarity of a and b, whose standard texts are x and y."""
    two = (F.size(F.split(x, " ")) >= 2) & (F.size(F.split(y, " ")) >= 2)
    turned = F.when(two, F.greatest(_mixed(_backwards(x), y, 0.3, 0.7), _mixed(x, _backwards(y), 0.3, 0.7))).otherwise(0.0)
    return _unless_missing(a, b, F.greatest(_mixed(x, y, 0.3, 0.7), turned))


def light_title(c: Column) -> Column:
    """The form in which titles are compared."""
    out = F.regexp_replace(trim(F.lower(c)), java(TITLE_STEPS[0]), "")
    out = F.regexp_replace(F.regexp_replace(out, java(r"\s*\([^)]*\)"), ""), "[:\\-–—]", " ")
    return squeeze(F.regexp_replace(out, r"[^A-Za-z0-9_\s']", ""))


def title_similarity(a: Column, b: Column) -> Column:
    return title_similarity_of(a, b, light_title(a), light_title(b))


def title_similarity_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """title_similarity of a and b, whose light titles are x and y."""
    return _unless_missing(a, b, _mixed(x, y, 0.6, 0.4))


def series_similarity(a: Column, b: Column) -> Column:
    return series_similarity_of(a, b, standard_text(a), standard_text(b))


def series_similarity_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """series_similarity of a and b, whose standard texts are x and y."""
    return _unless_missing(a, b, _mixed(x, y, 0.5, 0.5))


def general_similarity(a: Column, b: Column) -> Column:
    return _unless_missing(a, b, F.greatest(0.7 * blended(a, b) + 0.3 * token_jaccard(a, b), F.lit(0.0)))


def _unless_missing(a: Column, b: Column, value: Column) -> Column:
    """0 if a side is missing or empty, 1 if both are equal."""
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, 0.0).when(a == b, 1.0).otherwise(value)


def duration_similarity(a: Column, b: Column) -> Column:
    gap = (F.greatest(a, b) / 3600 - F.least(a, b) / 3600) / (F.greatest(a, b) / 3600) * 100
    bands = F.when(gap <= 3, 100.0).when(gap <= 5, 95.0).when(gap <= 10, 85.0).when(gap <= 20, 70.0).when(gap <= 30, 50.0).otherwise(20.0)
    return F.when(a.isNull() | b.isNull() | (a == 0) | (b == 0), 50.0).otherwise(bands)
