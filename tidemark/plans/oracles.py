"""SQL building blocks for the oracles: the same ordered replacements and formulas, for DuckDB."""

from __future__ import annotations

from ..functions import text as T


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def standard(x: str, steps: tuple[str, ...], digits: bool) -> str:
    out = f"trim(lower({x}))"
    for p in steps:
        pattern = p.replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    if digits:
        table = ", ".join(f"'{k}': '{v}'" for k, v in T.DIGITS.items())
        out = f"array_to_string(list_transform(regexp_extract_all({out}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: coalesce(map {{{table}}}[w], w)), '')"
    return f"trim(regexp_replace(regexp_replace(strip_accents({out}), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def levenshtein(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double end)"


def jaro(a: str, b: str) -> str:
    """Spelled out, because the built-in one floors half transpositions."""
    w = f"(greatest(length({a}), length({b})) // 2 - 1)"
    lo = f"greatest(1, x.i - {w})"
    at = f"position(substr({a}, x.i, 1) in substr(s.rest, {lo}, least(x.i + {w}, length({b})) - {lo} + 1))"
    step = (
        f"case when {at} > 0 then {{'i': x.i, 'rest': substr(s.rest, 1, {lo} + {at} - 2) || chr(1) || substr(s.rest, {lo} + {at}), 'took': s.took || substr({a}, x.i, 1)}} "
        f"else {{'i': x.i, 'rest': s.rest, 'took': s.took}} end"
    )
    start = f"[{{'i': 0, 'rest': {b}, 'took': ''}}]"
    rows = f"list_transform(range(1, length({a}) + 1), lambda i: {{'i': i::int, 'rest': '', 'took': ''}})"
    folded = f"list_reduce({start} || {rows}, lambda s, x: {step})"
    used = f"list_filter(range(1, length({b}) + 1), lambda j: substr(f.rest, j, 1) = chr(1))"
    moved = f"len(list_filter(range(1, length(f.took) + 1), lambda k: substr({b}, ({used})[k], 1) <> substr(f.took, k, 1)))"
    m = "length(f.took)"
    value = f"(select case when {m} = 0 then 0.0 else ({m} / length({a})::double + {m} / length({b})::double + ({m} - {moved} / 2.0::double) / {m}) / 3 end from (select {folded} as f))"
    return f"(case when {a} = {b} then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 when {w} < 0 then 0.0 else {value} end)"


def winkler(a: str, b: str, j: str) -> str:
    """From the Jaro similarity j."""
    n = "case " + " ".join(f"when substr({a}, 1, {k}) = substr({b}, 1, {k}) and least(length({a}), length({b})) >= {k} then {k}" for k in (4, 3, 2, 1)) + " else 0 end"
    return f"(case when {j} < 0.7 then {j} else {j} + 0.1 * ({n}) * (1 - {j}) end)"


def token_jaccard(a: str, b: str) -> str:
    tokens = "list_distinct(list_filter(string_split_regex(regexp_replace({0}, '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2))"
    x, y = tokens.format(a), tokens.format(b)
    return f"(CASE WHEN len(list_distinct({x} || {y})) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct({x} || {y}))::double END)"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _light(x: str) -> str:
    """A title without article, brackets and marks."""
    out = f"regexp_replace(regexp_replace(trim(lower({x})), '{T.TITLE_STEPS[0]}', ''), '\\s*\\([^)]*\\)', '', 'g')"
    out = f"regexp_replace({out}, '[:\\-–—]', ' ', 'g')"
    return _squeezed(f"regexp_replace({out}, '[^A-Za-z0-9_\\s'']', '', 'g')")


def _plain(x: str) -> str:
    return _squeezed(f"strip_accents(trim(lower({x})))")


def _mixed(a: str, b: str, j: str, edits: float, letters: float) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {edits} * {levenshtein(a, b)} + {letters} * {winkler(a, b, j)} END)"


def _compared(source: str, a: str, b: str, name: str, form, value: str, jaros: str) -> str:
    """CTEs ending in name (a, b, s): the similarity s of every distinct pair of columns a and b of source."""
    return (
        f"{name}_f AS (SELECT DISTINCT {a}, {b}, {form(a)} AS fa, {form(b)} AS fb FROM {source}), "
        f"{name}_r AS (SELECT *, array_to_string(list_reverse(string_split(fa, ' ')), ' ') AS ra, array_to_string(list_reverse(string_split(fb, ' ')), ' ') AS rb FROM {name}_f), "
        f"{name}_j AS (SELECT *, {jaros} FROM {name}_r), "
        f"{name} AS (SELECT {a}, {b}, CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {value} END AS s FROM {name}_j)"
    )


def title_scores(source: str, a: str, b: str, name: str) -> str:
    return _compared(source, a, b, name, _light, _mixed("fa", "fb", "j", 0.6, 0.4), f"{jaro('fa', 'fb')} AS j")


def series_scores(source: str, a: str, b: str, name: str) -> str:
    return _compared(source, a, b, name, _plain, _mixed("fa", "fb", "j", 0.5, 0.5), f"{jaro('fa', 'fb')} AS j")


def author_scores(source: str, a: str, b: str, name: str) -> str:
    turned = f"CASE WHEN len(string_split(fa, ' ')) >= 2 AND len(string_split(fb, ' ')) >= 2 THEN greatest({_mixed('ra', 'fb', 'j2', 0.3, 0.7)}, {_mixed('fa', 'rb', 'j3', 0.3, 0.7)}) ELSE 0.0 END"
    return _compared(source, a, b, name, _plain, f"greatest({_mixed('fa', 'fb', 'j', 0.3, 0.7)}, {turned})", f"{jaro('fa', 'fb')} AS j, {jaro('ra', 'fb')} AS j2, {jaro('fa', 'rb')} AS j3")


def percent(x: str) -> str:
    return f"least(100.0, greatest(0.0, {x}))"


def position(progress: str, total: str, fmt: str) -> str:
    least = f"case when {fmt} = 'audiobook' then 0.0 else 1.0 end"
    return f"(case when {progress} is not null and {total} > 0 then least({total}::double, greatest({least}, floor({progress} / 100 * {total} + 0.5))) else {least} end)"


FORMAT = "coalesce(case reading_format when 'Listened' then 'audiobook' when 'Ebook' then 'ebook' when 'Read' then 'book' when 'Both' then 'mixed' end, case when audio_seconds > 0 then 'audiobook' else 'book' end)"
POPULARITY = "(case when users_count > 0 then least(100.0, 20 + log10(users_count + 1) * 25) else 20.0 end)"
LENGTH = "(case when audio_seconds > 0 and pages > 0 then 100.0 when audio_seconds > 0 or pages > 0 then 60.0 else 20.0 end)"
DATA = "(case when score is null then 50.0 else least(100.0, greatest(0, score) / 2000 * 100) end)"
COMPLETE = "(case when asin is null and isbn_10 is null and isbn_13 is null and pages is null and audio_seconds is null and reading_format is null and physical_format is null and users_count is null then 30.0 else 40.0 end)"


def format_factor(e: str, s: str, physical: str = "physical|paperback|hardcover|text") -> str:
    return (
        f"(case when {e} is null then 20.0 when {s} is null then 60.0 when {s} = 'audiobook' and regexp_matches(lower({e}), 'audiobook|listened') then 100.0 "
        f"when {s} = 'ebook' and regexp_matches(lower({e}), 'ebook|digital') then 100.0 when {s} = 'audiobook' and regexp_matches(lower({e}), 'ebook|digital') then 62.5 "
        f"when {s} = 'ebook' and regexp_matches(lower({e}), 'audiobook|listened') then 62.5 when regexp_matches(lower({e}), '{physical}') then 37.5 else 12.5 end)"
    )


def duration_similarity(a: str, b: str) -> str:
    gap = f"((greatest({a}, {b}) / 3600.0::double - least({a}, {b}) / 3600.0::double) / (greatest({a}, {b}) / 3600.0::double) * 100)"
    return f"(case when {gap} <= 3 then 100.0 when {gap} <= 5 then 95.0 when {gap} <= 10 then 85.0 when {gap} <= 20 then 70.0 when {gap} <= 30 then 50.0 else 20.0 end)"


def duration_factor(source: str, fmt: str) -> str:
    return f"(case when {fmt} <> 'audiobook' then 60.0 when not coalesce({source} > 0, false) then 50.0 when not coalesce(audio_seconds > 0, false) then 30.0 else {duration_similarity(source, 'audio_seconds')} end)"


def clamp(x: str) -> str:
    return f"least(100.0, greatest(0.0, {x}))"
