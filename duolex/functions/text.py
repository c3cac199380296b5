"""Text expressions: every function takes and returns a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set that `str.strip`, `str.split` and `\s` share, and
# the word set behind `\w`. Java's own `\s` and `\w` are ASCII, so both are spelled out.
# The common characters come first in each set, because a match stops at the first hit.
SPACE = r" \s\p{Z}\x1c-\x1f\x85"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
# The same whitespace set, character by character.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Digits that are not decimal numbers but still count as digits (superscripts, subscripts).
DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"

TAG = r"<[^>]+>"
URL = rf"http[^{SPACE}]+|www[^{SPACE}]+"
PUNCT_RUN = r"([!?.])\1+"
# Every whitespace run except a lone plain space, which needs no rewrite.
SPACE_RUN = rf"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"

MAX_CHECKED_LENGTH = 1000
MAX_INPUT_LENGTH = 200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.trim(_col(c), F.lit(SPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(f"[^{SPACE}]")


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), TAG, "")


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), URL, "")


def collapse_punct(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), PUNCT_RUN, "$1")


def collapse_space(c: Column | str) -> Column:
    """Whitespace runs become one space, then the ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACE_RUN, " "))


def normalize_text(c: Column | str, repair: bool = True) -> Column:
    """Null to '', encoding repair, tags out, links out, punctuation and space runs collapsed."""
    from duolex.functions.repair import fix_text

    text = F.coalesce(_col(c), F.lit(""))
    if repair:
        text = fix_text(text)
    return collapse_space(collapse_punct(strip_urls(strip_tags(text))))


def word_array(c: Column | str) -> Column:
    """Lower-case, drop what is neither word nor space, split on whitespace, drop ''."""
    kept = F.regexp_replace(F.lower(_col(c)), f"[^{WORD}{SPACE}]+", "")
    return F.filter(F.split(kept, f"[{SPACE}]+"), lambda w: w != "")


def keep_array(c: Column | str) -> Column:
    """Alternating word and non-word runs in order; joined together they are the input."""
    return F.regexp_extract_all(_col(c), F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))


def is_word(c: Column | str) -> Column:
    """A token made of word characters only and not of digits only."""
    c = _col(c)
    return c.rlike(f"^[{WORD}]+$") & ~c.rlike(f"^[{DIGIT}]+$")


def sentence_case(c: Column | str) -> Column:
    """Strip, capitalise a lower-case first character, close an open end with a full stop.

    Only the characters at the ends are looked at, and the stripped text is worked out once.
    """

    def finish(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        raised = F.concat(F.upper(first), s.substr(F.lit(2), F.length(s)))
        end = F.when(F.substring(s, -1, 1).rlike(r"[\p{L}\p{N}]"), ".").otherwise("")
        return F.concat(F.when(first.rlike(r"^\p{IsLowercase}"), raised).otherwise(s), end)

    return F.transform(F.array(strip(c)), finish)[0]


def is_upper(ch: Column) -> Column:
    return (ch == F.upper(ch)) & (ch != F.lower(ch))


def transfer_casing(query: Column | str, term: Column | str) -> Column:
    """Give a lower-case term the casing of the query, position by position.

    Positions past the query's end take the casing of its last character, so an all-upper
    query gives an all-upper term and a capitalised one a capitalised term.
    """
    query, term = _col(query), _col(term)
    size = F.length(query)
    return F.when(query == F.lower(query), term).otherwise(
        F.concat_ws(
            "",
            F.transform(
                F.split(term, ""),
                lambda ch, i: F.when(
                    is_upper(query.substr(F.least(i + 1, size), F.lit(1))), F.upper(ch)
                ).otherwise(ch),
            ),
        )
    )


def capitalize(c: Column | str) -> Column:
    """First character upper, the rest lower."""
    c = _col(c)
    return F.concat(F.upper(c.substr(F.lit(1), F.lit(1))), F.lower(c.substr(F.lit(2), F.length(c))))


def lang_code(c: Column | str, codes: dict[str, str]) -> Column:
    """Mapped names become their code, others pass through; both lower-cased."""
    c = _col(c)
    if not codes:
        return F.lower(c)
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.lower(F.coalesce(mapping[c], c))


def format_ts(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def clip(c: Column | str, low, high) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def cap_length(c: Column | str, limit: int = MAX_INPUT_LENGTH) -> Column:
    return F.substring(_col(c), 1, limit)


def length_counter(c: Column | str, limit: int = MAX_INPUT_LENGTH) -> Column:
    """The `n/limit` display string; a missing text counts as empty."""
    return F.concat(F.coalesce(F.length(_col(c)), F.lit(0)).cast("string"), F.lit(f"/{limit}"))


def make_prompt(source_lang: Column | str, target_lang: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.lit("translate "), _col(source_lang), F.lit(" to "), _col(target_lang), F.lit(": "), _col(text)
    )


def make_direction(source_lang: Column | str, target_lang: Column | str) -> Column:
    return F.concat(_col(source_lang), F.lit("->"), _col(target_lang))


def parse_direction(c: Column | str) -> Column:
    """Struct of both languages, null unless the text has exactly two parts."""
    parts = F.split(_col(c), "->")
    pair = F.struct(
        strip(parts.getItem(0)).alias("source_lang"), strip(F.get(parts, F.lit(1))).alias("target_lang")
    )
    return F.when(F.size(parts) == 2, pair)
