"""Text expressions. Every function returns a Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and word lists that results depend on.
NEWLINE_MARK = "<@x(x!>"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
GLUE_ENDINGS = [":", "?", "：", "？"]
AUTOGENERATED_WORDS = ["auto-generated", "autogenerated", "automatically generated"]
CONFIG_TEST_WORDS = ["unit tests", "test file", "configuration file"]
CODE_WORDS = ["def ", "class ", "for ", "while "]
QUESTION_WORDS = ["how", "why", "what", "where", "which", "do", "does", "is", "?", "eli5", "eli5:"]
ALIAS_MARKS = "[‘’´`.,\\-\"_]"
TRANSCRIPT_MARKS = r"[,?.!\-\;\:\"“%‘”�—’…–]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` removes only spaces)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def encode_newlines(col: str | Column) -> Column:
    return F.replace(_c(col), F.lit("\n"), F.lit(NEWLINE_MARK))


def decode_newlines(col: str | Column) -> Column:
    return F.replace(_c(col), F.lit(NEWLINE_MARK), F.lit("\n"))


def regex_tokens(col: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Default tokenizer: words, and runs of other visible characters."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


def n_tokens(col: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_count(_c(col), F.lit(pattern)).cast("long")


def flatten_whitespace(col: str | Column) -> Column:
    return strip(F.replace(decode_newlines(col), F.lit("\n"), F.lit(" ")))


def collapse_newlines(col: str | Column) -> Column:
    return strip(F.regexp_replace(_c(col), "\n+", "\n"))


def clean_prompt(context: str | Column, target: str | Column, joiner: str = " ") -> tuple[Column, Column]:
    """Whitespace rules of a prompt: both sides on one line, the target behind ``joiner``."""

    def one_line(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "\n+", "\n"), r"(?U)\s+", " ")

    return one_line(strip(context)), one_line(F.concat(F.lit(joiner), strip(target)))


def within_words(col: str | Column, limit: int = 256) -> Column:
    return F.size(F.split(_c(col), " ", -1)) <= limit


def prompt_fits(context: Column, target: Column, tokens: Column, chars: int = 5000, max_tokens: int = 256) -> Column:
    return (F.length(context) + F.length(target) <= chars) & (tokens <= max_tokens)


def content_hash(col: str | Column) -> Column:
    return F.md5(F.regexp_replace(_c(col), r"(?U)\s+", ""))


def lines_of(col: str | Column) -> Column:
    """Lines without the empty one after a final newline; an empty text has no lines."""
    body = F.regexp_replace(_c(col), r"\n\z", "")
    return F.when(_c(col) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_mean(col: str | Column) -> Column:
    lengths = F.transform(lines_of(col), lambda x: F.length(x))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(_c(col) == "", F.lit(0.0)).otherwise(total / F.size(lengths))


def line_max(col: str | Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines_of(col), lambda x: F.length(x))), F.lit(0)).cast("long")


def alnum_fraction(col: str | Column) -> Column:
    kept = F.length(F.regexp_replace(_c(col), r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(_c(col)) == 0, F.lit(0.0)).otherwise(kept / F.length(_c(col)))


def chars_per_token(col: str | Column, tokens: Column | None = None) -> Column:
    count = n_tokens(col) if tokens is None else F.size(tokens)
    return F.when(count > 0, F.length(_c(col)) / count).otherwise(F.lit(0.0))


def _any_word(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def _head(col: str | Column, scan: int) -> Column:
    """The first ``scan`` lines, lower-cased, as one string (words looked for hold no newline)."""
    return F.lower(F.substring_index(_c(col), "\n", scan))


def is_autogenerated(col: str | Column, scan: int = 5) -> Column:
    return _any_word(_head(col, scan), AUTOGENERATED_WORDS)


def is_config_or_test(col: str | Column, scan: int = 5, coeff: float = 0.05) -> Column:
    body = F.lower(_c(col))
    newlines = F.length(_c(col)) - F.length(F.replace(_c(col), F.lit("\n"), F.lit("")))
    limit = F.floor(F.lit(coeff) * newlines)
    many = (F.regexp_count(body, F.lit("config")) > limit) | (F.regexp_count(body, F.lit("test")) > limit)
    return _any_word(_head(col, scan), CONFIG_TEST_WORDS) | many


def has_no_code_words(col: str | Column) -> Column:
    return ~_any_word(F.lower(_c(col)), CODE_WORDS)


def has_few_assignments(col: str | Column, most: int = 4) -> Column:
    return F.length(_c(col)) - F.length(F.replace(_c(col), F.lit("="), F.lit(""))) <= most


def normalize_answer(col: str | Column, articles: bool = False) -> Column:
    """Lower case, no ASCII punctuation, single spaces; optionally without a / an / the."""
    out = F.regexp_replace(F.lower(_c(col)), r"[!-/:-@\[-`{-~]", "")
    if articles:
        out = F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def normalize_transcript(col: str | Column) -> Column:
    """Lower case, listed marks removed, and each blank run of the known kinds made one space."""
    out = F.regexp_replace(F.lower(_c(col)), TRANSCRIPT_MARKS, "")
    for run in ["\n\n", "\n", "   ", "  "]:
        out = F.array_join(F.split(out, run, -1), " ")
    return out


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(col: str | Column) -> Column:
    """Text to double by the separators it holds; null when the result is not a number.

    Commas separate thousands when a dot is present, when some comma-separated part has three
    characters, or when there are several; a lone comma otherwise is the decimal point. Several
    dots without such commas are thousands separators.
    """
    text = _c(col)
    has_comma, has_dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    commas, dots = F.regexp_count(text, F.lit(",")), F.regexp_count(text, F.lit(r"\."))
    thousands = F.exists(F.split(text, ",", -1), lambda p: F.length(p) == 3)
    without = F.replace(text, F.lit(","), F.lit(""))
    plain = (
        F.when(has_comma & (has_dot | thousands), without)
        .when(commas == 1, F.replace(text, F.lit(","), F.lit(".")))
        .when(dots > 1, F.replace(text, F.lit("."), F.lit("")))
        .when(commas > 1, without)
        .otherwise(text)
    )
    return F.when(plain.rlike(NUMBER), F.trim(plain)).cast("double")


def strip_query_words(col: str | Column, words: list[str] | None = None) -> Column:
    drop = F.array(*[F.lit(w) for w in (words or QUESTION_WORDS)])
    kept = F.filter(F.split(F.lower(_c(col)), r"\s+", -1), lambda w: ~F.array_contains(drop, w) & (w != ""))
    return F.array_join(kept, " ")


def strip_quotes(col: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), '^"', ""), '"$', "")


def match_tokens(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), F.lit(0))


def expand_aliases(answers: str | Column, sub_answers: bool = False) -> Column:
    """Lower-cased aliases with marks as spaces; optionally also without the first / last word."""
    given = _c(answers)
    if sub_answers:
        longer = F.filter(given, lambda a: F.contains(a, F.lit(" ")))

        def words_but_one(a: Column, start: int) -> Column:
            words = F.split(a, " ", -1)
            return F.array_join(F.slice(words, F.lit(start), F.size(words) - 1), " ")

        given = F.concat(
            given,
            F.transform(longer, lambda a: words_but_one(a, 2)),
            F.transform(longer, lambda a: words_but_one(a, 1)),
        )
    spaced = F.transform(given, lambda a: F.regexp_replace(F.lower(a), ALIAS_MARKS, " "))
    return F.array_distinct(F.transform(spaced, lambda a: strip(F.regexp_replace(a, r"(?U)\s+", " "))))
