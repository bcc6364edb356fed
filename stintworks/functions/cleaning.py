"""Cell cleaners for text that came from CSV files and API documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as blank, beyond ASCII as well.
BLANKS = " \t\r\n\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# One number as the sources write it, thousands commas removed: sign in front, exponent.
_NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _number_text(text: Column, before: str = "") -> Column:
    """Plain number text, or NULL where ``text`` is not one number after ``before``.

    ``(5)`` and ``5-`` are negative, as in the source's number style.
    """
    signed = F.regexp_replace(text, r"^\((.*)\)$|^([^+-].*)-$", "-$1$2")
    return F.nullif(F.regexp_extract(signed, rf"^{before}{_NUMBER}\+?$", 1), F.lit(""))


def _blank_free(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def clean_int(c: Column, to: str = "int") -> Column:
    """Whole number; a fraction is cut toward zero; anything else is NULL.

    Plain digits, and those with a fraction, take the cheap way; text without any digit is no number. Patterns come before
    the casts because a failing ``try_cast`` costs an exception per cell.
    """
    plain = F.when(c.rlike(r"^\s*[+-]?\d{1,9}\s*$"), c.try_cast(to)).when(
        c.rlike(r"^\s*[+-]?\d{1,9}\.\d{0,9}\s*$"), c.try_cast("double").try_cast(to)
    )
    other = F.when(c.rlike(r"\d"), _number_text(F.translate(trimmed(c), ",", "")).try_cast("double").try_cast(to))
    return F.coalesce(plain, other)


def clean_decimal(c: Column, precision: int, scale: int) -> Column:
    """Number without percent signs and one leading plus, rounded half up to ``scale``."""
    kind = f"decimal({precision},{scale})"
    plain = F.when(c.rlike(r"^\s*[+-]?\d{1,18}(\.\d{1,18})?\s*$"), c.try_cast(kind))
    bare = F.translate(trimmed(c), "%,", "")
    return F.coalesce(plain, _number_text(bare, before=r"\+?").try_cast(kind))


def first_token(c: Column) -> Column:
    return F.coalesce(F.get(F.split(trimmed(c), r"\s+", 2), F.lit(0)), F.lit(""))


def rest_after_first_token(c: Column) -> Column:
    return F.coalesce(F.get(F.split(trimmed(c), r"\s+", 2), F.lit(1)), F.lit(""))


def text_or_null(c: Column) -> Column:
    return F.when(trimmed(c) != "", c)


def strict_number(c: Column, to: str) -> Column:
    """Number of an API document cell: blank is NULL, a fraction rounds half to even for a whole type.

    What is no number, or too large for the type, is NULL; ``bad_number`` tells it from a blank.
    """
    text = _blank_free(c)
    if to.startswith("decimal"):
        return _number_text(F.translate(text, ",", "")).try_cast(to)
    plain = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast(to))
    # Text that is not a plain number takes the longer way, through a decimal that holds it exactly.
    return F.coalesce(plain, F.bround(_number_text(F.translate(text, ",", "")).try_cast("decimal(38,10)"), 0).try_cast(to))


def bad_number(c: Column, to: str) -> Column:
    """Does the cell hold text but no number of the type?"""
    return F.coalesce(_blank_free(c).isNotNull() & strict_number(c, to).isNull(), F.lit(False))


def first_integer(c: Column, to: str = "int") -> Column:
    """First run of digits in a text, so that ``185 cm`` gives 185."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast(to)


def source_key(player: Column, born: Column, nation: Column) -> Column:
    """Hex SHA-256 of the three raw texts joined by a bar; NULL counts as empty text."""
    parts = [F.coalesce(p, F.lit("")) for p in (player, born, nation)]
    return F.sha2(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]), 256)


# Folding that lower-casing leaves out, from the character tables: letters that fold to several, and
# letters that lower-case does not map.
_FOLDS = {chr(i): chr(i).casefold() for i in range(0x80, 0x20000) if chr(i).lower().casefold() != chr(i).lower()}
_LONG_FOLDS = {c.lower(): f for c, f in _FOLDS.items() if len(f) > 1 and len(c.lower()) == 1}
_SHORT_FOLDS = {c.lower(): f for c, f in _FOLDS.items() if len(f) == 1 and len(c.lower()) == 1}


def folded(c: Column) -> Column:
    """Case-folded text for matching; accents stay significant.

    Lower case is all that ASCII text needs, and nearly all that other text does. Only text with one of the few
    characters beyond goes through the fold pairs, in one loop over an array of them.
    """
    low = F.lower(c)
    ascii_only = F.octet_length(c) == F.char_length(c)
    special = "[" + "".join([*_SHORT_FOLDS, *_LONG_FOLDS]) + "]"
    # One literal, a letter and what it folds to in each part.
    pairs = F.split(F.lit("|".join(letter + fold for letter, fold in _LONG_FOLDS.items())), r"\|")
    short = F.translate(low, "".join(_SHORT_FOLDS), "".join(_SHORT_FOLDS.values()))

    def unfold(text: Column) -> Column:
        present = F.filter(pairs, lambda pair: F.contains(text, F.left(pair, F.lit(1))))
        return F.reduce(present, text, lambda done, pair: F.replace(done, F.left(pair, F.lit(1)), F.substring(pair, 2, 9)))

    # The array of one binds the text, which is so worked out once and not for every pair.
    full = F.get(F.transform(F.array(short), unfold), F.lit(0))
    return F.when(ascii_only, low).when(low.rlike(special), full).otherwise(low)
