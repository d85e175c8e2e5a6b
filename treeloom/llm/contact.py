"""What counts as a usable e-mail address, person's name or phone number, and its one canonical writing.

All expressions are built-in columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width forms U+FF01 to U+FF5E stand for ASCII 0x21 to 0x7E.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))

#: Words that fill a required field and stand for no one.
FILLER = (
    "unknown user test tester asdf qwerty xxx xx x na none null nil tbd noname nobody anonymous anon empty missing example dummy fake "
    "name first last firstname lastname customer client guest admin noemail nomail nomailaddress noaddress noreply refused later ask "
    "unlisted undefined unbekannt"
).split()

_RISING, _FALLING = "01234567890123456789", "98765432109876543210"

#: Digits of a national phone number; country and trunk prefixes stand before these.
NATIONAL_DIGITS = 9


#: A reading in steps: each makes a column of the one before, which it may use several times.
Steps = list[Callable[[Column], Column]]


def read(value: Column, steps: Steps) -> Column:
    """The steps as one column, each computed once."""
    if len(steps) == 1:
        return steps[0](value)
    return F.get(F.transform(F.array(steps[0](value)), lambda v: read(v, steps[1:])), F.lit(0))


def with_reading(df: DataFrame, name: str, value: Column, steps: Steps) -> DataFrame:
    """The steps as projections one above the other, which are compiled as a whole where ``read`` is interpreted.

    Catalyst keeps them apart, since each is used more than once by the next.
    """
    df = df.withColumn(name, steps[0](value))
    for step in steps[1:]:
        df = df.withColumn(name, step(F.col(name)))
    return df


def clean(value: Column) -> Column:
    """ASCII for full-width forms, no invisible characters, single spaces, trimmed."""
    narrow = F.translate(value, _WIDE, _NARROW)
    visible = F.regexp_replace(narrow, r"[\p{Cf}]", "")
    full = F.trim(F.regexp_replace(visible, r"[\s\p{Z}]+", " "))
    # most values are plain already and skip the work
    plain = (F.octet_length(value) == F.length(value)) & ~value.rlike(r"^ |[\x00-\x1f\x7f]|  | $")
    return F.when(plain, value).otherwise(full)


def _unwrap(text: Column) -> Column:
    return F.regexp_replace(text, r"""^[\s"'`<>()\[\]{},;:]+|[\s"'`<>()\[\]{},;:.]+$""", "")


def is_filler(words: Column) -> Column:
    return words.isin(*FILLER)


# possessive throughout, so that what does not match is seen in one pass
_ATOM = r"[a-z0-9_!#$%&'*+/=?^{|}~-]++"
_ADDRESS = rf"^{_ATOM}(?:\.{_ATOM})*+@(?:[a-z0-9][a-z0-9-]*+(?<!-)\.)++[a-z][a-z0-9-]++(?<!-)$"


def email_steps(drop_tag: bool = True) -> Steps:
    """The inbox an address reaches, lower case and without delivery tag, or null if the value is not exactly one complete address."""

    def strip(text: Column) -> Column:
        inner = F.when(text.contains("<"), F.coalesce(F.nullif(F.regexp_extract(text, r"<([^<>]*@[^<>]*)>", 1), F.lit("")), text)).otherwise(text)
        bare = _unwrap(F.regexp_replace(_unwrap(inner), r"^(mailto|e-?mail|mail)\s*:\s*", ""))
        one = text.contains("@") & (F.substring_index(text, "@", 2) == text)
        # nothing to strip where the text begins and ends as an address does
        return F.when(one, F.when(text.rlike(r"^[a-z0-9][^<:\s]*[a-z0-9]$"), text).otherwise(bare))

    def finish(bare: Column) -> Column:
        written = F.substring_index(bare, "@", 1)
        local = F.substring_index(written, "+", 1)
        words = F.translate(local, ".!#$%&'*+/=?^_{|}~-", "")
        return F.when(bare.rlike(_ADDRESS) & (words != "") & ~is_filler(words), F.concat(local if drop_tag else written, F.lit("@"), F.substring_index(bare, "@", -1)))

    return [lambda value: F.lower(clean(value)), strip, finish]


_NAME_WORD = r"\p{L}[\p{L}\p{M}'’.-]++"
_NAME = rf"^(?:{_NAME_WORD}(?<=\p{{L}}) )++{_NAME_WORD}(?<=\p{{L}}|[\p{{L}}\p{{M}}'’.-]\p{{L}}\.)$"


def name_steps() -> Steps:
    """"first last" in lower case, or null if the value is not a first and last name."""

    def turn(text: Column) -> Column:
        return F.when(text.contains(","), F.regexp_replace(text, r"^([^,]+?) ?, ?([^,]+)$", "$2 $1")).otherwise(text)

    def finish(turned: Column) -> Column:
        return F.when(turned.rlike(_NAME) & ~F.forall(F.split(turned, " "), is_filler), turned)

    return [lambda value: F.lower(_unwrap(clean(value))), turn, finish]


def phone_steps() -> Steps:
    """National digits, or null if the value is not one number with enough digits that someone may have."""

    def number(text: Column) -> Column:
        digits = F.regexp_replace(text, r"\D", "")
        return F.when(text.rlike(r"^\+?[\d\s()./-]+$"), digits)

    def finish(digits: Column) -> Column:
        national = F.substring(digits, -NATIONAL_DIGITS, NATIONAL_DIGITS)
        filler = national.rlike(r"^(\d)\1*$") | F.lit(_RISING).contains(digits) | F.lit(_FALLING).contains(digits) | F.lit(_RISING).contains(national) | F.lit(_FALLING).contains(national)
        return F.when(F.length(digits).between(NATIONAL_DIGITS, 15) & ~filler, national)

    label = r"^(tel|telephone|phone|fon|telefon|mobile|mob|cell|t|p|ph)\s*[.:]+\s*"
    return [lambda value: F.regexp_replace(F.lower(clean(value)), label, ""), number, finish]


def email(value: Column, *, drop_tag: bool = True) -> Column:
    return read(value, email_steps(drop_tag))


def person_name(value: Column) -> Column:
    return read(value, name_steps())


def phone(value: Column) -> Column:
    return read(value, phone_steps())
