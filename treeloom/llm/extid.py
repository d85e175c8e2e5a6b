"""Event identifiers and payloads in one canonical writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.llm.contact import Steps, clean, read

#: Widths of the two digit blocks of an identifier written without separators.
BLOCKS = (4, 5)


def ext_id_steps() -> Steps:
    """Canonical writings of an identifier: first its identity without leading zeros, then with blocks padded. Null if blank.

    A mistyped identifier keeps the blocks it has, so that it stays one slip from
    the right one: in the first writing unless the slip hit a leading zero, then
    in the second.
    """

    def dash(value: Column) -> Column:
        low = F.lower(value)
        dashed = F.regexp_replace(F.regexp_replace(F.lower(clean(value)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
        # as it should be already
        return F.when(low.rlike(_PLAIN), low).otherwise(dashed)

    def pad(part: Column, i: Column) -> Column:
        width = F.when(i == 1, BLOCKS[0]).otherwise(BLOCKS[1])
        return F.when(i == 0, part).otherwise(F.lpad(part, F.greatest(F.length(part), width), "0"))

    def writings(parts: Column) -> Column:
        return F.array_distinct(F.array(F.concat_ws("-", parts), F.concat_ws("-", F.transform(parts, pad))))

    def blocks(dashed: Column) -> Column:
        joined = F.when(dashed.contains("-"), dashed).otherwise(F.regexp_replace(dashed, rf"^([a-z]{{3}})(\d{{{BLOCKS[0]}}})(\d+x?)$", "$1-$2-$3"))
        return F.split(F.regexp_replace(joined, r"(?<=^|-)0+(?=[0-9])", ""), "-")

    def finish(dashed: Column) -> Column:
        # without leading zeros and with blocks of full width both writings are the text itself
        return F.when(dashed.rlike(_FULL), F.array(dashed)).otherwise(F.when(dashed != "", read(blocks(dashed), [writings])))

    return [dash, finish]


_PLAIN = rf"^[a-z]{{3}}-\d{{{BLOCKS[0]},}}-\d{{{BLOCKS[1] - 1},}}[\dx]$"
_FULL = rf"^[a-z]{{3}}-[1-9]\d{{{BLOCKS[0] - 1},}}-[1-9]\d{{{BLOCKS[1] - 2},}}[\dx]$"


def ext_id_texts(value: Column) -> Column:
    return read(value, ext_id_steps())


def content(payload: Column) -> Column:
    """JSON text with keys in order and no white space; other text as it stands, trimmed; blank is null."""
    parsed = F.to_json(F.try_parse_json(payload))
    return F.coalesce(parsed, F.when(F.trim(payload) != "", F.trim(payload)))
