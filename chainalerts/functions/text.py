"""Text of numbers, timestamps and remarks, as SQL expressions."""

from __future__ import annotations

from chainalerts.constants import ACCOUNT_PATTERN, MENTION_PATTERN, TIMESTAMP_FORMAT
from chainalerts.functions.json_values import bind


def text(*parts: str) -> str:
    """Concatenation in which NULL prints as nothing."""
    return f"concat_ws('', {', '.join(parts)})"


def _strip_zeros(decimal: str) -> str:
    return f"regexp_replace(CAST({decimal} AS STRING), '[.]?0+$', '')"


def float_text(value: str) -> str:
    """Shortest text of a DOUBLE: plain from 1e-4 up to 1e15, else like ``2.5e-05``.

    The shortest of 15, 16 and 17 significant digits that gives the same double again.
    """
    fifteen, sixteen, seventeen = (f"format_string('%.{n}e', number)" for n in (14, 15, 16))
    shortest = (
        f"CASE WHEN CAST({fifteen} AS DOUBLE) = number THEN {fifteen} "
        f"WHEN CAST({sixteen} AS DOUBLE) = number THEN {sixteen} ELSE {seventeen} END"
    )
    scientific = (
        "concat(rtrim('.', rtrim('0', substring_index(sci, 'e', 1))), 'e', "
        "substring_index(sci, 'e', -1))"
    )
    plain = _strip_zeros("try_cast(sci AS DECIMAL(38,20))")
    shown = f"IF(abs(number) >= 1e-4 AND abs(number) < 1e15, {plain}, {scientific})"
    return bind(
        value, "number",
        "CASE WHEN number IS NULL THEN NULL WHEN number = 0 THEN '0' "
        f"ELSE {bind(shortest, 'sci', shown)} END",
    )


def amount_text(raw: str, divisor: str) -> str:
    """Text of ``raw / divisor`` as a double; ``raw`` is the amount's text.

    For integers of up to 15 digits the double's shortest text is the exact decimal, so
    the point is put into the digits (thousandths, or millionths from 1e-4 up). All other
    amounts go through a double.
    """
    decimals = f"IF({divisor} = 1000, 3, 6)"
    digits = f"lpad({raw}, greatest(length({raw}), {decimals} + 1), '0')"
    pointed = (
        f"concat(left({digits}, length({digits}) - {decimals}), '.', right({digits}, {decimals}))"
    )
    by_double = float_text(f"try_divide(try_cast({raw} AS DOUBLE), CAST({divisor} AS DOUBLE))")
    return (
        f"CASE WHEN {raw} IS NULL OR {divisor} IS NULL THEN NULL "
        f"WHEN {divisor} IN (1000, 1000000) AND {raw} RLIKE '^(0|[1-9][0-9]{{0,14}})$' "
        f"AND ({divisor} = 1000 OR {raw} = '0' OR length({raw}) > 2) "
        f"THEN rtrim('.', rtrim('0', {pointed})) ELSE {by_double} END"
    )


def cents_of_float(value: str) -> str:
    """A double stored as a number with two decimals.

    The double becomes a decimal of 15 significant digits first, which heals ties that
    float arithmetic misses by an ulp, and is then rounded half away from zero.
    """
    digits = f"try_cast(format_string('%.14e', {value}) AS DECIMAL(38,18))"
    return f"try_cast(round({digits}, 2) AS DECIMAL(10,2))"


def timestamp_text(ts: str) -> str:
    return f'date_format({ts}, "{TIMESTAMP_FORMAT}")'


def percent_text(value: str) -> str:
    """Two digits, point, two digits, percent sign; hashes from 100 up."""
    return bind(
        f"round({value}, 2)", "shown",
        "concat(IF(shown < 0, '-', ''), "
        "IF(abs(shown) >= 100, '##.##', format_string('%05.2f', abs(shown))), '%')",
    )


def mentioned_names(body: str) -> str:
    """Distinct names mentioned in a text."""
    return f"array_distinct(regexp_extract_all({body}, '{MENTION_PATTERN}', 1))"


def valid_account_name(name: str) -> str:
    return f"{name} RLIKE '{ACCOUNT_PATTERN}'"
