"""The dialect's date and number format strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a date format and their form in Spark's patterns.
DATE_PARTS = {"dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "yyyy": "yyyy", "yy": "yy", "y": "y", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a", "t": "a"}
# Standard date formats of one letter.
STANDARD_DATES = {"d": "MM/dd/yyyy", "D": "dddd, dd MMMM yyyy", "t": "HH:mm", "T": "HH:mm:ss", "f": "dddd, dd MMMM yyyy HH:mm", "F": "dddd, dd MMMM yyyy HH:mm:ss", "g": "MM/dd/yyyy HH:mm", "G": "MM/dd/yyyy HH:mm:ss", "s": "yyyy-MM-ddTHH:mm:ss", "u": "yyyy-MM-dd HH:mm:ssZ", "m": "MMMM dd", "y": "yyyy MMMM"}


def date_pattern(pattern: str) -> str:
    """The pattern for Spark's date_format."""
    pattern = STANDARD_DATES.get(pattern, pattern)
    out = []
    for part in re.finditer(r"'([^']*)'|\"([^\"]*)\"|\\(.)|(([a-zA-Z])\5*)|(.)", pattern, re.DOTALL):
        quoted = part.group(1) if part.group(1) is not None else part.group(2) if part.group(2) is not None else part.group(3)
        run, other = part.group(4), part.group(6)
        if quoted is not None:
            out.append("'" + quoted.replace("'", "''") + "'" if quoted else "")
        elif run:
            if run[0] in "fF":
                out.append("S" * len(run))
            elif run in DATE_PARTS:
                out.append(DATE_PARTS[run])
            elif run[0] in "dyMHhmst":
                out.append(DATE_PARTS[max((k for k in DATE_PARTS if k[0] == run[0] and len(k) <= len(run)), key=len)])
            elif run[0] in "zK":
                out.append("")
            else:
                out.append("'" + run + "'")
        else:
            out.append("''" if other == "'" else other if other not in "[]{}#" else f"'{other}'")
    return "".join(out)


def formatted_number(value: Column, pattern: str) -> Column:
    """A double in one of the standard formats n, f, d, c, p, e, g with digits, or in a pattern of 0, #, comma and point.

    An unknown pattern gives null, as a null value does.
    """
    match = re.fullmatch(r"([nfdcpegx])(\d{0,2})", pattern.strip().lower())
    if match:
        kind, digits = match.group(1), int(match.group(2)) if match.group(2) else None
        places = 2 if digits is None else digits
        if kind == "n":
            return F.format_number(_rounded(value, places), places)
        if kind == "f":
            return _fixed(value, places)
        if kind == "c":
            amount = F.concat(F.lit("$"), F.format_number(F.abs(_rounded(value, places)), places))
            return F.when(_rounded(value, places) < 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount)
        if kind == "p":
            return F.concat(F.format_number(_rounded(value * 100, places), places), F.lit(" %"))
        if kind == "e":
            short = F.format_string(f"%.{6 if digits is None else digits}e", value)
            return F.when(value.isNotNull(), F.regexp_replace(short, r"e([+-])(\d\d)$", "e$10$2"))
        if kind == "d":
            return _padded(value, digits or 1)
        if kind == "g":
            return F.regexp_replace(value.cast("string"), r"\.0$", "")
        return F.lower(F.hex(value.try_cast("bigint")))
    if re.fullmatch(r"[#,0]*0?(\.[0#]+)?", pattern) and pattern:
        fraction = pattern.partition(".")[2]
        out = F.format_number(_rounded(value, len(fraction)), len(fraction)) if "," in pattern else _fixed(value, len(fraction))
        optional = len(fraction) - len(fraction.rstrip("#"))
        if optional:
            out = F.regexp_replace(out, rf"\.?0{{0,{optional}}}$", "") if optional == len(fraction) else F.regexp_replace(out, rf"0{{0,{optional}}}$", "")
        return out
    return F.lit(None).cast("string")


def _rounded(value: Column, places: int) -> Column:
    """Half away from zero, from the decimal form of the double."""
    return F.round(value.try_cast("decimal(38,12)"), places)


def _fixed(value: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(_rounded(value, places), places), ",", "")


def _padded(value: Column, digits: int) -> Column:
    plain = F.abs(value).try_cast("bigint").cast("string")
    padded = F.when(F.length(plain) < digits, F.lpad(plain, digits, "0")).otherwise(plain)
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), padded)
