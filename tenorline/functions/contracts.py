"""Contract codes: a root, a month letter, a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month letters of contracts, January to December (fixed values).
MONTHS = "FGHJKMNQUVXZ"


def contract_pattern(root: str) -> str:
    """Regular expression of a root's codes: month letter and a year of four or at most two digits, with optional underscores."""
    return f"(?i){root}_?([{MONTHS}])_?([0-9]{{4}}|[0-9]{{1,2}})"


def normalize_contract(raw: Column, root: str) -> Column:
    """ROOT + month + four-digit year of the first code in a text, such as a file name; null without one. Years to 79 are 20xx."""
    month = F.upper(F.regexp_extract(raw, contract_pattern(root), 1))
    digits = F.regexp_extract(raw, contract_pattern(root), 2)
    year = digits.try_cast("int")
    full = F.when(F.length(digits) == 4, year).when(year <= 79, year + 2000).otherwise(year + 1900)
    return F.when(month != "", F.concat(F.lit(root.upper()), month, F.lpad(full.cast("string"), 4, "0")))


def month_number(letter: Column) -> Column:
    """1 to 12 of a month letter; 0 if it is none."""
    return F.position(F.upper(letter), F.lit(MONTHS))


def contract_year(code: Column) -> Column:
    """Year at the end of a code, two digits to 30 being 20xx; 0 if there is none."""
    digits = F.regexp_extract(code, "[A-Z]+([0-9]{2,4})$", 1)
    year = digits.try_cast("int")
    return F.when(digits == "", F.lit(0)).when(F.length(digits) > 2, year).when(year <= 30, year + 2000).otherwise(year + 1900)
