"""Check digits and calendar checks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rotation() -> tuple[str, str, str]:
    """Verhoeff's tables, from its rules: the dihedral group of the pentagon, a permutation and its powers, and inverses."""

    def product(a: int, b: int) -> int:
        flip = a >= 5
        turn = (a % 5 - b % 5 if flip else a % 5 + b % 5) % 5
        return turn + (0 if flip == (b >= 5) else 5)

    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # fixed values: Verhoeff's permutation
    powers = [tuple(range(10))]
    for _ in range(7):
        powers.append(tuple(step[v] for v in powers[-1]))
    group = [[product(a, b) for b in range(10)] for a in range(10)]
    inverse = [next(b for b in range(10) if group[a][b] == 0) for a in range(10)]
    return "".join(str(x) for r in group for x in r), "".join(str(x) for r in powers for x in r), "".join(map(str, inverse))


GROUP, POWERS, INVERSE = _rotation()
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = "\\d{2}[A-Z]{5}\\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "\\D", "")


def _look(table: str, at: Column) -> Column:
    return F.substring(F.lit(table), at.cast("int") + 1, F.lit(1)).cast("int")


def _verhoeff(digits: Column, shift: int) -> Column:
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda x: x != "")), lambda x, i: _look(POWERS, ((i + shift) % 8) * 10 + x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda c, p: _look(GROUP, c * 10 + p))


def verhoeff_valid(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), _verhoeff(digits, 0) == 0).otherwise(False)


def verhoeff_check_digit(digits: Column) -> Column:
    """The digit to append; null for anything but digits."""
    return F.when(digits.rlike("^[0-9]+$"), _look(INVERSE, _verhoeff(digits, 1)))


def luhn_valid(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(False)


def luhn_check_digit(digits: Column) -> Column:
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda x: x != "")), lambda x, i: F.when(i % 2 == 0, F.when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int"))).otherwise(x.cast("int")))
    return F.when(digits.rlike("^[0-9]+$"), (10 - F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10) % 10)


def gstin_check_char(first14: Column) -> Column:
    """The 15th character for 14 of base 36: products with 1 and 2 in turn, their base-36 digits summed up."""
    chars = F.filter(F.split(F.substring(first14, 1, 14), ""), lambda x: x != "")
    each = F.transform(chars, lambda x, i: (F.instr(F.lit(BASE36), x) - 1) * F.when(i % 2 == 0, 1).otherwise(2))
    total = F.aggregate(F.transform(each, lambda p: (F.floor(p / 36) + p % 36).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.substring(F.lit(BASE36), ((36 - total % 36) % 36).cast("int") + 1, F.lit(1))


def gstin_valid(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.rlike(f"^{GSTIN}\\z"), gstin_check_char(up) == F.substring(up, 15, 1)).otherwise(False)


def valid_date(day: Column, month: Column, year: Column) -> Column:
    """A calendar date of the years 1900 to 2100."""
    real = F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).isNotNull()
    return F.coalesce(year.between(1900, 2100) & real, F.lit(False))
