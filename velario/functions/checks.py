"""Check digits as column expressions. Weights are fixed values of the numbering schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUIT_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CBU_BANK_WEIGHTS = (7, 1, 3, 9, 7, 1, 3)
CBU_ACCOUNT_WEIGHTS = (3, 9, 7, 1, 3, 9, 7, 1, 3, 9, 7, 1, 3)


def _weighted(number: Column, first: int, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.substring(number, first + k, 1).try_cast("int") * w
    return total


def cuit_ok(number: Column) -> Column:
    """Eleven digits whose last is the mod-11 check (11 counts as 0, 10 as 9)."""
    check = 11 - F.pmod(_weighted(number, 1, CUIT_WEIGHTS), F.lit(11))
    check = F.when(check == 11, 0).when(check == 10, 9).otherwise(check)
    return F.coalesce(number.rlike(r"^\d{11}$") & (check == F.substring(number, 11, 1).try_cast("int")), F.lit(False))


def cbu_ok(number: Column) -> Column:
    """Twenty-two digits in blocks of 8 and 14, each ending in its mod-10 check."""
    bank = F.pmod(10 - F.pmod(_weighted(number, 1, CBU_BANK_WEIGHTS), F.lit(10)), F.lit(10))
    account = F.pmod(10 - F.pmod(_weighted(number, 9, CBU_ACCOUNT_WEIGHTS), F.lit(10)), F.lit(10))
    return F.coalesce(
        number.rlike(r"^\d{22}$") & (bank == F.substring(number, 8, 1).try_cast("int")) & (account == F.substring(number, 22, 1).try_cast("int")), F.lit(False)
    )
