"""Repeatable draws: every random step hashes a seed and the row's key (SMP-2..4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, bind

# Statement items the distractor columns are drawn from.
STATEMENT_ITEMS = (
    "income", "expenses", "revenue", "business_cost", "cost", "gross_profit", "expense", "gross_margins", "tax",
    "asset_impairment_loss", "credit_impairment_loss", "fair_value_variation", "return_on_investment",
    "investment_loss", "other_income", "operating_profit", "non_operating_income", "non_operating_expenses",
    "total_profits", "income_tax_expense", "current_income_tax", "deffered_income_tax", "taxable_income",
    "income_tax_rate", "original_value", "net_salvage", "expected_useful_life", "annual_depreciation_rate",
    "net_salvage_rate", "expected_workload", "workload", "expected_uesful_life", "depreciation_amortization",
    "book_balance", "impairment_provision", "net_book_value", "face_amount_of_notes_receivable",
    "interest_on_notes_receivable", "maturity_of_notes_receivable", "discount_rate", "discount_period",
    "maturity_value_of_notes_receivable", "discount_interest",
)

MAX_YEAR_SPAN = 4


def draw_key(key: ColumnOrName, seed: str) -> Column:
    """Hex digest of seed and key: the sort key of every seeded order."""
    return F.md5(F.concat(F.lit(seed + ":"), as_col(key).cast("string")))


def draw_int(key: ColumnOrName, seed: str, low: Column | int, high: Column | int) -> Column:
    """Integer in [low, high] fixed by seed and key."""
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    raw = F.conv(F.substr(draw_key(key, seed), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return (lo + F.pmod(raw, (hi - lo + 1).cast("bigint"))).cast("int")


def sample_years(key: ColumnOrName, low: int, high: int, seed: str = "years") -> Column:
    """SMP-3: consecutive years between two draws; equal draws step back one, long spans are redrawn to 1..4."""
    k = as_col(key)
    second = draw_int(k, seed + "-b", low, high)
    first = draw_int(k, seed + "-a", low, high)
    ends = F.struct(F.when(first == second, first - 1).otherwise(first).alias("a"), second.alias("b"))

    def expand(pair: Column) -> Column:
        begin, end = F.least(pair["a"], pair["b"]), F.greatest(pair["a"], pair["b"])
        short = begin + draw_int(k, seed + "-span", 1, MAX_YEAR_SPAN)
        return F.sequence(begin, F.when(end - begin > MAX_YEAR_SPAN, short).otherwise(end))

    return bind(ends, expand)


def sample_distractors(key: ColumnOrName, seed: str = "distractors", items: tuple[str, ...] = STATEMENT_ITEMS) -> Column:
    """SMP-4: two or three different items, in drawn order."""
    k = as_col(key)
    # each item's draw comes from the row key and the item itself
    keyed = F.transform(
        F.array(*map(F.lit, items)),
        lambda item: F.struct(draw_key(F.concat(k.cast("string"), F.lit(":"), item), seed).alias("d"), item.alias("item")),
    )
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["item"]), F.lit(1), draw_int(k, seed + "-n", 2, 3))
