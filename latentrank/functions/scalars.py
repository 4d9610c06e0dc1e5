"""Scalar functions of the scaling steps, as column expressions."""

from __future__ import annotations

import hashlib
import re
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rounded(x: Column, digits: int) -> Column:
    """``x`` times a power of ten to the nearest whole number, halves away from zero, over that power.

    This is SQL's rounding of doubles.  ``F.round`` rounds their shortest decimals
    instead, and differs where a number has been rounded before and ends in a 5.
    """
    far = F.abs(x) * 10.0**digits
    low = F.floor(far).cast("double")
    return F.signum(x) * (low + (far - low >= 0.5).cast("double")) / 10.0**digits


def choose_two(k: Column) -> Column:
    """Unordered pairs of k things; 0 below two."""
    return F.when(k >= 2, (k * (k - 1) / 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def label(winner: Column) -> Column:
    """1.0 where A wins, 0.0 for any other answer, null for none."""
    return (winner == "A").cast("double")


def not_tie(winner: Column) -> Column:
    """Null-safe: rows without a winner stay."""
    return ~winner.eqNullSafe(F.lit("tie"))


def agresti_coull(x: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = normal_quantile(1 - (1 - level) / 2)
    total = n + z * z
    p = (x + z * z / 2) / total
    half = z * F.sqrt(p * (1 - p) / total)
    return F.when(n > 0, F.greatest(F.lit(0.0), p - half)), F.when(n > 0, F.least(F.lit(1.0), p + half))


def folded(prob: Column, result: Column) -> tuple[Column, Column]:
    """Both turned to the favoured side where the probability is below a half."""
    swap = prob < 0.5
    return F.when(swap, 1 - prob).otherwise(prob), F.when(swap, 1 - result).otherwise(result)


def reliability_bin(prob: Column, bins: int = 10) -> Column:
    """1 .. bins: equal widths over [0.5, 1], closed on the right, 0.5 in the first."""
    return F.greatest(F.lit(1), F.ceil((prob - 0.5) * (2 * bins))).cast("int")


def prompt_hash(*parts: str) -> str:
    """md5 of the parts joined by line feeds, and one line feed more."""
    return hashlib.md5(("\n".join(parts) + "\n").encode()).hexdigest()


def prompt_hash_column(*parts: Column) -> Column:
    return F.md5(F.concat(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts]), F.lit("\n")))


def interpolate(template: str, columns: list[str]) -> Column:
    """``{{name}}`` replaced by columns, in one pass; null shows as NA."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(.+?)\s*\}\}", template):
        if m.group(1) not in columns:
            raise ValueError(f"the prompt names a column that the comparisons lack: {m.group(1)}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(f"`{m.group(1)}`").cast("string"), F.lit("NA"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def interpolated_length(template: str, lengths: dict[str, Column]) -> Column:
    """Characters of ``interpolate``'s text, from those of its columns."""
    total, at = F.lit(0).cast("bigint"), 0
    for m in re.finditer(r"\{\{\s*(.+?)\s*\}\}", template):
        total = total + (m.start() - at) + lengths[m.group(1)]
        at = m.end()
    return total + (len(template) - at)


def clean_response(response: Column) -> Column:
    """White space trimmed; any spelling of tie becomes ``tie``; A and B as they are."""
    trimmed = F.regexp_replace(response, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(F.lower(trimmed) == "tie", F.lit("tie")).otherwise(trimmed)


def invalid_response(cleaned: Column, allow_ties: bool = True) -> Column:
    """True for null as well."""
    return ~F.coalesce(cleaned.isin(*valid_answers(allow_ties)), F.lit(False))


def valid_answers(allow_ties: bool) -> tuple[str, ...]:
    return ("A", "B", "tie") if allow_ties else ("A", "B")


#: Published prices in USD per million tokens (input, output).
PRICES = {
    "gpt-6-astra": (10.00, 50.00),
    "gpt-6-sol": (4.00, 20.00),
    "gpt-6-terra": (2.00, 12.00),
    "gpt-6-luna": (0.20, 1.20),
    "gpt-5.5": (5.00, 30.00),
    "gpt-5.4": (2.50, 15.00),
    "gpt-5.4-mini": (0.75, 4.50),
    "gpt-5.4-nano": (0.20, 1.25),
    "gpt-5.2": (1.75, 14.00),
    "gpt-5.1": (1.25, 10.00),
    "gpt-5": (1.25, 10.00),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5-nano": (0.05, 0.40),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
}


def cost(model: str, n: Column, input_tokens: Column, batch: bool = False) -> Column | None:
    """USD for n answers of one token; None for a model without a price."""
    if model not in PRICES:
        return None
    price_in, price_out = (p * (0.5 if batch else 1.0) for p in PRICES[model])
    return input_tokens / 1e6 * price_in + n / 1e6 * price_out


def text_tokens(prompt_chars: Column, n: Column, system_prompt: str) -> Column:
    """Four characters to a token; the system prompt goes with every request."""
    return (prompt_chars + n * len(system_prompt)) / 4


def image_tokens(n: Column, system_prompt: str, per_image: int = 1500) -> Column:
    return n * (2 * per_image + len(system_prompt) / 4)
