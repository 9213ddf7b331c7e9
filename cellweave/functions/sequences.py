"""Base sequences packed into whole numbers, two bits a base, the first base highest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest sequence whose number is a positive bigint.
LONGEST = 31


def encode_sequence(seq: Column, on_bad: str = "error") -> Column:
    """The number of a sequence of A, C, G and T.

    Null gives null. Anything else than 1 to 31 of these bases is an error, or null with
    ``on_bad="null"``. All built-in functions, so it stays in generated code.
    """
    number = F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("bigint")
    good = seq.rlike(f"^[ACGT]{{1,{LONGEST}}}$")
    bad = F.raise_error(F.concat(F.lit("not a sequence of 1 to 31 bases: "), seq)) if on_bad == "error" else F.lit(None)
    return F.when(seq.isNull(), F.lit(None)).when(good, number).otherwise(bad.cast("bigint"))


def decode_sequence(number: Column, length: Column | int) -> Column:
    """The sequence of a number, filled up with A on the left to ``length`` bases.

    A number that needs more bases gets them: the result is then longer than ``length``.
    """
    digits = F.conv(number.cast("string"), 10, 4)
    length = F.lit(length) if isinstance(length, int) else length
    return F.translate(F.lpad(digits, F.greatest(length, F.length(digits)), F.lit("0")), "0123", "ACGT")
