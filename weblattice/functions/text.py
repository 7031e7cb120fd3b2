"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(c: Column) -> Column:
    """Unicode composed form (NFC); null stays null.

    Spark has no expression for it, but ships ICU, whose static ``compose``
    is reachable without a Python worker.
    """
    composed = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)
    )
    return F.when(c.isNotNull(), composed)


def lower_nfc(c: Column) -> Column:
    """Lower case of the composed form."""
    return F.lower(nfc(c))


def words(c: Column, pattern: str = r"\p{L}+") -> Column:
    """Array of the unbroken runs of letters (or of ``pattern``)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def name_key(c: Column) -> Column:
    """Letters and digits only, ignoring case: two names agree if their keys do."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
