"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainspan import model


def hash_raw(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def hash_fields(*parts: Column) -> Column:
    """SHA-256 over the parts joined by the unit separator; a missing part counts as empty, never as left out."""
    return F.sha2(F.concat_ws(model.FIELD_SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)
