"""Column-level functions; all of them stay in the JVM."""

from chainspan.functions.text import (
    canon_identifier,
    image_basename,
    normalize_tags,
    slot_value,
    slug,
    trimmed,
    truncate_bytes,
)
from chainspan.functions.times import (
    coerce_timestamp,
    duration_text,
    epoch_ns,
    filetime_to_ns,
    ns_to_timestamp,
    parse_duration,
    utc_text,
)
from chainspan.functions.hashing import hash_fields, hash_raw

__all__ = [
    "canon_identifier",
    "coerce_timestamp",
    "duration_text",
    "epoch_ns",
    "filetime_to_ns",
    "hash_fields",
    "hash_raw",
    "image_basename",
    "normalize_tags",
    "ns_to_timestamp",
    "parse_duration",
    "slot_value",
    "slug",
    "trimmed",
    "truncate_bytes",
    "utc_text",
]
