"""Rule definitions: one dataclass for a rule, plus bulk checks over a table of rule documents."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspan import model

# --- fixed values -----------------------------------------------------------
FORMAT_VERSION = 1
MIN_SEQUENCE = 2
MAX_SEQUENCE = 1000
MAX_RULE_BYTES = 1 << 20
MAX_WINDOW_NS = 30 * 24 * 3600 * 1_000_000_000
SCOPES = ("computer", "global")
# algorithm -> (needs a sequence, optional fields it reads)
ALGORITHMS = {
    "sequence": (True, ()),
    "field": (True, ("match_fields", "match_scope")),
    "temporal": (True, ("window_within", "window_total", "match_fields", "match_scope")),
    "lineage": (False, ("lineage_create_ids", "lineage_depth", "match_scope")),
}
DURATION_NS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
# --- end of fixed values ----------------------------------------------------

_DURATION_PART = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)")


def duration_ns(text: str) -> int:
    """``1h30m`` -> nanoseconds; blank is 0; anything else raises ValueError."""
    t = text.strip()
    if t in ("", "0", "+0", "-0"):
        return 0
    sign, body = (-1, t[1:]) if t[0] == "-" else (1, t.lstrip("+"))
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return sign * int(sum(Fraction("0" + n.rstrip(".")) * DURATION_NS[u] for n, u in parts))


def duration_text(ns: int) -> str:
    """``300000000000`` -> ``5m0s``; the form of ``functions.duration_text``."""
    if ns < 0:
        return "-" + duration_text(-ns)
    small = next(((unit, size) for unit, size in (("ns", 1), ("µs", 1_000), ("ms", 1_000_000)) if ns < size * 1_000), None)
    if ns == 0 or small is None:
        minutes, rest = divmod(ns, 60_000_000_000)
        hours, minutes = divmod(minutes, 60)
        seconds = f"{rest // 1_000_000_000}.{rest % 1_000_000_000:09d}".rstrip("0").rstrip(".") + "s"
        return (f"{hours}h" if hours else "") + (f"{minutes}m" if hours or minutes else "") + seconds
    unit, size = small
    width = len(str(size)) - 1
    fraction = f".{ns % size:0{width}d}".rstrip("0").rstrip(".") if width else ""
    return f"{ns // size}{fraction}{unit}"


@dataclass(frozen=True)
class Rule:
    name: str
    sequence: tuple[str, ...] = ()
    algorithm: str = "sequence"
    relation_type: str = "correlation"
    labels: tuple[str, ...] = ()
    match_fields: tuple[str, ...] = ()
    match_scope: str = "computer"
    window_within: str = ""
    window_total: str = ""
    lineage_create_ids: tuple[str, ...] = ()
    lineage_exit_id: str = model.LINEAGE_EXIT_ID
    lineage_depth: int = 0
    channels: tuple[str, ...] = ()
    description: str = ""
    source: str = "user"
    enabled: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def rule_id(self) -> str:
        return re.sub(r"[^a-z0-9]+", "-", self.name.strip().lower()).strip("-")

    @property
    def within_ns(self) -> int:
        return duration_ns(self.window_within)

    @property
    def total_ns(self) -> int:
        return duration_ns(self.window_total)

    @property
    def create_ids(self) -> tuple[str, ...]:
        ids = tuple(i.strip() for i in self.lineage_create_ids if i.strip())
        return ids or (model.LINEAGE_CREATE_ID,)

    @property
    def step_codes(self) -> tuple[str, ...]:
        """Event codes that must occur for the rule to match at all."""
        return self.create_ids if self.algorithm == "lineage" else self.sequence

    @property
    def bucket_slots(self) -> tuple[str, ...]:
        known = ALGORITHMS.get(self.algorithm)
        return self.match_fields if known is None or "match_fields" in known[1] else ()

    @staticmethod
    def from_json(text: str) -> "Rule":
        doc = json.loads(text)
        names = {f for f in Rule.__dataclass_fields__ if f not in ("extra", "source", "enabled")}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in doc.items() if k in names}
        return Rule(**known).normalized()

    def normalized(self) -> "Rule":
        strip = lambda xs: tuple(x.strip() for x in xs)
        return replace(
            self,
            name=self.name.strip(),
            description=self.description.strip(),
            algorithm=self.algorithm.strip() or "sequence",
            relation_type=self.relation_type if self.relation_type in model.RELATION_TYPES else "correlation",
            sequence=strip(self.sequence),
            labels=strip(self.labels),
            match_fields=strip(self.match_fields),
            match_scope=self.match_scope.strip() or "computer",
            channels=strip(self.channels),
        )

    def to_json(self) -> str:
        doc = {
            "format_version": FORMAT_VERSION,
            "name": self.name,
            "description": self.description,
            "relation_type": self.relation_type,
            "algorithm": self.algorithm,
        }
        for key in ("sequence", "labels", "match_fields", "lineage_create_ids", "channels"):
            if getattr(self, key):
                doc[key] = list(getattr(self, key))
        if self.match_scope != "computer":
            doc["match_scope"] = self.match_scope
        for key in ("window_within", "window_total", "lineage_depth"):
            if getattr(self, key):
                doc[key] = getattr(self, key)
        return json.dumps(doc)


RULE_FRAME_SCHEMA = (
    "rule_ix int, rule_id string, name string, algorithm string, relation_type string, labels array<string>, "
    "match_fields array<string>, channels array<string>, step_codes array<string>, sequence array<string>, "
    "within_text string, enabled boolean"
)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a constant of the plan: no job and no Python worker is needed to read it."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(text))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule. Its size is the number of rules, so it may be broadcast."""
    rows = [
        {
            "rule_ix": i,
            "rule_id": r.rule_id,
            "name": r.name,
            "algorithm": r.algorithm,
            "relation_type": r.relation_type,
            "labels": r.labels,
            "match_fields": r.bucket_slots,
            "channels": r.channels,
            "step_codes": r.step_codes,
            "sequence": r.sequence,
            "within_text": duration_text(r.within_ns) if r.algorithm == "temporal" else None,
            "enabled": r.enabled,
        }
        for i, r in enumerate(rules)
    ]
    return small_table(spark, rows, RULE_FRAME_SCHEMA)
