"""Every operator as a query over the shared test tables, next to the SQL it must agree with."""

from chainspan.catalog.registry import ORACLES, QUERIES  # noqa: F401
