"""Every query over the driver's tables, with the SQL it must agree with."""

from __future__ import annotations

from sitemill.plans import q_chains, q_contacts, q_curate, q_features, q_sources, q_splits
from sitemill.plans.q_contacts import flagship
from sitemill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
