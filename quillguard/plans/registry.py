"""Every query of the engine by name, with its SQL twin where SQL can state it."""

from __future__ import annotations

from quillguard.plans import cases, detection, handovers, inventory, joins, lifecycles, planted, policies, rollups, scans, twins, upkeep, values  # noqa: F401  they register what they declare
from quillguard.plans.base import ORACLES, QUERIES  # noqa: F401
