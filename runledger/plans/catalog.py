"""Every registered query; importing this module loads all plan modules."""

from runledger.plans import fit, history, placement, rules, scalars, settings, sources, streams, tasks, telemetry  # noqa: F401
from runledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
