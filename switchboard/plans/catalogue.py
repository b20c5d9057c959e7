"""All queries, by importing the modules that register them."""

from __future__ import annotations

from switchboard.plans import coaching, conversation, daily, files, insights, models, monitoring, streams, text  # noqa: F401
from switchboard.plans.registry import ORACLES, QUERIES  # noqa: F401
