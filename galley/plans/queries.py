"""All queries of the layout and fidelity operators."""

from __future__ import annotations

from galley.plans import fidelity, flow, gates, layout, more, release, scalars, sequences, spatial  # noqa: F401  they register themselves
from galley.plans.registry import ORACLES, QUERIES  # noqa: F401
