"""All queries on the reference tables by name: importing this module loads the modules that state them."""

from __future__ import annotations

from spanforge.operators import aggregates, choices, contracts, evaluation, filings, indexes, joins, lines, mining, passes, references, replays, runs, scalars, scoring, sections, texts, windows, wrappers  # noqa: F401
from spanforge.streaming import state  # noqa: F401
from spanforge.plans.registry import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
