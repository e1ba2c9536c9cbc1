"""Every registered query."""

from __future__ import annotations

from vigilframe.plans import disclosure, feedback, intraday, modelling, screening, voice
from vigilframe.plans.registry import Registry

QUERIES = Registry()
for module in (screening, modelling, disclosure, feedback, intraday, voice):
    for name, fn in module.QUERIES.items():
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
