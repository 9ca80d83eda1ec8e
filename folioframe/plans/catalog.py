"""All queries of the document operators, gathered from the plan modules."""

from __future__ import annotations

from folioframe.plans import Registry, addresses, assembly, audits, finding, geometry, intervals, models, offsets, records, scalars, streams, structure

REGISTRY = Registry()
for _module in (structure, scalars, finding, assembly, models, records, streams, audits, addresses, geometry, offsets, intervals):
    _module.register(REGISTRY)
