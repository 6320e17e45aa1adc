"""Every operator as a named query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from wayfold.catalog import checks, entities, evaluation, folding, labelling, learning, profiling, series, sources, streams
from wayfold.catalog import trajectories as journeys
from wayfold.catalog.entry import Entry

_AREAS = (sources, profiling, labelling, entities, series, checks, evaluation, folding, journeys, learning, streams)


def entries() -> dict[str, Entry]:
    found: dict[str, Entry] = {}
    for area in _AREAS:
        for entry in area.ENTRIES:
            if entry.name in found:
                raise ValueError(f"query {entry.name} is registered twice")
            found[entry.name] = entry
    return found
