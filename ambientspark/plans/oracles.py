"""All DuckDB statements, by query name."""

from ambientspark.plans import oracles_labels, oracles_rooms, oracles_streams, oracles_ticks

ORACLES = {**oracles_labels.ORACLES, **oracles_ticks.ORACLES, **oracles_rooms.ORACLES, **oracles_streams.ORACLES}
