"""All registered queries: name -> (spark, data folder) -> DataFrame."""

from ambientspark.plans import queries_labels, queries_rooms, queries_streams, queries_ticks

QUERIES = {**queries_labels.QUERIES, **queries_ticks.QUERIES, **queries_rooms.QUERIES, **queries_streams.QUERIES}
