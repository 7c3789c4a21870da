"""The registered queries and their SQL twins."""

from . import memories, partitions, statistics, streams, views

QUERIES = {**memories.QUERIES, **partitions.QUERIES, **statistics.QUERIES, **streams.QUERIES, **views.QUERIES}
ORACLE_SQL = {**memories.ORACLE_SQL, **partitions.ORACLE_SQL, **statistics.ORACLE_SQL, **streams.ORACLE_SQL, **views.ORACLE_SQL}
