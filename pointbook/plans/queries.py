"""All named queries: importing this module registers every query group.

Each group module pairs a ``queries()`` entry (library operators over the
stand-in tables) with its DuckDB oracle SQL.
"""

from . import changes, checks, lifecycles, reads, scalars, sends, streams, totals  # noqa: F401
