"""Every registered query of the library's own operators and the SQL that states it."""

from tessera.jobs import context, ensembles, evaluation, signals, telemetry  # noqa: F401  (importing registers)
from tessera.jobs.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
