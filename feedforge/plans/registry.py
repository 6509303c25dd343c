"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import analytics, lake

QUERIES = {**lake.Q, **analytics.Q}
ORACLE_SQL = {**lake.SQL, **analytics.SQL}
