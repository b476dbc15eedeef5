"""All registered queries."""

from tessera.plans import analytics, clauses, engine, grammars, landing, relational, suites, textual  # noqa: F401  they register themselves
from tessera.registry import QUERIES, SQL  # noqa: F401
