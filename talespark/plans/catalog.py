"""All registered queries of the library's own operators, with their SQL."""

from talespark.plans import checks, evidence, notes, registry, scale, workflow

QUERIES = registry.QUERIES | evidence.QUERIES | workflow.QUERIES | checks.QUERIES | scale.QUERIES | notes.QUERIES
ORACLE_SQL = registry.ORACLE_SQL | evidence.ORACLE_SQL | workflow.ORACLE_SQL | checks.ORACLE_SQL | scale.ORACLE_SQL | notes.ORACLE_SQL
