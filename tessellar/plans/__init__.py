"""Named queries over the test tables and the same in SQL, by area."""

from tessellar.plans import drafting, evaluation, files, grounding, ingest, ledger, retrieval, service, text

AREAS = (retrieval, text, ingest, files, ledger, evaluation, grounding, service, drafting)
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
SQL = {name: sql for area in AREAS for name, sql in area.SQL.items()}
