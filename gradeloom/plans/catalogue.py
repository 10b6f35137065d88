"""Every query of the engine by name, with the SQL that must return the same rows.

A query on pages is there twice: on the part of the orders that its SQL takes, and, its name
ending in ``_all``, on every order. Those of WHOLE are there once, on every order.
"""

from __future__ import annotations

from gradeloom.plans import adapters, q_commands, q_evaluation, q_files, q_grading, q_identity, q_joins, q_more, q_ownership, q_results, q_scans

#: Parts whose queries on pages take every order alone.
WHOLE = (q_files, q_results)
PARTS = (q_grading, q_ownership, q_evaluation, q_joins, q_more, q_files, q_results, q_commands, q_identity, q_scans)
QUERIES: dict = {name: f for part in PARTS for name, f in part.Q.items()}
ORACLE_SQL: dict = {name: text for part in PARTS for name, text in part.S.items()}

for _name in [n for part in WHOLE for n, text in part.S.items() if adapters.PAGES_SQL in text]:
    QUERIES[_name] = adapters.on_every_page(QUERIES[_name])
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(adapters.PAGES_SQL, adapters.ALL_PAGES_SQL)

for _name in [n for n, text in ORACLE_SQL.items() if adapters.PAGES_SQL in text]:
    QUERIES[f"{_name}_all"] = adapters.on_every_page(QUERIES[_name])
    ORACLE_SQL[f"{_name}_all"] = ORACLE_SQL[_name].replace(adapters.PAGES_SQL, adapters.ALL_PAGES_SQL)
