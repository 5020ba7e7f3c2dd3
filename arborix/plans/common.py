"""How queries are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query(spark, sf_dir) and, where SQL can express it, the SQL that DuckDB holds it against."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits})"


def label_sql(nodes: str, links: str, rounds: int = 12) -> str:
    """Common table expressions up to lb(image_id, id, component): the smallest id that each of nodes(image_id, id) can reach over links(image_id, u, v), both directions given.

    In each round a node and its parent look at the parents' parents of its neighbours. Rounds that do not suffice are an error.
    """
    out = [f"f0 AS MATERIALIZED (SELECT image_id, id, id AS f FROM {nodes})"]
    for k in range(rounds):
        out.append(f"g{k} AS MATERIALIZED (SELECT a.image_id, a.id, a.f, b.f AS g FROM f{k} a JOIN f{k} b ON b.image_id = a.image_id AND b.id = a.f)")
        out.append(f"m{k} AS MATERIALIZED (SELECT l.image_id, l.u AS id, min(g) AS m FROM {links} l JOIN g{k} ON g{k}.image_id = l.image_id AND g{k}.id = l.v GROUP BY l.image_id, l.u)")
        out.append(
            f"f{k + 1} AS MATERIALIZED (SELECT image_id, id, min(c) AS f FROM (SELECT image_id, id, g AS c FROM g{k} UNION ALL SELECT image_id, id, m FROM m{k} "
            f"UNION ALL SELECT g{k}.image_id, g{k}.f, m FROM m{k} JOIN g{k} USING (image_id, id)) GROUP BY image_id, id)"
        )
    last = f"(SELECT count(*) FROM f{rounds} JOIN f{rounds - 1} o USING (image_id, id) WHERE f{rounds}.f <> o.f)"
    out.append(f"lb AS MATERIALIZED (SELECT image_id, id, CASE WHEN {last} > 0 THEN error('labels did not settle') ELSE f END AS component FROM f{rounds})")
    return ",\n".join(out)
