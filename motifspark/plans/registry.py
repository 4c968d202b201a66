"""Registration of queries with their SQL twins, and the SQL of the derived sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PARTS = {
    "genes": """genes AS (
        SELECT c_custkey AS gk, c_mktsegment AS family,
            translate(md5('g' || c_custkey::VARCHAR) || md5('h' || c_custkey::VARCHAR), '0123456789abcdef', 'acgtacgtacgtacgt') AS gs
        FROM customer)""",
    "seqs": """seqs0 AS (
        SELECT o_orderkey AS sk, gk, family, gs, md5('m' || o_orderkey::VARCHAR) || md5('k' || o_orderkey::VARCHAR) AS mask,
            md5('t' || o_orderkey::VARCHAR) || md5('u' || o_orderkey::VARCHAR) AS turn
        FROM orders JOIN genes ON o_custkey = gk)""",
    "sites": """sites0 AS (
        SELECT sk, gk, family, gs, pos, substr(gs, pos, 1) AS sc, (pos BETWEEN 2 AND 63 AND substr(mask, pos, 1) = '0') AS mu,
            substr('acgtacgt', instr('acgt', substr(gs, pos, 1)) + 1 + (instr('0123456789abcdef', substr(turn, pos, 1)) - 1) % 3, 1) AS turned
        FROM (SELECT *, unnest(range(1, 65)) AS pos FROM seqs0)),
    sites AS (
        SELECT sk, gk, family, gs, pos, sc, mu, CASE WHEN mu THEN turned ELSE sc END AS ec,
            CASE WHEN mu THEN row_number() OVER (PARTITION BY sk, mu ORDER BY md5(sk::VARCHAR || '-' || pos::VARCHAR)) END AS stp
        FROM sites0)""",
    "ends": "ends AS (SELECT sk, gk, family, gs, string_agg(ec, '' ORDER BY pos) AS es FROM sites GROUP BY sk, gk, family, gs)",
    "risk": """states AS (
        SELECT s.sk, m.stp AS i, s.pos, s.stp, s.ec AS target, CASE WHEN s.stp < m.stp THEN s.ec ELSE s.sc END AS c
        FROM sites s JOIN (SELECT sk, stp FROM sites WHERE mu) m USING (sk)),
    grams AS (SELECT *, lag(c) OVER w || c || lead(c) OVER w AS motif FROM states WINDOW w AS (PARTITION BY sk, i ORDER BY pos)),
    risk AS (
        SELECT sk, i AS step, pos AS site, motif, target, coalesce(stp = i, false) AS hit,
            ((instr('acgt', motif[1]) - 1) * 16 + (instr('acgt', motif[2]) - 1) * 4 + instr('acgt', motif[3]) - 1) AS idx
        FROM grams WHERE pos BETWEEN 2 AND 63 AND (stp IS NULL OR stp >= i))""",
    "rated": "rated AS (SELECT *, (idx % 7) / 7.0::DOUBLE AS theta, exp((idx % 7) / 7.0::DOUBLE) AS h, sum(exp((idx % 7) / 7.0::DOUBLE)) OVER (PARTITION BY sk, step) AS den FROM risk)",
}
_ORDER = list(_PARTS)


def derived(last: str, statement: str, skip: tuple[str, ...] = ()) -> str:
    """The statement behind the derived relations up to `last`."""
    names = [x for x in _ORDER[: _ORDER.index(last) + 1] if x not in skip]
    return "WITH " + ",\n".join(_PARTS[x] for x in names) + "\n" + statement


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add
