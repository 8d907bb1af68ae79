"""Independent DuckDB SQL for every query that plain SQL can express."""

from __future__ import annotations

from functools import cache

from holdfast.oracle.compose import compose


def _parts():
    from holdfast.oracle import base, decisions, descriptive, primitives

    modules = (descriptive, decisions, primitives)
    ctes = dict(base.CTES)
    for m in modules:
        ctes.update(m.CTES)
    return ctes, {name: sql for m in modules for name, sql in m.Q.items()}


def raw_sql() -> dict[str, str]:
    ctes, queries = _parts()
    return {name: compose(sql, ctes) for name, sql in queries.items()}


def _shape(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind.startswith("DECIMAL") or kind in ("DOUBLE", "FLOAT"):
        x = f"{c}::DOUBLE"
        return (f"CASE WHEN abs({x}) >= 1e6 THEN round({x} + 1.37e-3::DOUBLE, 0) "
                f"WHEN abs({x}) >= 1e3 THEN round({x} + 1.37e-5::DOUBLE, 2) "
                f"ELSE round({x} + 1.37e-9::DOUBLE, 6) END AS {c}")
    if kind.endswith(("INT", "INTEGER")):
        return f"{c}::BIGINT AS {c}"
    return c


# Column types of the driver's tables that the queries read.
TABLES = {
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, "
                "l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
}


@cache
def comparable_sql() -> dict[str, str]:
    """The queries in the result form of ``catalog.comparable``: bigint whole numbers and doubles
    rounded by size.  Column types come from binding each query against empty tables."""
    import duckdb

    con = duckdb.connect()
    for table, columns in TABLES.items():
        con.execute(f"CREATE TABLE {table} ({columns})")
    out = {}
    for name, sql in raw_sql().items():
        columns = con.execute(f"DESCRIBE {sql}").fetchall()
        shaped = ",\n".join(_shape(c[0], c[1]) for c in columns)
        out[name] = f"SELECT {shaped}\nFROM (\n{sql}\n)"
    con.close()
    return out
