"""DuckDB SQL of the same samples and statistics, with window frames and unnested rows where the engine has chunks and arrays."""

from __future__ import annotations

from ..functions.keys import DUCKDB, recode_duckdb
from ..operators.orders import Shape
from ..operators.schemes import PLACE, Scheme, window_key


def sequence_sql(table: str, id_col: str, text_col: str, sigma: int) -> str:
    return f"SELECT {id_col} AS seq_id, {recode_duckdb(f'hex(encode(coalesce({text_col}, {chr(39) * 2})))', sigma)} AS h FROM {table}"


def sample_sql(seqs: str, scheme: Scheme, w: int, k: int, sigma: int) -> str:
    """CTEs, the last one smp(seq_id, n, h, win, pos, prev), over a query for (seq_id, h)."""
    l = w + k - 1
    head = f"WITH seqs AS ({seqs}), s AS (SELECT seq_id, h, length(h) // 2 AS n FROM seqs WHERE length(h) // 2 >= {l})"
    if scheme.kind == "minimizer":
        iw, ik = scheme.inner(w, k)
        place = "pos" if not scheme.rightmost else "(100000000000 - pos)"
        if scheme.sided:  # the key's last character says so
            place = f"(CASE WHEN right({scheme.order(DUCKDB, 'x', Shape(iw, ik, sigma))}, 1) = '1' THEN 100000000000 - pos ELSE pos END)"
        at = f"CAST(right(best, {PLACE}) AS BIGINT)"
        at = at if not scheme.rightmost else f"(100000000000 - {at})"
        if scheme.sided:
            at = f"(CASE WHEN substring(best, length(best) - {PLACE}, 1) = '1' THEN 100000000000 - {at} ELSE {at} END)"
        out = f"win + ({at} - win) % {w}" if scheme.mod else at
        body = f"""
, km AS (SELECT seq_id, n, h, unnest(range(0, n - {ik} + 1)) AS pos FROM s)
, kx AS (SELECT seq_id, n, h, pos, substring(h, 2 * pos + 1, {2 * ik}) AS x FROM km)
, kk AS (SELECT seq_id, n, h, pos, {scheme.order(DUCKDB, "x", Shape(iw, ik, sigma))} || lpad(CAST({place} AS VARCHAR), {PLACE}, '0') AS key FROM kx)
, mm AS (SELECT seq_id, n, h, pos AS win, min(key) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {iw - 1} FOLLOWING) AS best FROM kk)
, pp AS (SELECT seq_id, n, h, win, {out} AS pos FROM mm WHERE win <= n - {l})"""
    else:
        count = w if scheme.kind == "anchor" else l
        key = window_key(DUCKDB, scheme, w, k, sigma, "m", "j")
        body = f"""
, ws AS (SELECT seq_id, n, h, unnest(range(0, n - {l} + 1)) AS win FROM s)
, wm AS (SELECT seq_id, n, h, win, substring(h, 2 * win + 1, {2 * l}) AS m FROM ws)
, wj AS (SELECT seq_id, win, m, unnest(range(0, {count})) AS j FROM wm)
, wb AS (SELECT seq_id, win, min({key} || lpad(CAST(j AS VARCHAR), {PLACE}, '0')) AS best FROM wj GROUP BY seq_id, win)
, pp AS (SELECT wm.seq_id, n, h, wm.win, wm.win + CAST(right(best, {PLACE}) AS BIGINT) AS pos FROM wm JOIN wb ON wm.seq_id = wb.seq_id AND wm.win = wb.win)"""
    return head + body + "\n, smp AS (SELECT seq_id, n, h, win, pos, lag(pos) OVER (PARTITION BY seq_id ORDER BY win) AS prev FROM pp)\n"


CHANGED = "pos <> coalesce(prev, 0)"


def density_sql(samples: str, by: str = "seq_id") -> str:
    first = f"{by}, " if by else ""
    return samples + f"SELECT {first}count(*) AS n_windows, sum(CASE WHEN {CHANGED} THEN 1 ELSE 0 END)::BIGINT AS n_changes, sum(pos)::BIGINT AS pos_sum FROM smp" + (f" GROUP BY {by}" if by else "")


def grid_sql(seqs: str, schemes: list[tuple[str, Scheme]], ws: tuple[int, ...], ks: tuple[int, ...]) -> str:
    """Densities of all schemes by w and k: the keys of each scheme and k once, with a frame for each w."""
    parts, ctes = [], [f"seqs AS ({seqs})", "s AS (SELECT seq_id, h, length(h) // 2 AS n FROM seqs)"]
    for i, (name, scheme) in enumerate(schemes):
        for k in ks:
            t = f"{i}_{k}"
            frames = ", ".join(f"min(key) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS b{w}" for w in ws)
            ctes.append(f"km_{t} AS (SELECT seq_id, n, h, unnest(range(0, n - {k} + 1)) AS p FROM s WHERE n >= {k})")
            ctes.append(f"kx_{t} AS (SELECT seq_id, n, p, substring(h, 2 * p + 1, {2 * k}) AS x FROM km_{t})")
            ctes.append(f"kk_{t} AS (SELECT seq_id, n, p, {scheme.order(DUCKDB, 'x', Shape(0, k, 256))} || lpad(CAST(p AS VARCHAR), {PLACE}, '0') AS key FROM kx_{t})")
            ctes.append(f"mm_{t} AS MATERIALIZED (SELECT seq_id, n, p, {frames} FROM kk_{t})")
            for w in ws:
                pos = f"CAST(right(b{w}, {PLACE}) AS BIGINT)"
                rows = f"SELECT {pos} AS pos, lag({pos}) OVER (PARTITION BY seq_id ORDER BY p) AS prev FROM mm_{t} WHERE p <= n - {w + k - 1}"
                parts.append(f"SELECT '{name}' AS scheme, {w} AS w, {k} AS k, count(*) AS n_windows, count(*) FILTER ({CHANGED}) AS n_changes, coalesce(sum(pos), 0)::BIGINT AS pos_sum FROM ({rows})")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"
