"""SQL counterpart of the zero-phase filter: recursive queries over the padded samples."""

from __future__ import annotations

import numpy as np

from chronoweave.functions import iir


def _lit(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def _step(sections: np.ndarray) -> tuple[str, str]:
    """Nested selects that push ``x`` through the sections; returns (select list, nested source of ``src``)."""
    source, signal = "src", "x"
    for j, (b0, b1, b2, a1, a2) in enumerate(sections):
        source = f"(SELECT *, {_lit(b0)} * {signal} + p{j} AS y{j} FROM {source})"
        signal = f"y{j}"
    names, signal = [], "x"
    for j, (b0, b1, b2, a1, a2) in enumerate(sections):
        names.append(f"{_lit(b1)} * {signal} + q{j} - {_lit(a1)} * y{j} AS p{j}, {_lit(b2)} * {signal} - {_lit(a2)} * y{j} AS q{j}")
        signal = f"y{j}"
    return f"{signal} AS y, " + ", ".join(names), source


def _pass(name: str, table: str, sections: np.ndarray, key: str) -> str:
    """Recursive pass over ``table(key, n, x)`` from the steady state of its first sample."""
    rest = iir.steady_state(sections)
    select, source = _step(sections)
    states = ", ".join(f"p{j}, q{j}" for j in range(len(sections)))
    begin = ", ".join(f"{_lit(r[0])} * x AS p{j}, {_lit(r[1])} * x AS q{j}" for j, r in enumerate(rest))
    first = source.replace("src", f"(SELECT {key}, n, x, {begin} FROM {table} WHERE n = 0)")
    later = source.replace("src", f"(SELECT t.{key}, t.n, t.x, {', '.join(f'r.p{j}, r.q{j}' for j in range(len(sections)))} FROM {name} r JOIN {table} t ON t.{key} = r.{key} AND t.n = r.n + 1)")
    return f", {name} AS (SELECT {key}, n, {select} FROM {first} UNION ALL SELECT {key}, n, {select} FROM {later})" if states else ""


def zero_phase_sql(source: str, key: str, sections: np.ndarray, tag: str) -> str:
    """CTEs on ``source(key, i, v)``; the result is ``{tag}_out(key, i, v)``.  The statement must be RECURSIVE."""
    pad = iir.pad_length(sections)
    return (
        f"""
, {tag}_n AS (SELECT {key}, count(*) AS len, arg_min(v, i) AS v0, arg_max(v, i) AS vl FROM {source} GROUP BY {key})
, {tag}_long AS (SELECT s.{key}, i, v, len, v0, vl FROM {source} s JOIN {tag}_n m ON m.{key} = s.{key} WHERE len > {pad})
, {tag}_ext AS (
    SELECT {key}, i + {pad} AS n, v AS x FROM {tag}_long
    UNION ALL SELECT {key}, {pad} - i AS n, 2 * v0 - v AS x FROM {tag}_long WHERE i BETWEEN 1 AND {pad}
    UNION ALL SELECT {key}, {pad} + len + (len - 2 - i) AS n, 2 * vl - v AS x FROM {tag}_long WHERE i BETWEEN len - 1 - {pad} AND len - 2)"""
        + _pass(f"{tag}_fwd", f"{tag}_ext", sections, key)
        + f", {tag}_rev AS (SELECT f.{key}, len + {2 * pad} - 1 - n AS n, y AS x FROM {tag}_fwd f JOIN {tag}_n m ON m.{key} = f.{key})"
        + _pass(f"{tag}_bwd", f"{tag}_rev", sections, key)
        + f""", {tag}_out AS (SELECT b.{key}, len + {pad} - 1 - n AS i, y AS v FROM {tag}_bwd b JOIN {tag}_n m ON m.{key} = b.{key} WHERE n BETWEEN {pad} AND len + {pad} - 1
    UNION ALL SELECT s.{key}, i, v - avg(v) OVER (PARTITION BY s.{key}) AS v FROM {source} s JOIN {tag}_n m ON m.{key} = s.{key} WHERE len <= {pad})"""
    )
