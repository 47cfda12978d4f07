"""SQL fragments for the checking engine."""

from __future__ import annotations

import math

from orientlake.functions.symmetry import group_matrices


def matrix_sql(rot: str, tilt: str, psi: str) -> list[str]:
    ca, sa = f"cos(radians({rot}))", f"sin(radians({rot}))"
    cb, sb = f"cos(radians({tilt}))", f"sin(radians({tilt}))"
    cg, sg = f"cos(radians({psi}))", f"sin(radians({psi}))"
    return [f"({ca}*{cb}*{cg} - {sa}*{sg})", f"(-({ca}*{cb}*{sg}) - {sa}*{cg})", f"({ca}*{sb})",
            f"({sa}*{cb}*{cg} + {ca}*{sg})", f"(-({sa}*{cb}*{sg}) + {ca}*{cg})", f"({sa}*{sb})",
            f"(-({sb}*{cg}))", f"({sb}*{sg})", cb]


def SQL_MATRIX(name: str, source: str, prefix: str, keep: str = "pid") -> str:
    cells = ", ".join(f"{e} as {prefix}{k // 3}{k % 3}" for k, e in enumerate(matrix_sql("rot", "tilt", "psi")))
    return f"{name} as (select {keep}, {cells} from {source})"


def trace_sql(a: str, b: str) -> str:
    return " + ".join(f"{a}{i}{j}*{b}{i}{j}" for i in range(3) for j in range(3))


def angle_sql(trace: str) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, (({trace}) - 1.0) / 2.0))))"


def sym_trace_sql(sym: str, a: str, b: str) -> str:
    """Largest trace of S b a' over the operators S."""
    traces = []
    for s in group_matrices(sym):
        terms = []
        for i in range(3):
            for j in range(3):
                if s[3 * i + j] != 0.0:
                    dot = " + ".join(f"{b}{j}{k}*{a}{i}{k}" for k in range(3))
                    terms.append(f"({s[3 * i + j]!r}) * ({dot})")
        traces.append(" + ".join(terms))
    return "greatest(" + ", ".join(traces) + ")" if len(traces) > 1 else traces[0]


def ops_sql(names: list[str]) -> str:
    rows = []
    for n in names:
        for i, m in enumerate(group_matrices(n)):
            rows.append(f"('{n}', {i}, " + ", ".join(f"cast({v!r} as double)" for v in m) + ")")
    cols = ", ".join(f"s{k // 3}{k % 3}" for k in range(9))
    return f"select * from (values {', '.join(rows)}) o(sym, op, {cols})"


def grid_sql(order: int) -> str:
    """The equal-area rotation grid, cone-major, as a query with idx and g00..g22."""
    n = 2 ** order
    cap, total, k = 2 * n * (n - 1), 12 * n * n, 6 * n
    cells = ", ".join(f"{e} as g{c // 3}{c % 3}" for c, e in enumerate(
        matrix_sql("degrees(phi)", "degrees(acos(z))", f"(360.0 * q / {k})")))
    return f"""select cast(p * {k} + q as bigint) as idx, {cells} from (
 select p, case when p < {cap} then (p + 1 - 2 * i * (i - 1) - 0.5) * pi() / (2 * i)
  when p < {total - cap} then (bj - 0.5 * (1 + ((bi + {n}) % 2))) * pi() / {2 * n}
  else (4 * si + 1 - (({total} - p) - 2 * si * (si - 1)) - 0.5) * pi() / (2 * si) end as phi,
 case when p < {cap} then 1 - i * i / {3.0 * n * n} when p < {total - cap} then ({2 * n} - bi) * 2 / {3.0 * n}
  else -1 + si * si / {3.0 * n * n} end as z
 from (select p, floor(sqrt((p + 1) / 2.0 - sqrt(floor((p + 1) / 2.0)))) + 1 as i,
  (p - {cap}) // {4 * n} + {n} as bi, (p - {cap}) % {4 * n} + 1 as bj,
  floor(sqrt(({total} - p) / 2.0 - sqrt(floor(({total} - p) / 2.0)))) + 1 as si from range({total}) r(p)) w) d, range({k}) t(q)"""


def euler_back_sql(c: str) -> str:
    pole = f"({c}02 * {c}02 + {c}12 * {c}12 < 1e-14)"
    return f"""case when {pole} then 0.0 else degrees(atan2({c}12, {c}02)) end as rot,
 degrees(acos(greatest(-1.0, least(1.0, {c}22)))) as tilt,
 case when {pole} then degrees(atan2({c}10, {c}11)) else degrees(atan2({c}21, -({c}20))) end as psi"""


def ctf_sql(lam: str) -> str:
    l = lam.format(v="(kv * 1000.0)")
    s2 = "(fx * fx + fy * fy)"
    df = "(0.5 * (defocus_u + defocus_v + (defocus_u - defocus_v) * cos(2 * (atan2(fy, fx) - radians(defocus_ang)))))"
    gamma = f"(2 * pi() * (-0.5 * {df} * ({l}) * {s2} + 0.25 * (cs * 1e7) * ({l}) * ({l}) * ({l}) * {s2} * {s2}))"
    return f"-(sqrt(1 - w * w) * sin({gamma}) - w * cos({gamma}))"


def normal_cdf_sql(z: str) -> str:
    a = f"(abs({z}) / {math.sqrt(2.0)!r})"
    t = f"(1.0 / (1.0 + 0.3275911 * {a}))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    erf = f"(1.0 - {poly} * exp(-({a} * {a})))"
    return f"(0.5 * (1.0 + case when {z} < 0 then -{erf} else {erf} end))"
