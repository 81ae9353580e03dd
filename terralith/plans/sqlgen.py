"""Vector expressions as DuckDB text, for the oracles of the field queries."""

from __future__ import annotations

V = tuple[str, str, str]


def v(prefix: str) -> V:
    return tuple(f"{prefix}{a}" for a in "xyz")


def minus(a: V, b: V) -> V:
    return tuple(f"({s}-{t})" for s, t in zip(a, b, strict=True))


def dot(a: V, b: V) -> str:
    return "(" + "+".join(f"{s}*{t}" for s, t in zip(a, b, strict=True)) + ")"


def cross(a: V, b: V) -> V:
    return tuple(f"({a[i]}*{b[j]}-{a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def size(a: V) -> str:
    return f"sqrt({dot(a, a)})"


def pair_ctes(field: str | None = None) -> str:
    """CTEs k1..k3 over ``pair`` (obs and facet columns): every part of the facet kernels.

    Result columns: om (solid angle), nx ny nz (unit normal), area, h, and for the edges 1..3
    l1..l3 (log term) with tx1.. (in-plane normal).
    """
    a, b, c, o = v("p"), v("q"), v("r"), ("x", "y", "z")
    n = cross(minus(b, a), minus(c, a))
    parts = [f"{e} AS {name}{k}" for k, vec in zip("abc", (a, b, c), strict=True) for name, e in zip(("rx", "ry", "rz"), minus(vec, o), strict=True)]
    parts += [f"{e} AS u{k}" for k, e in zip("xyz", n, strict=True)]
    edges = []
    for i, (s, t) in enumerate(((a, b), (b, c), (c, a)), 1):
        edges += [f"{e} AS e{k}{i}" for k, e in zip("xyz", minus(t, s), strict=True)]
    k1 = f"k1 AS (SELECT *, {', '.join(parts + edges)} FROM pair)"
    r = {k: tuple(f"{m}{k}" for m in ("rx", "ry", "rz")) for k in "abc"}
    lens = [f"{size(r[k])} AS len{k}" for k in "abc"] + [f"{size(('ux', 'uy', 'uz'))} AS area"] + [f"{size((f'ex{i}', f'ey{i}', f'ez{i}'))} AS le{i}" for i in (1, 2, 3)]
    k2 = f"k2 AS (SELECT *, {', '.join(lens)} FROM k1)"
    unit = [f"CASE WHEN area < 1e-15 THEN 0.0::DOUBLE ELSE u{k}/area END AS n{k}" for k in "xyz"]
    below = f"(lena*lenb*lenc+{dot(r['a'], r['b'])}*lenc+{dot(r['a'], r['c'])}*lenb+{dot(r['b'], r['c'])}*lena)"
    om = f"CASE WHEN least(lena,lenb,lenc) < 1e-15 THEN 0.0::DOUBLE ELSE 2*atan2({dot(r['a'], cross(r['b'], r['c']))}, {below}) END AS om"
    logs = []
    for i, (s, t) in enumerate((("a", "b"), ("b", "c"), ("c", "a")), 1):
        e = (f"ex{i}", f"ey{i}", f"ez{i}")
        up, lo = f"({dot(r[t], e)}/le{i}+len{t})", f"({dot(r[s], e)}/le{i}+len{s})"
        logs.append(f"CASE WHEN le{i} < 1e-15 THEN 0.0::DOUBLE WHEN abs({lo}) < 1e-15 OR {up} <= 0 OR {lo} <= 0 THEN 0.0::DOUBLE ELSE ln({up}/{lo}) END AS l{i}")
    k3 = f"k3 AS (SELECT *, {', '.join([*unit, om, *logs])} FROM k2)"
    tang = [f"CASE WHEN le{i} < 1e-15 THEN 0.0::DOUBLE ELSE {e}/le{i} END AS t{k}{i}" for i in (1, 2, 3) for k, e in zip("xyz", cross(("nx", "ny", "nz"), (f"ex{i}", f"ey{i}", f"ez{i}")), strict=True)]
    k4 = f"k4 AS (SELECT *, {dot(('rxa', 'rya', 'rza'), ('nx', 'ny', 'nz'))} AS h, {', '.join(tang)} FROM k3)"
    return ",\n".join([k1, k2, k3, k4])


def gravity_term() -> str:
    rim = "+".join(f"-{dot(tuple(f'{m}{k}' for m in ('rx', 'ry', 'rz')), (f'tx{i}', f'ty{i}', f'tz{i}'))}*l{i}" for i, k in ((1, "a"), (2, "b"), (3, "c")))
    return f"(nz*({rim}-h*om))"


def tmi_term(m: V, f: V, ascoded: bool = False) -> str:
    n = ("nx", "ny", "nz")
    t = [(f"tx{i}", f"ty{i}", f"tz{i}") for i in (1, 2, 3)]
    if ascoded:
        return f"({dot(m, n)}*{dot(f, n)}*om+" + "+".join(f"{dot(m, x)}*{dot(f, x)}*l{i}" for i, x in enumerate(t, 1)) + ")"
    return f"({dot(m, n)}*({dot(f, n)}*om+" + "+".join(f"{dot(f, x)}*l{i}" for i, x in enumerate(t, 1)) + "))"


def box_facets(name: str = "boxes", keep: str = "group_id, density, susceptibility", half: str = "half") -> str:
    """CTEs template and facets over a CTE of boxes."""
    from terralith.operators.forward import BOX_TRIANGLES, CORNERS

    rows = ", ".join("(" + ", ".join(map(str, [i, *[s for corner in t for s in corner]])) + ")" for i, t in enumerate(BOX_TRIANGLES))
    cols = ", ".join(f"c{c[1]} + s{c}*{half} AS {c}" for c in CORNERS)
    return f"template(t_id, {', '.join(f's{c}' for c in CORNERS)}) AS (VALUES {rows}),\nfacets AS (SELECT {keep}, t_id, {cols} FROM {name}, template)"


def mixture(source: str, columns: list[str], k: int, to: str, label: str = "label", rounds: int = 30) -> str:
    """CTEs that end in ``to``: the rows of ``source`` with the label of a Gaussian mixture by EM.

    One row of parameters a round (weights w, means m, covariances c), from sums over all rows;
    once a round changes the log-likelihood by less than 1e-6 a row, its parameters stay.
    """
    dims = range(len(columns))
    pairs = [(a, e) for a in dims for e in dims if a <= e]
    names = [f"w{j}" for j in range(k)] + [f"m{j}_{a}" for j in range(k) for a in dims] + [f"c{j}_{a}{e}" for j in range(k) for a, e in pairs]

    def log_density(j):
        x = [f"(z{a}-m{j}_{a})" for a in dims]
        if len(columns) == 1:
            det, square = f"c{j}_00", f"{x[0]}*{x[0]}/c{j}_00"
        else:
            det = f"(c{j}_00*c{j}_11-c{j}_01*c{j}_01)"
            square = f"(c{j}_11*{x[0]}*{x[0]}-2*c{j}_01*{x[0]}*{x[1]}+c{j}_00*{x[1]}*{x[1]})/{det}"
        return f"ln(w{j}+1e-300)-0.5*ln({det})-0.5*{square}"

    stats = ", ".join(f"avg({c}) AS a{a}, stddev_pop({c}) AS s{a}" for a, c in enumerate(columns))
    scaled = ", ".join(f"CASE WHEN s{a} > 0 THEN ({c}-a{a})/s{a} ELSE 0.0::DOUBLE END AS z{a}" for a, c in enumerate(columns))
    start = [f"{1 / k!r}::DOUBLE AS w{j}" for j in range(k)]
    start += [f"quantile_cont(z0, {(j + 0.5) / k!r}) AS m{j}_0" if a == 0 else f"0.0::DOUBLE AS m{j}_{a}" for j in range(k) for a in dims]
    start += [f"{float(a == e)}::DOUBLE AS c{j}_{a}{e}" for j in range(k) for a, e in pairs]
    logs = ", ".join(f"{log_density(j)} AS l{j}" for j in range(k))
    top = f"greatest({', '.join(f'l{j}' for j in range(k))})"
    parts = [f"{to}_s AS MATERIALIZED (SELECT {stats} FROM {source})", f"{to}_z AS MATERIALIZED (SELECT v.*, {scaled} FROM {source} v, {to}_s)",
             f"{to}_0 AS MATERIALIZED (SELECT {', '.join(start)}, '-inf'::DOUBLE AS score, false AS done FROM {to}_z)"]
    for r in range(rounds):
        sums = ["sum(norm) AS ll", "count(*) AS n"] + [f"greatest(sum(exp(l{j}-norm)), 1e-12) AS r{j}" for j in range(k)]
        sums += [f"sum(exp(l{j}-norm)*z{a}) AS t{j}_{a}" for j in range(k) for a in dims] + [f"sum(exp(l{j}-norm)*z{a}*z{e}) AS q{j}_{a}{e}" for j in range(k) for a, e in pairs]
        new = {f"w{j}": f"r{j}/n" for j in range(k)} | {f"m{j}_{a}": f"t{j}_{a}/r{j}" for j in range(k) for a in dims}
        new |= {f"c{j}_{a}{e}": f"q{j}_{a}{e}/r{j}-(t{j}_{a}/r{j})*(t{j}_{e}/r{j}){'+1e-6' if a == e else ''}" for j in range(k) for a, e in pairs}
        const = f"0.9189385332046727*{len(columns)}"
        parts.append(f"{to}_l{r} AS (SELECT *, {top}+ln({'+'.join(f'exp(l{j}-{top})' for j in range(k))})-{const} AS lognorm, {top}+ln({'+'.join(f'exp(l{j}-{top})' for j in range(k))}) AS norm FROM (SELECT z.*, {logs} FROM {to}_z z, {to}_{r}))")
        parts.append(f"{to}_a{r} AS MATERIALIZED (SELECT {', '.join(sums)}, sum(lognorm) AS full_ll FROM {to}_l{r})")
        kept = ", ".join(f"CASE WHEN done THEN {x} ELSE {new[x]} END AS {x}" for x in names)
        parts.append(f"{to}_{r + 1} AS MATERIALIZED (SELECT {kept}, CASE WHEN done THEN score ELSE full_ll END AS score, done OR abs(full_ll-score) < 1e-6*n AS done FROM {to}_{r}, {to}_a{r})")
    order = ", ".join(f"struct_pack(s := {log_density(j)}, r := {'+'.join(['1'] + [f'(m{i}_0 < m{j}_0 OR (m{i}_0 = m{j}_0 AND {i} < {j}))::INT' for i in range(k) if i != j])})" for j in range(k))
    drop = ", ".join(f"z{a}" for a in dims)
    parts.append(f"{to} AS MATERIALIZED (SELECT z.* EXCLUDE ({drop}), list_max([{order}]).r AS {label} FROM {to}_z z, {to}_{rounds})")
    return ",\n ".join(parts)
