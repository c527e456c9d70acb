"""SQL pieces for the checker: the proxy tables and the methods, stated plainly."""

from __future__ import annotations

from proxy.frames import ASSET_CODES, FUEL_CODES

# Fixed values throughout: questionnaire codes, bin limits and column names, which the check
# states on its own account.

# --- survey modules -------------------------------------------------------

_ASSET_ROWS = ", ".join(f"({p}, {c})" for p, c in enumerate(ASSET_CODES))
_FUEL_ROWS = ", ".join(f"({c})" for c in FUEL_CODES)
_WORK = ",\n    ".join(
    f"CASE WHEN (sk + {j}) % 41 = 0 THEN NULL ELSE CAST(1 + (pk + {j}) % 3 AS INT) END AS h8q{j}"
    for j in range(4, 16)
)

MODULES = {
    "gsec1": """SELECT o_orderkey AS HHID, CAST(n_regionkey AS INT) AS region,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS urban,
    CAST(MONTH(o_orderdate) AS INT) AS month, CAST(1 + o_orderkey % 7 AS DOUBLE) AS mult
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "gsec2": """SELECT l_orderkey AS HHID, l_linenumber AS PID,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS h2q3,
    CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 + l_linenumber % 4 END AS INT) AS h2q4,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 2 AS INT) END AS h2q8,
    CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(1 + l_partkey % 5 AS INT) END AS h2q10
  FROM lineitem""",
    "persons": """SELECT l_orderkey AS HHID, l_linenumber AS PID, MIN(l_partkey) AS pk,
    MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "gsec4": """SELECT HHID, PID,
    CASE WHEN pk % 31 = 0 THEN NULL ELSE CAST(1 + pk % 3 AS INT) END AS h4q5,
    CAST(CASE WHEN pk % 7 = 0 THEN 99 ELSE 10 * (1 + sk % 6) + pk % 7 END AS INT) AS h4q7,
    CAST(10 * (1 + pk % 6) + sk % 7 - 1 AS INT) AS h4q9 FROM persons""",
    "gsec8": f"SELECT HHID, PID,\n    {_WORK} FROM persons",
    "gsec9a": """SELECT o_orderkey AS HHID,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS h9q3,
    CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(1 + o_custkey % 9 AS INT) END AS h9q4,
    CAST(1 + o_custkey % 24 AS INT) AS h9q5,
    CAST(CASE WHEN o_custkey % 11 = 0 THEN 96 ELSE 1 + o_custkey % 7 END AS INT) AS h9q6,
    CAST(1 + o_orderkey % 8 AS INT) AS h9q7,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL
      ELSE CAST(1 + (o_orderkey + o_custkey) % 9 AS INT) END AS h9q22
  FROM orders""",
    "gsec10a": """SELECT o_orderkey AS HHID, CAST(1 + o_custkey % 2 AS INT) AS h10q1,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 2 AS INT) END AS h10q12
  FROM orders""",
    "gsec10b": f"""SELECT o_orderkey AS HHID, code AS h10q8_1,
    CASE WHEN (o_custkey + code) % 37 = 0 THEN NULL
      ELSE CAST(1 + (o_custkey * code) % 2 AS INT) END AS h10q8_2
  FROM orders CROSS JOIN (VALUES {_FUEL_ROWS}) AS f(code) WHERE (o_orderkey + code) % 5 <> 0""",
    "gsec14": f"""SELECT o_orderkey AS HHID, code AS h14q2,
    CASE WHEN (o_orderkey + pos) % 61 = 0 THEN NULL
      ELSE CAST(1 + (o_orderkey + pos) % 2 AS INT) END AS h14q3
  FROM orders CROSS JOIN (VALUES {_ASSET_ROWS}) AS a(pos, code)""",
    "consumption": """SELECT HHID, cpexp30, cpexp30 / 30 AS welfare,
    CASE WHEN cpexp30 < 100000 THEN 1 ELSE 0 END AS poor
  FROM (SELECT l_orderkey AS HHID,
          CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cpexp30
        FROM lineitem GROUP BY l_orderkey) s""",
}

# --- household blocks -----------------------------------------------------

_PAST_HEAD = """WHEN h4q5 = 2 AND h4q7 IN (2,10,11,12,13,14,15,16,99) THEN 0
      WHEN h4q5 = 2 AND h4q7 IN (17,31,32,33,41) THEN 1
      WHEN h4q5 = 2 AND h4q7 IN (34,35,36,21,22,23,51,61) THEN 2"""

BLOCKS = {
    "head_flags": """SELECT HHID, PID, h2q3 = 2 AS head_female, h2q8 AS head_age,
    COALESCE(h2q10 IN (1, 2), FALSE) AS head_married, h2q10 = 3 AS head_divorced,
    h2q10 = 4 AS head_widow, h2q10 <> 5 AS head_married_ever, h2q10 = 5 AS head_married_never
  FROM gsec2 WHERE h2q4 = 1""",
    "head_levels": f"""SELECT HHID, PID, CASE WHEN h4q5 = 1 THEN 0 {_PAST_HEAD}
      WHEN h4q5 = 3 AND h4q9 = 32 THEN 1 WHEN h4q5 = 3 AND h4q9 IN (34,50,61) THEN 2
      END AS lvl FROM gsec4""",
    "head_block": """SELECT f.HHID, f.head_female, f.head_age, f.head_married, f.head_divorced,
    f.head_widow, f.head_married_ever, f.head_married_never,
    e.lvl >= 1 AS head_educ_primary, e.lvl = 2 AS head_educ_secondary,
    (w.h8q5 = 1 OR w.h8q11 = 1) AS head_work_salary,
    (w.h8q7 = 1 OR w.h8q9 = 1) AS head_work_selfemployed, w.h8q13 = 1 AS head_work_farm,
    COALESCE(w.h8q15 = 1, FALSE) AS head_work_daily
  FROM head_flags f LEFT JOIN head_levels e ON e.HHID = f.HHID AND e.PID = f.PID
  LEFT JOIN gsec8 w ON w.HHID = f.HHID AND w.PID = f.PID""",
    "composition": "SELECT HHID, COUNT(*) AS hhsize, "
    + ", ".join(
        f"AVG(CASE WHEN h2q3 {'<>' if s == 'f' else '='} 1 AND h2q8 {lo} AND h2q8 <= {hi} "
        f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS shares_{s}_{a}"
        for s in "fm"
        for a, lo, hi in (
            ("5", ">= 0", 5),
            ("14", "> 5", 14),
            ("64", "> 14", 64),
            ("65", "> 64", 110),
        )
    )
    + " FROM gsec2 GROUP BY HHID",
    "education": """SELECT HHID, lvl >= 1 AS hh_educ_primary, lvl = 2 AS hh_educ_secondary FROM (
    SELECT HHID, COALESCE(MAX(lvl), -1) AS lvl FROM (
      SELECT HHID, CASE WHEN CAST(PID AS VARCHAR) = '115300270402' THEN 2 WHEN h4q5 = 1 THEN 0
        WHEN h4q5 = 2 AND h4q7 IN (2,10,11,12,13,14,15,16) THEN 0
        WHEN h4q5 = 2 AND h4q7 IN (17,31,32,33,41) THEN 1
        WHEN h4q5 = 2 AND h4q7 IN (34,35,36,21,22,23,51,61) THEN 2
        WHEN h4q5 = 3 AND h4q9 IN (1,10,11,12,13,14,15) THEN 0
        WHEN h4q5 = 3 AND h4q9 IN (16,17,30,31,32,40) THEN 1
        WHEN h4q5 = 3 AND h4q9 IN (33,34,35,50,61) THEN 2
        WHEN h4q5 IS NULL AND h4q9 = 15 THEN 0 END AS lvl FROM gsec4) a GROUP BY HHID) b""",
    "housing": """SELECT HHID, COALESCE(h9q7 IN (1,2), FALSE) AS water_piped,
    COALESCE(h9q7 IN (4,5), FALSE) AS water_well,
    COALESCE(h9q22 IN (6,7), FALSE) AS toilet_flush,
    COALESCE(h9q22 IN (1,2,3,4,5), FALSE) AS toilet_pit,
    COALESCE(h9q4 IN (1,2), FALSE) AS roof_natural,
    COALESCE(h9q4 IN (3,4), FALSE) AS roof_rudimentary,
    COALESCE(h9q4 IN (5,6,7,8), FALSE) AS roof_finished,
    COALESCE(h9q5 IN (1,2), FALSE) AS wall_natural,
    COALESCE(h9q5 IN (3,4,5), FALSE) AS wall_rudimentary,
    COALESCE(h9q5 IN (6,7,8,24), FALSE) AS wall_finished,
    COALESCE(h9q6 IN (1,2), FALSE) AS floor_natural,
    COALESCE(h9q6 IN (3), FALSE) AS floor_rudimentary,
    COALESCE(h9q6 IN (4,5,6,96), FALSE) AS floor_finished, h9q3 AS rooms FROM gsec9a""",
    "fuel_use": "SELECT HHID, "
    + ", ".join(
        f"CASE WHEN COUNT(*) FILTER (h10q8_1 IN ({c}) AND h10q8_2 = 1) > 0 THEN TRUE "
        f"WHEN COUNT(*) FILTER (h10q8_1 IN ({c}) AND h10q8_2 IS NULL) > 0 THEN NULL "
        f"ELSE FALSE END AS fuel_{f}"
        for f, c in (("electric_gas", "1,2"), ("wood", "4,5"), ("coal", "6"))
    )
    + " FROM gsec10b GROUP BY HHID",
    "stove_any": """SELECT HHID, CASE WHEN BOOL_OR(s) THEN TRUE
      WHEN COUNT(*) FILTER (s IS NULL) > 0 THEN NULL ELSE FALSE END AS stove_any
    FROM (SELECT HHID, COALESCE(h10q8_1 IN (1,2,3,4,5,6,7), FALSE) AND h10q8_2 = 1 AS s
          FROM gsec10b) a GROUP BY HHID""",
    "power": "SELECT HHID, h10q1 = 1 AS electricity, h10q12 = 1 AS kitchen_room FROM gsec10a",
    "assets": "SELECT HHID, "
    + ", ".join(
        f"CASE MIN(CASE WHEN h14q2 = {c} THEN h14q3 END) WHEN 1 THEN TRUE WHEN 2 THEN FALSE "
        f"END AS {a}"
        for c, a in (
            (7, "radio"), (6, "television"), (10, "bicycle"), (11, "motorbike"), (12, "car"),
            (16, "mobile_phone"), (17, "computer"), (5, "iron"), (8, "generator"),
            (1, "own_house"),
        )
    )
    + " FROM gsec14 GROUP BY HHID",
    "merged": """SELECT * FROM gsec1 FULL JOIN assets USING (HHID)
    FULL JOIN composition USING (HHID) FULL JOIN education USING (HHID)
    FULL JOIN fuel_use USING (HHID) FULL JOIN stove_any USING (HHID)
    FULL JOIN power USING (HHID) FULL JOIN housing USING (HHID)
    FULL JOIN consumption USING (HHID) FULL JOIN head_block USING (HHID)""",
}

# --- modelling sample -----------------------------------------------------

HH = {
    "member": """SELECT l_orderkey AS hhid, l_linenumber AS pid,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sex,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 2 AS INT) END AS age,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS spend FROM lineitem""",
    "comp": """SELECT hhid, CAST(COUNT(*) AS INT) AS hhsize, CAST(SUM(spend) AS DOUBLE) AS cpexp30,
    AVG(CASE WHEN sex = 2 AND age >= 0 AND age <= 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
      AS shares_f_5,
    AVG(CASE WHEN sex = 1 AND age > 14 AND age <= 64 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
      AS shares_m_64 FROM member GROUP BY hhid""",
    "head": """SELECT hhid, MIN(age) AS head_age, MIN(sex) AS head_sex FROM member
    WHERE pid = 1 GROUP BY hhid""",
    "base": """SELECT o.o_orderkey AS hhid, n.n_regionkey AS region,
    CAST(MONTH(o.o_orderdate) AS INT) AS month, CAST(1 + o.o_orderkey % 7 AS DOUBLE) AS mult,
    o.o_orderpriority AS roof
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "hh": """SELECT b.hhid, b.region, b.month, b.mult, b.roof, c.hhsize, c.shares_f_5, c.shares_m_64,
    h.head_age, h.head_sex = 2 AS head_female, c.cpexp30, c.cpexp30 / c.hhsize * 12 AS cpp
  FROM base b LEFT JOIN comp c ON c.hhid = b.hhid LEFT JOIN head h ON h.hhid = b.hhid""",
    "mf": """SELECT *, LN(hhsize) AS x1, shares_m_64 AS x2, LN(cpexp30) AS ln_y
  FROM hh WHERE hhsize IS NOT NULL""",
}

_ALL = {**MODULES, **BLOCKS, **HH}
_NEEDS = {
    "gsec4": ["persons"], "gsec8": ["persons"], "head_flags": ["gsec2"], "head_levels": ["gsec4"],
    "head_block": ["head_flags", "head_levels", "gsec8"], "composition": ["gsec2"],
    "education": ["gsec4"], "housing": ["gsec9a"], "fuel_use": ["gsec10b"],
    "stove_any": ["gsec10b"], "power": ["gsec10a"], "assets": ["gsec14"],
    "merged": ["gsec1", "assets", "composition", "education", "fuel_use", "stove_any", "power",
               "housing", "consumption", "head_block"],
    "comp": ["member"], "head": ["member"], "hh": ["base", "comp", "head"], "mf": ["hh"],
}


def _closure(name: str, seen: list[str]) -> None:
    for need in _NEEDS.get(name, []):
        _closure(need, seen)
    if name not in seen:
        seen.append(name)


def query(base: str, ctes: dict[str, str], select: str) -> str:
    """WITH the named proxy table and what it needs, further CTEs, and a select."""
    names: list[str] = []
    for b in base.split():
        _closure(b, names)
    parts = [f"{n} AS MATERIALIZED ({_ALL[n]})" for n in names]
    parts += [f"{n} AS MATERIALIZED ({c})" for n, c in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- methods --------------------------------------------------------------


def quantile_ctes(name: str, source: str, x: str, w: str, qs, by: str = "") -> dict[str, str]:
    """Weighted quantiles of ``source``: CTE ``name`` with (by), q and value."""
    p = f"PARTITION BY {by} " if by else ""
    b, group = (f"{by}, ", f"{by}, ") if by else ("", "")
    same = f"s.{by} = e.{by}" if by else "TRUE"
    values = ", ".join(f"({q})" for q in qs)
    return {
        f"{name}_pts": f"""SELECT {b}{x} AS x,
      SUM({w}) OVER ({p}ORDER BY {x}, hhid ROWS UNBOUNDED PRECEDING) AS cw FROM {source}""",
        f"{name}_col": f"SELECT {b}cw, MIN(x) AS x FROM {name}_pts GROUP BY {group}cw",
        f"{name}_seg": f"""SELECT {b}cw, x, LAG(cw) OVER ({p}ORDER BY cw) AS pcw,
      LAG(x) OVER ({p}ORDER BY cw) AS px FROM {name}_col""",
        f"{name}_ext": f"""SELECT {b}MIN(x) AS mn, MAX(x) AS mx, MIN(cw) AS lo, MAX(cw) AS hi
      FROM {name}_pts""" + (f" GROUP BY {by}" if by else ""),
        name: f"""SELECT {'e.' + by + ', ' if by else ''}v.q, CASE WHEN v.q * e.hi <= e.lo THEN e.mn
      ELSE (SELECT MAX(CASE WHEN v.q * e.hi >= s.cw - 1e-9 THEN s.x
                   ELSE s.px + (s.x - s.px) * (v.q * e.hi - s.pcw) / (s.cw - s.pcw) END)
            FROM {name}_seg s WHERE {same} AND s.pcw < v.q * e.hi - 1e-9
              AND v.q * e.hi - 1e-9 <= s.cw) END AS value
      FROM {name}_ext e CROSS JOIN (VALUES {values}) AS v(q)""",
    }


def wls_ctes(name: str, source: str, w: str, by: str = "", y: str = "ln_y") -> dict[str, str]:
    """Two-regressor weighted least squares in closed form: CTE ``name`` with b0, b1, b2."""
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    using = f"JOIN {name}_m USING ({by})" if by else f"CROSS JOIN {name}_m"
    return {
        f"{name}_m": f"""SELECT {b}COUNT(*) AS n, SUM({w}) AS sw, SUM({w}*x1)/SUM({w}) AS m1,
      SUM({w}*x2)/SUM({w}) AS m2, SUM({w}*{y})/SUM({w}) AS my FROM {source}{g}""",
        f"{name}_s": f"""SELECT {b}SUM({w}*(x1-m1)*(x1-m1)) AS s11, SUM({w}*(x1-m1)*(x2-m2)) AS s12,
      SUM({w}*(x2-m2)*(x2-m2)) AS s22, SUM({w}*(x1-m1)*({y}-my)) AS s1y,
      SUM({w}*(x2-m2)*({y}-my)) AS s2y, ANY_VALUE(m1) AS m1, ANY_VALUE(m2) AS m2,
      ANY_VALUE(my) AS my, ANY_VALUE(n) AS n, ANY_VALUE(sw) AS sw FROM {source} {using}{g}""",
        name: f"""SELECT {b}n, sw, my - b1*m1 - b2*m2 AS b0, b1, b2 FROM (
      SELECT *, (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) AS b1,
        (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) AS b2 FROM {name}_s) t""",
    }


def targeting(y: str = "y", yhat: str = "yhat", z: str = "z", zhat: str = "zhat", w: str = "w"):
    """The four measures as aggregate expressions, six digits."""

    def part(cond: str) -> str:
        return f"SUM(CASE WHEN {cond} THEN {w} ELSE 0 END)"

    poor, chosen = part(f"{y} <= {z}"), part(f"{yhat} <= {z}")
    return f"""ROUND({chosen} / SUM({w}), 6) AS H,
    ROUND({part(f'{y} > {z} AND {yhat} <= {z}')} / NULLIF({chosen}, 0), 6) AS IER,
    ROUND({part(f'{y} <= {z} AND {yhat} > {z}')} / NULLIF({poor}, 0), 6) AS EER,
    ROUND({part(f'{y} <= {z} AND {yhat} > {zhat}')} / NULLIF({poor}, 0), 6) AS TER"""


def hashed(seed: int, replicate: str | None = None) -> str:
    parts = f"CAST(hhid AS VARCHAR), '{seed}'" + (
        f", CAST({replicate} AS VARCHAR)" if replicate else ""
    )
    return f"MD5(CONCAT_WS(':', {parts}))"


def half_cte(source: str, seed: int) -> str:
    return f"""SELECT *, ROW_NUMBER() OVER (ORDER BY {hashed(seed)}, hhid)
      <= ROUND_EVEN((SELECT COUNT(*) FROM {source}) * 0.5, 0) AS test FROM {source}"""


def replicates_cte(source: str, seed: int, n: int) -> str:
    key = f"SUBSTR({hashed(seed, '(r.replicate - 1) // 4')}, 1 + 8 * ((r.replicate - 1) % 4), 8)"
    return f"""SELECT s.*, r.replicate,
      ROW_NUMBER() OVER (PARTITION BY r.replicate ORDER BY {key}, hhid)
        <= ROUND_EVEN((SELECT COUNT(*) FROM {source}) * 0.5, 0) AS test
      FROM {source} s CROSS JOIN (SELECT CAST(i AS INT) AS replicate FROM range(1, {n + 1}) t(i)) r"""
