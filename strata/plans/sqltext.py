"""SQL text for the DuckDB oracle of each registered query.

These strings are written independently of the DataFrame code (plain CASE
expressions, CTEs, window functions) so that the differential check compares
two formulations of the same semantics.
"""

from __future__ import annotations

from strata.sources.coded import coded_cte
from strata.spec import (ACTIVITY_GATEWAY, EXPENSE_COLS, FOUR_POINT, RESERVE_CODES,
                         STRAIN_LABELS, YES_NO, FWA_POS, FWA_NEG, ITE_POS, ITE_NEG)

RES = ", ".join(str(c) for c in RESERVE_CODES)
STRAIN = [c.lower() for c in STRAIN_LABELS]
ACTIVITY = [c.lower() for c in ACTIVITY_GATEWAY]
EXPENSES = [c.lower() for c in EXPENSE_COLS]
DEMOS = ["sex", "prv", "marstat", "famincg1"]
FEATURES = [*DEMOS, *ACTIVITY, *EXPENSES, "flexibility_score", "ite_score"]


def nul(c: str) -> str:
    return f"(CASE WHEN {c} IN ({RES}) THEN NULL ELSE {c} END)"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def recode_sql(e: str, m: dict, as_double: bool = True) -> str:
    whens = " ".join(f"WHEN {e} = {k} THEN {dbl(v) if as_double else int(v)}"
                     for k, v in m.items())
    return f"(CASE {whens} END)"


def flag(c: str) -> str:
    return recode_sql(nul(c), YES_NO, as_double=False)


def nn(exprs) -> str:
    return "(" + " + ".join(f"CAST({e} IS NOT NULL AS INTEGER)" for e in exprs) + ")"


def csum(exprs) -> str:
    return "(" + " + ".join(f"COALESCE({e}, 0)" for e in exprs) + ")"


def composite(pos, neg) -> str:
    p = [flag(c.lower()) for c in pos]
    return (f"CAST((CASE WHEN {nn(p)} >= 1 THEN {csum(p)} END) - "
            f"COALESCE({flag(neg.lower())}, 0) AS DOUBLE)")


FLEX = composite(FWA_POS, FWA_NEG)
ITE = composite(ITE_POS, ITE_NEG)


def strain_items(raw: bool = False) -> list[str]:
    out = []
    for c in STRAIN:
        if raw:
            out.append(f"CAST({nul(c)} AS DOUBLE)")
        else:
            out.append(recode_sql(nul(c), FOUR_POINT if c == "ics_40" else YES_NO))
    return out


def strain_score(raw: bool = False) -> str:
    items = strain_items(raw)
    return f"(CASE WHEN {nn(items)} > 0 THEN CAST({csum(items)} AS DOUBLE) / {nn(items)} END)"


def scored_cte(raw: bool = False) -> str:
    feats = ", ".join([*(f"{nul(c)} AS {c}" for c in [*DEMOS, *ACTIVITY, *EXPENSES])])
    return (f"scored AS (SELECT pumfid, {feats}, {FLEX} AS flexibility_score, "
            f"{ITE} AS ite_score, {strain_score(raw)} AS burnout_score, "
            f"CAST(wght_per AS DOUBLE) AS wght_per FROM coded)")


def threshold_sql(policy: str) -> str:
    if policy == "median":
        return "SELECT quantile_cont(burnout_score, 0.5) AS t FROM scored"
    if policy == "percentile_75":
        return "SELECT quantile_cont(burnout_score, 0.75) AS t FROM scored"
    return f"SELECT {dbl(float(policy.split('_', 1)[1]))} AS t"


def adf_cte(policy: str = "median", raw: bool = False) -> str:
    """``WITH coded, scored, thr, adf`` — the analysis frame in DuckDB."""
    cols = ", ".join(["s.pumfid", *(f"s.{c}" for c in FEATURES)])
    return (coded_cte().rstrip() + ",\n" + scored_cte(raw) + ",\n"
            f"thr AS ({threshold_sql(policy)}),\n"
            f"adf AS (SELECT {cols}, CAST(s.burnout_score >= thr.t AS INTEGER) AS burnout_high, "
            f"s.burnout_score, s.wght_per FROM scored s, thr "
            f"WHERE s.burnout_score IS NOT NULL)\n")


def pct(expr: str) -> str:
    """bround(x * 100, 1) twin."""
    return f"round_even(({expr}) * CAST(100 AS DOUBLE), 1)"


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE))"


def unpivot(src: str, cols, value_expr="{c}", extra: str = "") -> str:
    """UNION ALL of one SELECT per column: (variable, value[, extra])."""
    ex = f", {extra}" if extra else ""
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, {value_expr.format(c=c)} AS value{ex} FROM {src}"
        for c in cols)


def values_rows(rows) -> str:
    """VALUES list of (variable_name, code, label)."""
    def q(s):
        return "'" + str(s).replace("'", "''") + "'"
    return ", ".join(f"({q(v)}, {int(k)}, {q(lab)})" for v, k, lab in rows)
