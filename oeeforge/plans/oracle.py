"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: the row index is a plain
``row_number()`` per file, duplicates a ``count(*) over`` window, findings a
``UNION ALL`` of one SELECT per rule. Tables ``lineitem`` and ``part`` are
pre-registered views. Decimal literals are written as doubles (``1.0e0``).
"""

from __future__ import annotations

from oeeforge.operators.questions import INTENT_RULES

# --- staged production view, quality findings, history -----------------------
_VIEW = """
v1 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    concat('WH/MO/', l_orderkey, '_', l_linenumber) AS code_of,
    concat('[', p_brand, '] - ', p_type) AS produit,
    concat('Atelier ', l_suppkey % 5) AS atelier,
    concat('Machine N°', l_suppkey) AS machine,
    CASE WHEN l_orderkey % 41 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS qte_produite,
    120.0e0 + l_linenumber * 30 + l_quantity AS duree_totale_min,
    CASE WHEN l_orderkey % 211 = 0 THEN -5.0e0 ELSE (l_partkey % 60) * 1.0e0 END AS duree_arrets_min,
    (10 + p_size) * 1.0e0 AS ctb,
    concat('export_', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR)) AS source_file
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
v2 AS (
  SELECT *,
    CASE WHEN l_orderkey % 53 = 0 THEN duree_totale_min - duree_arrets_min + 2.0e0
         ELSE duree_totale_min - duree_arrets_min END AS temps_net_min,
    CASE WHEN l_orderkey % 193 = 0 THEN 0.0e0 WHEN l_orderkey % 97 = 0 THEN 0.03e0 ELSE ctb END AS cadence_theorique,
    CASE WHEN l_orderkey % 41 = 0 OR l_orderkey % 89 = 0 THEN NULL
         ELSE ctb * (floor(l_discount * 100 + 0.5e0) * 5 + 60) / 100.0e0 END AS cadence_reelle,
    100.0e0 - floor(l_tax * 100 + 0.5e0) * 0.5e0 AS qualite_pct
  FROM v1
),
v3 AS (
  SELECT *,
    CASE WHEN cadence_theorique = 0 THEN NULL
         WHEN l_orderkey % 71 = 0 THEN (cadence_reelle - cadence_theorique) / cadence_theorique * 100.0e0 + 3.0e0
         ELSE (cadence_reelle - cadence_theorique) / cadence_theorique * 100.0e0 END AS ecart_pct,
    100.0e0 * temps_net_min / duree_totale_min AS disponibilite_pct,
    CASE WHEN cadence_theorique = 0 THEN NULL WHEN cadence_reelle IS NULL THEN 0.0e0
         ELSE cadence_reelle / cadence_theorique * 100.0e0 END AS performance_pct
  FROM v2
),
v AS (
  SELECT *,
    CASE WHEN l_orderkey % 61 = 0 THEN disponibilite_pct * performance_pct * qualite_pct / 10000.0e0 + 5.0e0
         ELSE disponibilite_pct * performance_pct * qualite_pct / 10000.0e0 END AS trs_pct,
    CAST(row_number() OVER (PARTITION BY source_file
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS row_index,
    count(*) OVER (PARTITION BY source_file, code_of, machine) AS dup_n
  FROM v3
)"""

_FINDINGS = """
findings AS (
  SELECT source_file, row_index, code_of, machine, 'missing_value' AS rule,
         CASE WHEN qte_produite = 0 THEN 'INFO' ELSE 'AVERTISSEMENT' END AS severity,
         'Cadence Réelle (pcs/min)' AS "column" FROM v WHERE cadence_reelle IS NULL
  UNION ALL SELECT source_file, row_index, code_of, machine, 'duplicate_key', 'BLOQUANT', NULL FROM v WHERE dup_n > 1
  UNION ALL SELECT source_file, row_index, code_of, machine, 'temps_net_formula', 'AVERTISSEMENT', 'Temps Net (min)'
    FROM v WHERE abs(duree_totale_min - duree_arrets_min - temps_net_min) > 0.5e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'ecart_formula', 'AVERTISSEMENT', 'Écart (%)'
    FROM v WHERE cadence_theorique <> 0
     AND abs((cadence_reelle - cadence_theorique) / cadence_theorique * 100.0e0 - ecart_pct) > 1.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'trs_formula', 'AVERTISSEMENT', 'TRS (%)'
    FROM v WHERE abs(disponibilite_pct * performance_pct * qualite_pct / 10000.0e0 - trs_pct) > 1.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'percentage_out_of_bounds', 'BLOQUANT', 'Disponibilité (%)'
    FROM v WHERE disponibilite_pct < -1.0e0 OR disponibilite_pct > 101.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'percentage_out_of_bounds', 'BLOQUANT', 'Qualité (%)'
    FROM v WHERE qualite_pct < -1.0e0 OR qualite_pct > 101.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'percentage_ceiling_exceeded',
         CASE WHEN performance_pct > 120.0e0 THEN 'BLOQUANT' ELSE 'AVERTISSEMENT' END, 'Performance (%)'
    FROM v WHERE performance_pct > 100.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'percentage_ceiling_exceeded',
         CASE WHEN trs_pct > 120.0e0 THEN 'BLOQUANT' ELSE 'AVERTISSEMENT' END, 'TRS (%)'
    FROM v WHERE trs_pct > 100.0e0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'negative_value', 'BLOQUANT', 'Qté Produite' FROM v WHERE qte_produite < 0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'negative_value', 'BLOQUANT', 'Durée Totale (min)' FROM v WHERE duree_totale_min < 0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'negative_value', 'BLOQUANT', 'Durée Arrêts (min)' FROM v WHERE duree_arrets_min < 0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'negative_value', 'BLOQUANT', 'Temps Net (min)' FROM v WHERE temps_net_min < 0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'negative_value', 'BLOQUANT', 'Cadence Théorique (pcs/min)' FROM v WHERE cadence_theorique < 0
  UNION ALL SELECT source_file, row_index, code_of, machine, 'suspicious_low_cadence_theorique', 'AVERTISSEMENT', 'Cadence Théorique (pcs/min)'
    FROM v WHERE cadence_theorique > 0 AND cadence_theorique < 0.5e0
),
row_sev AS (
  SELECT source_file, row_index, count(*) AS n_findings,
         max(CASE severity WHEN 'BLOQUANT' THEN 3 WHEN 'AVERTISSEMENT' THEN 2 ELSE 1 END) AS sev_rank
  FROM findings GROUP BY source_file, row_index
),
checked AS (
  SELECT v.*, coalesce(r.n_findings, 0) AS n_findings,
         CASE r.sev_rank WHEN 3 THEN 'BLOQUANT' WHEN 2 THEN 'AVERTISSEMENT' WHEN 1 THEN 'INFO' END AS quality_severity
  FROM v LEFT JOIN row_sev r ON v.source_file = r.source_file AND v.row_index = r.row_index
),
hist AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY code_of, machine ORDER BY source_file, row_index) AS first_rn
    FROM checked WHERE code_of IS NOT NULL AND machine IS NOT NULL
  ) WHERE first_rn = 1
)"""


def mean(expr: str, where: str | None = None) -> str:
    """Mean from a sum in exact limbs, as DOUBLE (the same places and order as ``functions.columns.exact_mean``)."""
    f = f" FILTER (WHERE {where})" if where else ""
    x = f"CAST({expr} AS DOUBLE)"
    at = lambda unit: f"round_even({x} * {2.0 ** -unit!r}, 0)"
    limbs = [at(24)] + [f"{at(u)} - {at(u + 24)} * 16777216.0e0" for u in (0, -24, -48, -72, -96)]
    totals = [f"CAST(sum(CAST({limb} AS BIGINT)){f} AS DOUBLE) * {2.0 ** u!r}" for limb, u in zip(limbs, (24, 0, -24, -48, -72, -96))]
    whole = totals[-1]
    for t in reversed(totals[:-1]):
        whole = f"({whole} + {t})"
    return f"({whole} / CAST(count({expr}){f} AS DOUBLE))"


def r4(expr: str) -> str:
    """Half-up rounding to 4 dp in IEEE arithmetic (matches ``round_half_up``)."""
    return f"(floor(({expr}) * 10000.0e0 + 0.5e0) / 10000.0e0)"


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = _VIEW + "," + _FINDINGS + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + body


_NB = "quality_severity IS DISTINCT FROM 'BLOQUANT'"

_METRICS = f"""
metrics AS (
  SELECT produit, machine,
    count(*) FILTER (WHERE {_NB}) AS n_of,
    count(*) FILTER (WHERE quality_severity = 'BLOQUANT') AS n_excluded_bloquant,
    {mean("cadence_theorique", _NB)} AS cadence_theorique_moy,
    {mean("cadence_reelle", _NB)} AS cadence_reelle_moy,
    min(cadence_reelle) FILTER (WHERE {_NB}) AS cadence_reelle_min,
    max(cadence_reelle) FILTER (WHERE {_NB}) AS cadence_reelle_max,
    {mean("ecart_pct", _NB)} AS ecart_moy,
    {mean("trs_pct", _NB)} AS trs_moy,
    {mean("performance_pct", _NB)} AS performance_moy,
    {mean("disponibilite_pct", _NB)} AS disponibilite_moy,
    {mean("qualite_pct", _NB)} AS qualite_moy,
    CASE WHEN count(cadence_reelle) FILTER (WHERE {_NB}) >= 2 AND {mean("cadence_reelle", _NB)} <> 0
         THEN stddev_samp(cadence_reelle) FILTER (WHERE {_NB}) / {mean("cadence_reelle", _NB)} * 100.0e0
    END AS stabilite_cv
  FROM hist WHERE produit IS NOT NULL AND machine IS NOT NULL
  GROUP BY produit, machine
  HAVING count(*) FILTER (WHERE {_NB}) > 0
)"""

ORACLE: dict[str, str] = {
    "quality_findings": with_base(
        'SELECT source_file, row_index, code_of, machine, rule, severity, "column" FROM findings'
    ),
    "quality_counts": with_base(
        """SELECT source_file, 'BLOQUANT' AS severity, CAST(nb AS BIGINT) AS n_findings FROM per_file
UNION ALL SELECT source_file, 'AVERTISSEMENT', CAST(na AS BIGINT) FROM per_file
UNION ALL SELECT source_file, 'INFO', CAST(ni AS BIGINT) FROM per_file""",
        """per_file AS (
  SELECT f.source_file,
    count(x.rule) FILTER (WHERE x.severity = 'BLOQUANT') AS nb,
    count(x.rule) FILTER (WHERE x.severity = 'AVERTISSEMENT') AS na,
    count(x.rule) FILTER (WHERE x.severity = 'INFO') AS ni
  FROM (SELECT DISTINCT source_file FROM v) f LEFT JOIN findings x ON x.source_file = f.source_file
  GROUP BY f.source_file
)""",
    ),
    "row_severity": with_base(
        "SELECT source_file, row_index, code_of, machine, quality_severity, CAST(n_findings AS INTEGER) AS n_findings FROM checked"
    ),
    "couple_metrics": with_base(
        "SELECT produit, machine, n_of, n_excluded_bloquant, "
        + ", ".join(f"{r4(c)} AS {c}" for c in (
            "cadence_theorique_moy", "cadence_reelle_moy", "cadence_reelle_min", "cadence_reelle_max", "ecart_moy",
            "trs_moy", "performance_moy", "disponibilite_moy", "qualite_moy", "stabilite_cv"))
        + " FROM metrics",
        _METRICS,
    ),
    "conclusions": with_base(
        """SELECT produit, machine, CASE WHEN codes = '' THEN 'NOTHING_NOTABLE' ELSE codes END AS conclusion_codes
FROM (SELECT produit, machine, concat_ws(',',
    CASE WHEN n_of < 3 THEN 'LIMITED_HISTORY' END,
    CASE WHEN n_excluded_bloquant > 0 THEN 'EXCLUDED_BLOCKING' END,
    CASE WHEN trs_moy IS NULL THEN NULL WHEN trs_moy < 50.0e0 THEN 'TRS_LOW' WHEN trs_moy < 75.0e0 THEN 'TRS_MODERATE' ELSE 'TRS_GOOD' END,
    CASE WHEN stabilite_cv IS NULL THEN NULL WHEN stabilite_cv > 30.0e0 THEN 'UNSTABLE' ELSE 'STABLE' END) AS codes
  FROM metrics)""",
        _METRICS,
    ),
}


# --- second batch --------------------------------------------------------------
_DATA_COLS = [
    "code_of", "produit", "atelier", "machine", "qte_produite", "duree_totale_min", "duree_arrets_min",
    "temps_net_min", "cadence_reelle", "cadence_theorique", "ecart_pct", "disponibilite_pct", "performance_pct",
    "qualite_pct", "trs_pct",
]
_PROFILE_COLS = [*_DATA_COLS, "source_file"]
_CELLS = "cells AS (\n" + "\n  UNION ALL ".join(
    f"SELECT {i} AS pos, '{'_source_file' if c == 'source_file' else c}' AS col, CAST({c} AS VARCHAR) AS value, "
    "source_file AS f, row_index AS ri FROM v"
    for i, c in enumerate(_PROFILE_COLS)
) + "\n)"

_WORK = f"""
work AS (SELECT * FROM hist WHERE produit IS NOT NULL AND machine IS NOT NULL AND {_NB}),
stats AS (
  SELECT produit, machine, count(*) AS n_of,
    count(cadence_reelle) AS nr, {mean("cadence_reelle")} AS mr, stddev_samp(cadence_reelle) AS sr,
    count(trs_pct) AS nt, {mean("trs_pct")} AS mt, stddev_samp(trs_pct) AS st
  FROM work GROUP BY produit, machine
),
outl AS (
  SELECT w.code_of, w.produit, w.machine, 'cadence_reelle' AS metric, w.cadence_reelle AS value,
         s.mr AS group_mean, s.sr AS group_std, (w.cadence_reelle - s.mr) / s.sr AS z_score
  FROM work w JOIN stats s ON w.produit = s.produit AND w.machine = s.machine
  WHERE s.n_of >= 3 AND s.nr >= 3 AND s.sr IS NOT NULL AND s.sr <> 0 AND w.cadence_reelle IS NOT NULL
    AND abs((w.cadence_reelle - s.mr) / s.sr) > 2.0e0
  UNION ALL
  SELECT w.code_of, w.produit, w.machine, 'trs_pct', w.trs_pct, s.mt, s.st, (w.trs_pct - s.mt) / s.st
  FROM work w JOIN stats s ON w.produit = s.produit AND w.machine = s.machine
  WHERE s.n_of >= 3 AND s.nt >= 3 AND s.st IS NOT NULL AND s.st <> 0 AND w.trs_pct IS NOT NULL
    AND abs((w.trs_pct - s.mt) / s.st) > 2.0e0
)"""

_RECS = _WORK + f""",
rrows AS (
  SELECT h.*, (h.code_of NOT IN (SELECT code_of FROM outl)) AND h.{_NB} AS usable
  FROM hist h WHERE h.produit IS NOT NULL AND h.machine IS NOT NULL
),
rcounts AS (
  SELECT produit, machine, count(*) AS n_of_disponibles, count(*) FILTER (WHERE usable) AS n_of_utilises,
         {mean("cadence_theorique")} AS theo
  FROM rrows GROUP BY produit, machine
),
rtop AS (
  SELECT produit, machine, count(*) AS n_ref, {mean("cadence_reelle")} AS rec, {mean("trs_pct")} AS trs_ref
  FROM (SELECT *, row_number() OVER (PARTITION BY produit, machine ORDER BY trs_pct DESC, code_of) AS rk
        FROM rrows WHERE usable AND trs_pct IS NOT NULL AND cadence_reelle IS NOT NULL)
  WHERE rk <= 3 GROUP BY produit, machine
),
recs AS (
  SELECT c.produit, c.machine, (c.n_of_utilises >= 3 AND t.n_ref IS NOT NULL) AS fiable,
    c.n_of_disponibles, c.n_of_utilises, c.theo AS cadence_theorique_actuelle, t.n_ref, t.rec, t.trs_ref
  FROM rcounts c LEFT JOIN rtop t ON c.produit = t.produit AND c.machine = t.machine
),
recs2 AS (
  SELECT produit, machine, fiable, n_of_disponibles, n_of_utilises,
    CASE WHEN fiable THEN n_ref ELSE 0 END AS n_of_reference,
    cadence_theorique_actuelle,
    CASE WHEN fiable THEN rec END AS cadence_recommandee,
    CASE WHEN fiable THEN trs_ref END AS trs_moyen_reference,
    CASE WHEN fiable AND cadence_theorique_actuelle IS NOT NULL AND cadence_theorique_actuelle <> 0
         THEN (rec - cadence_theorique_actuelle) / cadence_theorique_actuelle * 100.0e0 END AS ecart_vs_theorique_pct
  FROM recs
),
recs3 AS (
  SELECT *, CASE WHEN NOT fiable THEN 'INSUFFICIENT_HISTORY'
      WHEN ecart_vs_theorique_pct IS NULL THEN 'NO_THEORETICAL_REFERENCE'
      WHEN floor(ecart_vs_theorique_pct * 10.0e0 + 0.5e0) / 10.0e0 > 5 THEN 'ABOVE_THEORETICAL'
      WHEN floor(ecart_vs_theorique_pct * 10.0e0 + 0.5e0) / 10.0e0 < -5 THEN 'BELOW_THEORETICAL'
      ELSE 'CLOSE_TO_THEORETICAL' END AS justification_code
  FROM recs2
)"""

_BLOCKED = """
blk AS (SELECT * FROM hist WHERE quality_severity = 'BLOQUANT'),
blkf AS (
  SELECT b.source_file, b.row_index, b.code_of, b.machine, b.produit, x.rule, x."column"
  FROM blk b JOIN findings x ON x.source_file = b.source_file AND x.row_index = b.row_index
  WHERE x.severity = 'BLOQUANT'
)"""

ORACLE.update({
    "formula_audit": with_base(
        f"""SELECT formula, tolerance, CAST(n_bad AS BIGINT) AS n_bad, CAST(n_total AS BIGINT) AS n_total,
  {r4("CASE WHEN n_total > 0 THEN n_bad * 100.0e0 / n_total END")} AS pct_bad
FROM (
  SELECT 'temps_net' AS formula, 0.5e0 AS tolerance,
    count(*) FILTER (WHERE abs(duree_totale_min - duree_arrets_min - temps_net_min) > 0.5e0) AS n_bad, count(*) AS n_total FROM v
  UNION ALL SELECT 'ecart', 1.0e0,
    count(*) FILTER (WHERE cadence_theorique IS DISTINCT FROM 0.0e0
      AND abs((cadence_reelle - cadence_theorique) / cadence_theorique * 100.0e0 - ecart_pct) > 1.0e0),
    count(*) FILTER (WHERE cadence_theorique IS DISTINCT FROM 0.0e0) FROM v
  UNION ALL SELECT 'trs', 1.0e0,
    count(*) FILTER (WHERE abs(disponibilite_pct * performance_pct * qualite_pct / 10000.0e0 - trs_pct) > 1.0e0),
    count(*) FROM v
)"""
    ),
    "duplicate_keys": with_base(
        """SELECT source_file, CAST(sum(n - 1) AS BIGINT) AS n_duplicate_rows, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_duplicated_keys
FROM (SELECT source_file, code_of, machine, count(*) AS n FROM v GROUP BY source_file, code_of, machine)
GROUP BY source_file"""
    ),
    "column_profile": with_base(
        f"""SELECT t.pos, t.col AS "column", t.n_missing, {r4("t.n_missing * 100.0e0 / t.n_total")} AS pct_missing,
  coalesce(u.n_unique, 0) AS n_unique, s.sample_values, (coalesce(u.n_unique, 0) > 0 AND coalesce(u.n_unique, 0) <= 50) AS is_candidate_dimension
FROM (SELECT pos, col, count(*) AS n_total, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM cells GROUP BY pos, col) t
LEFT JOIN (SELECT pos, count(*) AS n_unique FROM firsts GROUP BY pos) u ON u.pos = t.pos
LEFT JOIN (SELECT pos, string_agg(value, ', ' ORDER BY f, ri) AS sample_values
           FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY f, ri) AS k FROM firsts) WHERE k <= 5
           GROUP BY pos) s ON s.pos = t.pos""",
        _CELLS + """,
firsts AS (
  SELECT pos, value, f, ri FROM (
    SELECT pos, value, f, ri, row_number() OVER (PARTITION BY pos, value ORDER BY f, ri) AS rn
    FROM cells WHERE value IS NOT NULL) WHERE rn = 1
)""",
    ),
    "missing_actual_rate": with_base(
        "SELECT source_file, row_index, code_of, machine, produit, qte_produite FROM v WHERE cadence_reelle IS NULL"
    ),
    "load_dedup": with_base(
        "SELECT code_of, produit, atelier, machine, qte_produite, "
        + ", ".join(f"{r4(c)} AS {c}" for c in _DATA_COLS[5:])
        + ", quality_severity, source_file, row_index FROM hist"
    ),
    "load_incremental": with_base(
        """SELECT * FROM (
  WITH f1 AS (SELECT code_of, machine, source_file, row_index FROM v
              WHERE code_of IS NOT NULL AND machine IS NOT NULL AND ascii(right(source_file, 1)) % 2 = 1
              QUALIFY row_number() OVER (PARTITION BY code_of, machine ORDER BY source_file, row_index) = 1),
       f2 AS (SELECT code_of, machine, source_file, row_index FROM v WHERE code_of IS NOT NULL AND machine IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY code_of, machine ORDER BY source_file, row_index) = 1)
  SELECT 'b1' AS batch_id, * FROM f1
  UNION ALL SELECT 'b2' AS batch_id, * FROM f2
  WHERE NOT EXISTS (SELECT 1 FROM f1 WHERE f1.code_of = f2.code_of AND f1.machine = f2.machine)) t"""
    ),
    "import_log": with_base(
        """SELECT e.source_file, e.n AS n_rows_extracted, coalesce(i.n, 0) AS n_rows_inserted,
  e.n - coalesce(i.n, 0) - e.nk AS n_rows_skipped_duplicate, e.nk AS n_rows_rejected_null_key,
  coalesce(x.nb, 0) AS n_bloquant, coalesce(x.na, 0) AS n_avertissement, coalesce(x.ni, 0) AS n_info
FROM (SELECT source_file, count(*) AS n, count(*) FILTER (WHERE code_of IS NULL OR machine IS NULL) AS nk FROM v GROUP BY source_file) e
LEFT JOIN (SELECT source_file, count(*) AS n FROM hist GROUP BY source_file) i ON i.source_file = e.source_file
LEFT JOIN (SELECT source_file, CAST(count(*) FILTER (WHERE severity = 'BLOQUANT') AS BIGINT) AS nb,
                  CAST(count(*) FILTER (WHERE severity = 'AVERTISSEMENT') AS BIGINT) AS na,
                  CAST(count(*) FILTER (WHERE severity = 'INFO') AS BIGINT) AS ni
           FROM findings GROUP BY source_file) x ON x.source_file = e.source_file"""
    ),
    "machine_stability": with_base(
        f"""SELECT machine, count(*) AS n_of, {r4(f'stddev_samp(cadence_reelle) / {mean("cadence_reelle")} * 100.0e0')} AS coefficient_variation_pct
FROM hist WHERE {_NB} AND cadence_reelle IS NOT NULL AND machine IS NOT NULL
GROUP BY machine
HAVING count(*) >= 3 AND {mean("cadence_reelle")} <> 0 AND stddev_samp(cadence_reelle) IS NOT NULL"""
    ),
    "stability_summary": with_base(
        f"""SELECT a.n_machines, b.n_ranked, a.n_machines - b.n_ranked AS n_machines_non_evaluees
FROM (SELECT count(DISTINCT machine) AS n_machines FROM hist) a,
     (SELECT count(*) AS n_ranked FROM (SELECT machine FROM hist
        WHERE {_NB} AND cadence_reelle IS NOT NULL AND machine IS NOT NULL GROUP BY machine
        HAVING count(*) >= 3 AND {mean("cadence_reelle")} <> 0 AND stddev_samp(cadence_reelle) IS NOT NULL)) b"""
    ),
    "dimension_summary": with_base(
        "SELECT count(*) AS n_rows, count(DISTINCT produit) AS n_produits, count(DISTINCT machine) AS n_machines FROM hist"
    ),
    "blocking_by_rule": with_base(
        f"""SELECT rule, count(*) AS occurrences, (SELECT count(*) FROM blk) AS n_blocked_rows,
  {r4("count(*) * 100.0e0 / (SELECT count(*) FROM blk)")} AS pct_rows,
  first(code_of ORDER BY source_file, row_index) AS example_code_of,
  first(machine ORDER BY source_file, row_index) AS example_machine,
  first(produit ORDER BY source_file, row_index) AS example_produit
FROM blkf GROUP BY rule""",
        _BLOCKED,
    ),
    "blocking_by_column": with_base(
        """SELECT "column", count(*) AS occurrences FROM blkf WHERE "column" IS NOT NULL AND "column" <> '' GROUP BY "column\"""",
        _BLOCKED,
    ),
    "to_fix_list": with_base(
        f"""SELECT code_of, produit, machine, {r4("cadence_theorique")} AS cadence_theorique_saisie,
  {r4("cadence_reelle")} AS cadence_reelle_observee
FROM blk b WHERE EXISTS (SELECT 1 FROM findings x WHERE x.source_file = b.source_file AND x.row_index = b.row_index
  AND x.rule = 'percentage_ceiling_exceeded' AND x.severity = 'BLOQUANT')""",
        _BLOCKED,
    ),
    "zscore_outliers": with_base(
        "SELECT code_of, produit, machine, metric, "
        + ", ".join(f"{r4(c)} AS {c}" for c in ("value", "group_mean", "group_std", "z_score"))
        + " FROM outl",
        _WORK,
    ),
    "short_history": with_base(
        "SELECT produit, machine, n_of, 3 AS min_required FROM stats WHERE n_of < 3", _WORK
    ),
    "outlier_couples": with_base(
        "SELECT count(*) AS n_couples_with_outlier FROM (SELECT DISTINCT produit, machine FROM outl)", _WORK
    ),
    "recommendations": with_base(
        "SELECT produit, machine, fiable, n_of_disponibles, n_of_utilises, n_of_reference, "
        + ", ".join(f"{r4(c)} AS {c}" for c in (
            "cadence_theorique_actuelle", "cadence_recommandee", "trs_moyen_reference", "ecart_vs_theorique_pct"))
        + ", justification_code FROM recs3",
        _RECS,
    ),
    "reliability_counts": with_base(
        "SELECT count(*) FILTER (WHERE fiable) AS n_fiables, count(*) FILTER (WHERE NOT fiable) AS n_non_fiables FROM recs3",
        _RECS,
    ),
})


# --- question answering ------------------------------------------------------------
def _intent_case(text: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in INTENT_RULES
    )
    return f"CASE {whens} ELSE 'UNKNOWN' END"


_LABEL = r"lower(trim(regexp_replace(produit, '\[[^\]]+\]', '', 'g'), ' -'))"


def _parts(text: str, keys: str, key: str) -> str:
    """(question_id, part): the parts of the questions that are as long as some key, for an equality join with the keys."""
    return f"""(SELECT DISTINCT question_id, substr(t, i, n) AS part
    FROM (SELECT question_id, {text} AS t FROM qs) CROSS JOIN (SELECT DISTINCT length({key}) AS n FROM {keys} WHERE length({key}) > 0)
    CROSS JOIN LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i))"""


_QUESTIONS = f"""
prods AS MATERIALIZED (SELECT DISTINCT produit FROM hist WHERE produit IS NOT NULL),
machs AS MATERIALIZED (SELECT DISTINCT machine FROM hist WHERE machine IS NOT NULL),
ateliers AS (SELECT DISTINCT atelier FROM hist WHERE atelier IS NOT NULL),
qs AS MATERIALIZED (
  SELECT concat('conv-', conv_id, '-', turn) AS question_id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT concat('gen-rec-', produit),
    concat('Quelle cadence recommandes-tu pour le produit ', upper(regexp_extract(produit, '\\[([^\\]]+)\\]', 1)), ' ?') FROM prods
  UNION ALL SELECT concat('gen-perf-', machine), concat('Pourquoi la ', machine, ' est-elle moins performante ?') FROM machs
  UNION ALL SELECT concat('gen-best-', machine), concat('Quelle est la meilleure cadence sur la ', machine, ' ?') FROM machs
  UNION ALL SELECT concat('gen-stable-', atelier), concat('Quelles machines de l''', atelier, ' sont les plus stables ?') FROM ateliers
  UNION ALL SELECT concat('gen-trend-', atelier), concat('Comment évolue le TRS de l''', atelier, ' ?') FROM ateliers
  UNION ALL SELECT DISTINCT concat('gen-why-', upper(regexp_extract(produit, '\\[([^\\]]+)\\]', 1))),
    concat('Pourquoi le produit ', upper(regexp_extract(produit, '\\[([^\\]]+)\\]', 1)), ' est-il moins performant ?') FROM prods
    WHERE regexp_extract(produit, '\\[([^\\]]+)\\]', 1) <> ''
  UNION ALL SELECT DISTINCT concat('gen-word-', {_LABEL}), concat('Quelle est la cadence optimale du ', {_LABEL}, ' ?') FROM prods WHERE {_LABEL} <> ''
  UNION ALL SELECT concat('gen-couple-', machine),
    concat('Quelle cadence recommandes-tu pour ', min(upper(regexp_extract(produit, '\\[([^\\]]+)\\]', 1))), ' sur la ', machine, ' ?')
    FROM hist WHERE machine IS NOT NULL AND regexp_extract(produit, '\\[([^\\]]+)\\]', 1) <> '' GROUP BY machine
),
qi AS (SELECT question_id, text, {_intent_case("text")} AS intent FROM qs),
codes AS MATERIALIZED (
  SELECT code, max(produit) AS produit, min(produit) AS probe_label
  FROM (SELECT produit, upper(regexp_extract(produit, '\\[([^\\]]+)\\]', 1)) AS code FROM prods)
  WHERE code <> '' GROUP BY code
),
words AS MATERIALIZED (
  SELECT DISTINCT produit, word FROM (
    SELECT produit, unnest(string_split_regex(lower(trim(regexp_replace(produit, '\\[[^\\]]+\\]', '', 'g'), ' -')), '\\s+')) AS word
    FROM prods) WHERE length(word) >= 5
),
pc AS MATERIALIZED (SELECT q.question_id, arg_min(c.produit, c.probe_label) AS p_code
       FROM {_parts('upper(text)', 'codes', 'code')} q JOIN codes c ON q.part = c.code GROUP BY q.question_id),
pw AS MATERIALIZED (SELECT q.question_id, min(w.produit) AS p_word
       FROM {_parts('lower(text)', 'words', 'word')} q JOIN words w ON q.part = w.word GROUP BY q.question_id),
mn AS MATERIALIZED (SELECT q.question_id, first(m.machine ORDER BY length(m.machine) DESC, m.machine) AS m_name
       FROM {_parts('lower(text)', 'machs', 'lower(machine)')} q JOIN machs m ON q.part = lower(m.machine) GROUP BY q.question_id),
res AS (
  SELECT qi.question_id, qi.intent, coalesce(pc.p_code, pw.p_word) AS produit,
    CASE WHEN pc.p_code IS NOT NULL THEN 'code' WHEN pw.p_word IS NOT NULL THEN 'word' END AS produit_via,
    mn.m_name AS machine, CASE WHEN mn.m_name IS NOT NULL THEN 'name' END AS machine_via
  FROM qi LEFT JOIN pc ON pc.question_id = qi.question_id LEFT JOIN pw ON pw.question_id = qi.question_id
  LEFT JOIN mn ON mn.question_id = qi.question_id
)"""


def _matches(table: str, cols: str) -> str:
    return f"""
  SELECT r.question_id, {cols} FROM res r JOIN {table} t ON r.produit = t.produit AND r.machine = t.machine
  UNION ALL SELECT r.question_id, {cols} FROM res r JOIN {table} t ON r.produit = t.produit WHERE r.machine IS NULL
  UNION ALL SELECT r.question_id, {cols} FROM res r JOIN {table} t ON r.machine = t.machine WHERE r.produit IS NULL"""


_CONCL = """
concl AS (
  SELECT *, CASE WHEN codes = '' THEN 'NOTHING_NOTABLE' ELSE codes END AS conclusion_codes
  FROM (SELECT *, concat_ws(',',
      CASE WHEN n_of < 3 THEN 'LIMITED_HISTORY' END,
      CASE WHEN n_excluded_bloquant > 0 THEN 'EXCLUDED_BLOCKING' END,
      CASE WHEN trs_moy IS NULL THEN NULL WHEN trs_moy < 50.0e0 THEN 'TRS_LOW' WHEN trs_moy < 75.0e0 THEN 'TRS_MODERATE' ELSE 'TRS_GOOD' END,
      CASE WHEN stabilite_cv IS NULL THEN NULL WHEN stabilite_cv > 30.0e0 THEN 'UNSTABLE' ELSE 'STABLE' END) AS codes
    FROM metrics)
)"""

_REC_COLS = ("t.produit, t.machine, t.fiable, t.n_of_utilises, t.n_of_reference, t.cadence_theorique_actuelle, "
             "t.cadence_recommandee, t.ecart_vs_theorique_pct, t.trs_moyen_reference, t.justification_code")
_PERF_COLS = "t.produit, t.machine, t.n_of, t.trs_moy, t.stabilite_cv, t.conclusion_codes"

ORACLE.update({
    "intent_counts": with_base(
        "SELECT intent, count(*) AS n_questions FROM qi GROUP BY intent", _QUESTIONS),
    "product_index": with_base("SELECT code, produit, probe_label FROM codes", _QUESTIONS),
    "entity_resolution_exact": with_base(
        "SELECT question_id, intent, produit, produit_via, machine, machine_via FROM res", _QUESTIONS),
    "recommendation_lookup_exact": with_base(
        f"""SELECT r.question_id,
  CASE WHEN r.produit IS NULL AND r.machine IS NULL THEN 'NO_ENTITY' WHEN b.question_id IS NULL THEN 'NO_DATA'
       WHEN NOT b.fiable THEN 'INSUFFICIENT_HISTORY' ELSE 'OK' END AS status,
  r.produit, r.machine, b.produit AS answer_produit, b.machine AS answer_machine, b.fiable, b.n_of_utilises,
  b.n_of_reference, {r4("b.cadence_theorique_actuelle")} AS cadence_theorique_actuelle,
  {r4("b.cadence_recommandee")} AS cadence_recommandee, {r4("b.ecart_vs_theorique_pct")} AS ecart_vs_theorique_pct,
  {r4("b.trs_moyen_reference")} AS trs_moyen_reference, b.justification_code
FROM res r LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id
      ORDER BY fiable DESC, n_of_reference DESC, produit, machine) AS k FROM rm) WHERE k = 1
) b ON b.question_id = r.question_id
WHERE r.intent = 'RECOMMEND_CADENCE'""",
        _RECS + "," + _QUESTIONS + ",\nrm AS (" + _matches("recs3", _REC_COLS) + "\n)"),
    "performance_lookup_exact": with_base(
        f"""SELECT r.question_id, st.status, r.produit, r.machine,
  CASE WHEN st.status = 'OK' THEN b.wp END AS answer_produit, CASE WHEN st.status = 'OK' THEN b.wm END AS answer_machine,
  CASE WHEN st.status = 'OK' THEN b.wn END AS n_of, CASE WHEN st.status = 'OK' THEN {r4("b.wt")} END AS trs_moyen,
  CASE WHEN st.status = 'OK' THEN {r4("b.wcv")} END AS stabilite_cv,
  CASE WHEN st.status = 'OK' THEN b.wcodes END AS conclusion_codes,
  CASE WHEN st.status = 'OK' THEN b.n_couples_analyses END AS n_couples_analyses,
  CASE WHEN st.status = 'OK' THEN {r4("b.tg")} END AS trs_moyen_global
FROM res r
LEFT JOIN (
  SELECT question_id, count(*) AS n_candidates, count(trs_moy) AS n_couples_analyses,
    first(produit ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wp,
    first(machine ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wm,
    first(n_of ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wn,
    first(trs_moy ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wt,
    first(stabilite_cv ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wcv,
    first(conclusion_codes ORDER BY trs_moy, produit, machine) FILTER (WHERE trs_moy IS NOT NULL) AS wcodes,
    {mean("trs_moy")} AS tg
  FROM pm GROUP BY question_id
) b ON b.question_id = r.question_id
CROSS JOIN LATERAL (SELECT CASE WHEN r.produit IS NULL AND r.machine IS NULL THEN 'NO_ENTITY'
    WHEN coalesce(b.n_candidates, 0) = 0 THEN 'NO_DATA' WHEN b.n_couples_analyses = 0 THEN 'NO_TRS' ELSE 'OK' END AS status) st
WHERE r.intent = 'WHY_LOW_PERFORMANCE'""",
        _METRICS + "," + _CONCL + "," + _QUESTIONS + ",\npm AS (" + _matches("concl", _PERF_COLS) + "\n)"),
    "stability_lookup": with_base(
        f"""SELECT machine, n_of, {r4("cv")} AS coefficient_variation_pct FROM (
  SELECT machine, count(*) AS n_of, stddev_samp(cadence_reelle) / {mean("cadence_reelle")} * 100.0e0 AS cv
  FROM hist WHERE {_NB} AND cadence_reelle IS NOT NULL AND machine IS NOT NULL GROUP BY machine
  HAVING count(*) >= 3 AND {mean("cadence_reelle")} <> 0 AND stddev_samp(cadence_reelle) IS NOT NULL
) ORDER BY cv, machine LIMIT 3"""),
    "trend_lookup": with_base(
        "SELECT question_id, false AS disponible, 'NO_PRODUCTION_DATE' AS reason FROM qi WHERE intent = 'TRS_TREND'",
        _QUESTIONS),
})


ORACLE.update({
    "training_set": with_base(
        f"""SELECT code_of, produit, machine, atelier, {r4("cadence_theorique")} AS cadence_theorique,
  {r4("CAST(qte_produite AS DOUBLE)")} AS qte_produite, {r4("cadence_reelle")} AS cadence_reelle
FROM hist WHERE {_NB} AND produit IS NOT NULL AND machine IS NOT NULL AND atelier IS NOT NULL
  AND cadence_theorique IS NOT NULL AND qte_produite IS NOT NULL AND cadence_reelle IS NOT NULL"""
    ),
})


# --- report values and ranks --------------------------------------------------------
def _r(expr: str, digits: int) -> str:
    k = f"{10 ** digits}.0e0"
    return f"(floor(({expr}) * {k} + 0.5e0) / {k})"


_Z_ORDER = "floor(abs(z_score) * 1000000.0e0 + 0.5e0) DESC, code_of, machine, metric"
_AUDIT_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
    "n_rows_extracted", "n_rows_inserted", "n_rows_skipped_duplicate", "n_rows_rejected_null_key", "n_bloquant", "n_avertissement", "n_info"))

ORACLE.update({
    "import_log_totals": f"SELECT source_file, {_AUDIT_SUMS} FROM ({ORACLE['import_log']}) GROUP BY ROLLUP (source_file)",
    "couple_ranking": with_base(
        f"""SELECT row_number() OVER (ORDER BY trs_moy ASC NULLS LAST, produit, machine) AS rank, produit, machine, n_of, {r4("trs_moy")} AS trs_moy
FROM metrics""", _METRICS),
    "outlier_ranking": with_base(
        f"""SELECT code_of, produit, machine, metric, {_r("value", 2)} AS value, {_r("group_mean", 2)} AS group_mean, {_r("group_std", 2)} AS group_std,
  {_r("z_score", 2)} AS z_score, row_number() OVER (ORDER BY {_Z_ORDER}) AS rank FROM outl""", _WORK),
    "top_outliers": with_base(f"SELECT code_of, produit, machine, metric FROM outl ORDER BY {_Z_ORDER} LIMIT 5", _WORK),
    "recommendation_report": with_base(
        f"""SELECT produit, machine, fiable, n_of_disponibles, n_of_utilises, n_of_reference, {_r("cadence_theorique_actuelle", 2)} AS cadence_theorique_actuelle,
  {_r("cadence_recommandee", 2)} AS cadence_recommandee, {_r("trs_moyen_reference", 2)} AS trs_moyen_reference,
  {_r("ecart_vs_theorique_pct", 1)} AS ecart_vs_theorique_pct, justification_code,
  row_number() OVER (ORDER BY fiable, produit, machine) AS rank FROM recs3""", _RECS),
})
