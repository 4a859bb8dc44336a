"""The locked data model: export columns, history columns, finding struct.

The export labels, rule names and severity names below must equal the
original pipeline's values so findings and histories stay interchangeable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the original pipeline's) -----------------------
# Export column label -> history column name, in the export's column order.
EXPORT_COLUMNS: list[tuple[str, str, T.DataType]] = [
    ("Code OF", "code_of", T.StringType()),
    ("Produit", "produit", T.StringType()),
    ("Atelier", "atelier", T.StringType()),
    ("Machine", "machine", T.StringType()),
    ("Qté Produite", "qte_produite", T.IntegerType()),
    ("Durée Totale (min)", "duree_totale_min", T.DoubleType()),
    ("Durée Arrêts (min)", "duree_arrets_min", T.DoubleType()),
    ("Temps Net (min)", "temps_net_min", T.DoubleType()),
    ("Cadence Réelle (pcs/min)", "cadence_reelle", T.DoubleType()),
    ("Cadence Théorique (pcs/min)", "cadence_theorique", T.DoubleType()),
    ("Écart (%)", "ecart_pct", T.DoubleType()),
    ("Disponibilité (%)", "disponibilite_pct", T.DoubleType()),
    ("Performance (%)", "performance_pct", T.DoubleType()),
    ("Qualité (%)", "qualite_pct", T.DoubleType()),
    ("TRS (%)", "trs_pct", T.DoubleType()),
]
SEVERITY_BLOQUANT = "BLOQUANT"
SEVERITY_AVERTISSEMENT = "AVERTISSEMENT"
SEVERITY_INFO = "INFO"
# Rank used to pick the worst severity of a row (higher is worse).
SEVERITY_RANK = {SEVERITY_INFO: 1, SEVERITY_AVERTISSEMENT: 2, SEVERITY_BLOQUANT: 3}
SEVERITIES = [SEVERITY_BLOQUANT, SEVERITY_AVERTISSEMENT, SEVERITY_INFO]
RULE_REQUIRED_COLUMNS = "required_columns_missing"
RULE_MISSING_VALUE = "missing_value"
RULE_DUPLICATE_KEY = "duplicate_key"
RULE_TEMPS_NET = "temps_net_formula"
RULE_ECART = "ecart_formula"
RULE_TRS = "trs_formula"
RULE_PCT_BOUNDS = "percentage_out_of_bounds"
RULE_PCT_CEILING = "percentage_ceiling_exceeded"
RULE_NEGATIVE = "negative_value"
RULE_LOW_THEO = "suspicious_low_cadence_theorique"
# --- end of fixed values ------------------------------------------------------

LABEL = {name: label for label, name, _ in EXPORT_COLUMNS}
NAME_OF_LABEL = {label: name for label, name, _ in EXPORT_COLUMNS}
TYPE = {name: dtype for _, name, dtype in EXPORT_COLUMNS}
DATA_COLUMNS = [name for _, name, _ in EXPORT_COLUMNS]
KEY_COLUMNS = ["code_of", "machine"]
COUPLE = ["produit", "machine"]
DIMENSIONS = ["produit", "atelier", "machine"]
STRICT_PERCENT = ["disponibilite_pct", "qualite_pct"]
FLEXIBLE_PERCENT = ["performance_pct", "trs_pct"]
NON_NEGATIVE = ["qte_produite", "duree_totale_min", "duree_arrets_min", "temps_net_min", "cadence_theorique"]

# Lineage columns added at ingest.
SOURCE_FILE = "_source_file"
ROW_INDEX = "_row_index"
# What orders the rows of a file, for jobs that ask for their order but not for an index.
PLACE = "_place"
EXTRACTED_AT = "_extracted_at"

FINDING = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("code_of", T.StringType()),
        T.StructField("machine", T.StringType()),
        T.StructField("column", T.StringType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)

EXPORT_SCHEMA = T.StructType([T.StructField(label, dtype) for label, _, dtype in EXPORT_COLUMNS])
STAGED_SCHEMA = T.StructType([T.StructField(name, dtype) for _, name, dtype in EXPORT_COLUMNS])

HISTORY_SCHEMA = T.StructType(
    [T.StructField(name, dtype) for _, name, dtype in EXPORT_COLUMNS]
    + [
        T.StructField("quality_severity", T.StringType()),
        T.StructField("quality_details", FINDINGS),
        T.StructField("source_file", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
    ]
)
HISTORY_COLUMNS = [f.name for f in HISTORY_SCHEMA.fields]

IMPORT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("imported_at", T.TimestampType()),
        T.StructField("n_rows_extracted", T.LongType()),
        T.StructField("n_rows_inserted", T.LongType()),
        T.StructField("n_rows_skipped_duplicate", T.LongType()),
        T.StructField("n_rows_rejected_null_key", T.LongType()),
        T.StructField("n_bloquant", T.LongType()),
        T.StructField("n_avertissement", T.LongType()),
        T.StructField("n_info", T.LongType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

# Analysis view of the history (the columns the analytics read).
ANALYSIS_COLUMNS = [
    "produit", "machine", "atelier", "qte_produite", "cadence_theorique", "cadence_reelle",
    "ecart_pct", "disponibilite_pct", "performance_pct", "qualite_pct", "trs_pct",
    "quality_severity", "code_of",
]
