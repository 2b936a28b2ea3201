"""Schemas of the tables the triage reads and writes."""

from pyspark.sql import types as T

from .constants import RECEPTORS


def _fields(kind, *names):
    return [T.StructField(n, kind) for n in names]


ROSTER = T.StructType(
    _fields(T.StringType(), "id", "seq_24aa", "full_37aa") + _fields(T.DoubleType(), *RECEPTORS))

TRACK = T.StructType(
    _fields(T.StringType(), "id") + _fields(T.IntegerType(), "res") + _fields(T.StringType(), "aa")
    + _fields(T.DoubleType(), "agg"))

POSE = T.StructType(
    _fields(T.StringType(), "id", "receptor") + _fields(T.DoubleType(), "d_nterm_tmd", "d_cterm_deep")
    + _fields(T.IntegerType(), "nterm_pass", "deep_pass", "pose_pass"))

COVERAGE = T.StructType(
    _fields(T.StringType(), "id") + _fields(T.IntegerType(), "n_peptides_scored")
    + _fields(T.DoubleType(), "min_combined_score") + _fields(T.IntegerType(), "n_below_43")
    + _fields(T.StringType(), "status") + _fields(T.IntegerType(), "cd4_pass"))

BINDER_SUMMARY = T.StructType(
    _fields(T.StringType(), "seq_id") + _fields(T.LongType(), "n_wb_lt10pct"))

ATOMS = T.StructType(
    _fields(T.StringType(), "id", "receptor", "chain") + _fields(T.IntegerType(), "resnum")
    + _fields(T.DoubleType(), "x", "y", "z"))

AUDIT = T.StructType(_fields(T.StringType(), "id", "eliminated_at_stage"))
