"""Default parameters of the peptide triage."""

# --- Fixed values: needed as they are for matching results -----------------

# Receptor keys, in report order, and those a candidate must dock.
RECEPTORS = ["AMY1R", "AMY2R", "AMY3R", "CTR", "CGRP", "AM1R", "AM2R"]
REQUIRED_RECEPTORS = ["AMY1R", "AMY2R", "AMY3R"]

# Stage codes, their names in the audit, and the default order.
STAGE_NAMES = {
    "01": "01_pose_check",
    "03": "03_aggregation",
    "04": "04_allergenicity",
    "05": "05_toxicity",
}
DEFAULT_ORDER = ["03", "04", "05", "01"]
REFERENCE_PEPTIDE = "amylin"

# Verdict texts that count as a pass.
AGGREGATION_PASS = "PASS"
TOXICITY_PASS = "Non-Toxin"
ALLERGEN_PASS = "no evidence"

# Aggregation-prone run: more than this score over at least this many residues.
RUN_THRESHOLD = 5.0
RUN_MIN_LENGTH = 5

# MHC-II windows and cutoffs.
WINDOW_LENGTH = 15
BINDER_CUTOFF = 10.0
RISK_THRESHOLD = 43.0

# Pose check: cutoff in angstrom, distance reported when a side is empty,
# peptide residue ranges (inclusive) and peptide chains in order of preference.
POSE_CUTOFF = 8.0
NO_DISTANCE = 999.0
N_TERMINAL = (1, 13)
C_TERMINAL = (26, 37)
PEPTIDE_CHAINS = ["L", "B"]
RECEPTOR_CHAIN = "A"

# Receptor regions by chain length:
# (chain length, last ectodomain residue, first TMD residue,
#  first deep-groove residue, TMD end, which is exclusive)
REGION_BOUNDARIES = [
    (474, 131, 132, 80, 401),
    (461, 129, 130, 80, 401),
    (450, 107, 108, 56, 377),
    (438, 106, 107, 57, 378),
]

# Folding input: constant N-terminal part, cap residue and its modification.
PEPTIDE_PREFIX = "KCNTATCATQRLA"
CAP_RESIDUE = "X"
CAP_MODIFICATION = "NH2"
GAP = "-"

# FASTA upload batches.
BATCH_SIZE = 50
# ---------------------------------------------------------------------------
