"""Fixed values that decide results; every one is part of the detection contract."""

# Sampling and detection thresholds.
SAMPLE_BYTES = 65536
ENTROPY_MIN_BYTES = 512
ENTROPY_LIMIT = 7.4
UTF32_MIN_BYTES = 16
UTF16_MIN_BYTES = 10
UTF16_NUL_HIGH = 0.5
UTF16_NUL_LOW = 0.1
UTF16_NUL_MIN = 0.02
UTF16_CHI2_MIN = 300
TEXT_SCALARS = 500
TEXT_MIN_FRACTION = 0.9
CONVERT_CHUNK_BYTES = 262144

# Sentinels and outcomes that appear in reports.
UNKNOWN = "(Unknown)"
FAILED = "(Error)"
UNCHANGED = "Unchanged"
SKIPPED = "Skipped"
CONVERTED = "Converted"
INVALID = "Invalid"
ERROR = "Error"
RESULTS = [UNCHANGED, SKIPPED, CONVERTED, INVALID, ERROR]

# Directories never descended into, and suffixes of the tool's own files.
EXCLUDED_DIRECTORIES = [
    ".git", ".svn", ".hg", ".vs", ".idea", "bin", "obj",
    "node_modules", "packages", "dist", "build", "target",
]
ARTEFACT_SUFFIXES = [".bak", ".unicodechecker.tmp", ".glyphaudit.tmp"]

# Byte-order marks, longest first.
BOMS = [
    ("utf-32", "FFFE0000"),
    ("utf-32BE", "0000FEFF"),
    ("utf-8", "EFBBBF"),
    ("utf-16", "FFFE"),
    ("utf-16BE", "FEFF"),
]

# CSV report header.
CSV_HEADER = ["File", "Encoding", "BOM", "Target", "BOM", "Result"]
