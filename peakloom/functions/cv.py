"""Controlled-vocabulary accessions that the engine looks up; fixed values of the PSI-MS vocabulary."""

from __future__ import annotations

ACQUISITION_PARAMETER = "MS:1001954"
ISOLATION_TARGET = "MS:1000827"
ISOLATION_LOWER = "MS:1000828"
ISOLATION_UPPER = "MS:1000829"
SELECTED_ION_MZ = "MS:1000744"
CHARGE_STATE = "MS:1000041"
MS_LEVEL = "MS:1000511"
SCAN_START_TIME = "MS:1000016"
FILTER_STRING = "MS:1000512"
TIC = "MS:1000285"
BASE_PEAK_MZ = "MS:1000504"
BASE_PEAK_INTENSITY = "MS:1000505"
BITS_32 = "MS:1000521"
BITS_64 = "MS:1000523"
ZLIB = "MS:1000574"
MZ_ARRAY = "MS:1000514"
INTENSITY_ARRAY = "MS:1000515"
SAMPLE_NUMBER = "MS:1000001"
SAMPLE_NAME = "MS:1000002"
PROFILE = "MS:1000128"
CENTROID = "MS:1000127"
MINUTES = "UO:0000031"

#: Activation accessions and the names the engine uses for them.
ACTIVATIONS = {"MS:1000133": "CID", "MS:1000598": "ETD", "MS:1002631": "EThcD", "MS:1000422": "HCD", "MS:1000135": "PSD"}
ACQUISITION_MODES = ("DDA", "SWATH", "MRM", "SRM", "UNKNOWN")
