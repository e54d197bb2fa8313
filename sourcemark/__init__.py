"""Checks generated answers against their sources, as Spark DataFrame operations."""

from .functions.columns import adaptive_k
from .functions.encoders import Encoder, ModelEncoder, TrigramEncoder, WindowEncoding
from .operators.calibrate import calibrate
from .plans.proofread import proofread
from .sources.evidence import Evidence

__version__ = "0.1.0"

#: Kinds of anchors, and notes that an anchor may carry.
KINDS = ("lexical", "numeral", "skipped")
NOTE_CODES = frozenset({"numeral_ambiguous", "stopword", "exact_string_in_span", "grouping_vs_decimal", "separator_repeated"})

__all__ = ["KINDS", "NOTE_CODES", "Encoder", "Evidence", "ModelEncoder", "TrigramEncoder", "WindowEncoding", "__version__", "adaptive_k", "calibrate", "proofread"]
