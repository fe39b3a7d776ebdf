"""Text shapes that give patients or clinics away."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern and what it means, in the order they are tried.
SHAPES = (
    (r"(?i)[A-Z]:[\\/]+Dental[\\/]", "a clinic data folder"),
    (r"(?i)/media/[^/\s]+/[0-9A-F]{8,}/Dental", "a clinic data drive"),
    (r"(?i)[\\/](post_?op|postop)[\\/_ ]", "a post-op case folder"),
    (r"\b20\d{6}_\d{6}_\d{3}\b", "a DICOM export folder (date_time_ms)"),
    (r"(^|[\\/\s\"'`])\d{2}[ _]\d{2}[ _]2\d[ _][^\s\\/]*[A-Za-zЀ-ӿ]{3,}", "a dated case folder (dd mm yy name)"),
    (r"[А-ЯЁ][а-яё]+ [А-ЯЁ]{1,2}\.(dcm|zip|mha|nii)", "a scan file named after a person"),
)
ALLOWED = (r"Dr\. [A-Z]", r"AUTHORS = \[")
PRIVATE = "a word from the private list"
HIDDEN = "(not shown)"


def shape_of(text: Column) -> Column:
    """Meaning of the first matching shape, null if none or if the text is allowed."""
    found = F.when(text.rlike(SHAPES[0][0]), SHAPES[0][1])
    for pattern, why in SHAPES[1:]:
        found = found.when(text.rlike(pattern), why)
    allowed = text.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    return F.when(~allowed, found)


def is_private(text: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
