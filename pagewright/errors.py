"""Refusals by a stable code, as exceptions on the driver and as structs in rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes a caller may match on.
CODES = (
    "runtime-missing", "model-missing", "model-invalid", "dictionary-invalid", "dictionary-mismatch", "options-conflict",
    "nets-invalid", "net-unloaded", "image-invalid", "patch-invalid", "target-size-invalid",
    "detection-output-invalid", "recognition-output-invalid",
    "detection-inference-failed", "recognition-inference-failed", "orientation-inference-failed",
    "worker-unavailable", "worker-start-timeout", "worker-response-timeout", "worker-protocol", "worker-died", "worker-failed",
)


class Refused(ValueError):
    def __init__(self, code: str, detail: str):
        if code not in CODES:
            raise ValueError(f"unknown refusal {code!r}")
        self.code, self.detail = code, detail
        super().__init__(f"{code}: {detail}")


def error(code: str, detail: Column | str) -> Column:
    """A row's nullable ``error`` struct."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"))
