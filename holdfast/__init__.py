"""Customer-retention analytics on Spark: who is worth saving, what to spend, how to prove it."""

from holdfast.config import FIXTURE, REFERENCE, Profile
from holdfast.plans.engine import RetentionEngine

__all__ = ["FIXTURE", "REFERENCE", "Profile", "RetentionEngine"]
