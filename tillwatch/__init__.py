"""Merchant-risk analytics as composable PySpark DataFrame operators."""

from tillwatch.config import LabelRule, RuleBook, Spine, SweepCosts

__all__ = ["LabelRule", "RuleBook", "Spine", "SweepCosts"]
