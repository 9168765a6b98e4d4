"""Discrete Bayesian-network analytics on Spark: encoding, counts, information, scores, search, inference, evidence."""

from .config import Ablation, PipelineConfig, ScreenerConfig, SearchConfig

__all__ = ["Ablation", "PipelineConfig", "ScreenerConfig", "SearchConfig"]
