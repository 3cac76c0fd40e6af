"""Tumor/normal methylation around somatic variants, expressed as Spark DataFrames."""

from strandloom.config import RunConfig
from strandloom.session import build_session

__all__ = ["RunConfig", "build_session"]
