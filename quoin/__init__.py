"""Building-stock analytics on Spark: every operator is a DataFrame -> DataFrame function."""

from quoin.config import HourlyConfig, PreprocessConfig
from quoin.schema import FieldSpec

__all__ = ["FieldSpec", "HourlyConfig", "PreprocessConfig"]
