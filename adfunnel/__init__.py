"""adfunnel: paid-acquisition funnel analytics as Spark DataFrame plans."""

from .config import FunnelConfig
from .plans.funnel import Funnel, build_funnel

__all__ = ["FunnelConfig", "Funnel", "build_funnel"]
