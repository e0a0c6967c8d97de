"""tidegrid: preparation, diagnostics and forecasting of panels of time series on Spark."""

from tidegrid.spec import RunParams, SeriesSpec

__all__ = ["RunParams", "SeriesSpec"]
