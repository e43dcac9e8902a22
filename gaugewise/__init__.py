"""Agreement analytics for geospatial time series, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
