"""Clinical time-series features as Spark jobs: raw event tables in, labelled windows out."""

from icuflow.params import Channel, Params, PressureComponent

__all__ = ["Channel", "Params", "PressureComponent"]
