"""Imports every module that registers queries."""

from framewright.catalog import ORACLES, QUERIES
from framewright.operators import audio, flow, host, media, merge, packets, pixels, relational, tensor, text, timing
from framewright.plans import launch
from framewright.sources import synthetic
from framewright.streaming import queries as streaming

__all__ = ["ORACLES", "QUERIES", "audio", "flow", "host", "launch", "media", "merge", "packets", "pixels", "relational", "streaming", "synthetic", "tensor", "text", "timing"]
