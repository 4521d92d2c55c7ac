"""reelgrid: timed multimodal feature tables as Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``sources`` (readers, writers), ``plans`` (fused products and
the registered queries), ``streaming`` (Structured Streaming variants).
"""
