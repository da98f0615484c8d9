"""Causal regime analytics on wide time-series panels, expressed as Spark plans."""
