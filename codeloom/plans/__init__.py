"""Whole queries: the engine, its reports, and the registered queries over the driver's tables."""
