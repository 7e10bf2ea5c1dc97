"""Stateful event processing on Spark: envelopes, routing, keyed state, change logs, timers, keyed asynchronous work."""
