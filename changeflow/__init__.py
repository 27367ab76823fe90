"""Spark jobs over database change events: project, route, redact, deliver, audit."""
