"""Network-flow analytics as Spark jobs: packets, sessions, detectors, alerts, dashboards, models."""
