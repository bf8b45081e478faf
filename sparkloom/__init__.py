"""sparkloom: analytics over telemetry, documents, records, graphs and vectors, written for Spark."""

__version__ = "0.1.0"
