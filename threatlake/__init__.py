"""threatlake: security analytics on endpoint telemetry, URLs, messages and e-mail, written as Spark jobs."""

__version__ = "0.1.0"
