"""Settings of an engine: fixed names, from keyword arguments or from Spark options with the prefix `spark.pagemill.`."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "spark.pagemill."


@dataclass(frozen=True)
class Settings:
    """What an engine may be told. Unknown names are refused. Of max_records and max_html_bytes, 0 is no limit."""

    user_agent: str = "pagemill"
    rate_per_second: float = 1.0
    rate_burst: int = 1
    allow_private_targets: bool = False
    robots_ttl_seconds: int = 3600
    job_deadline_seconds: float = 60.0
    max_records: int = 1000
    max_html_bytes: int = 5 << 20
    log_level: str = "INFO"

    @staticmethod
    def of(**given: object) -> Settings:
        known = {f.name for f in fields(Settings)}
        if unknown := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(Settings(), **given)

    @staticmethod
    def from_spark(spark: SparkSession, **given: object) -> Settings:
        """Those of the session, with the given ones on top."""
        out: dict[str, object] = {}
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        for name, kind in kinds.items():
            text = spark.conf.get(PREFIX + name, None)
            if text is not None:
                out[name] = text.lower() == "true" if kind is bool else kind(text)
        return Settings.of(**(out | given))
