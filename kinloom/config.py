"""Configuration of a run, validated."""

from __future__ import annotations

from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A field is missing or has a value out of range."""

    def __init__(self, name: str, reason: str):
        super().__init__(f"{name}: {reason}")
        self.name, self.reason = name, reason


@dataclass(frozen=True)
class DatabaseConfig:
    host: str = ""
    username: str = ""
    password: str = field(default="", repr=False)
    database: str = ""
    port: int = 3307

    def jdbc_url(self) -> str:
        return f"jdbc:mysql://{self.host}:{self.port}/{self.database}"


@dataclass(frozen=True)
class StreamingConfig:
    batch_size: int = 10_000
    resume: bool = False
    checkpoint_path: str | None = None
    partition_strategy: str | None = None


@dataclass(frozen=True)
class MatchingConfig:
    algorithm: int | None = None
    min_score_export: float | None = None
    punctuation: bool = False


@dataclass(frozen=True)
class ExportConfig:
    out_path: str | None = None
    format: str = "csv"


@dataclass(frozen=True)
class AppConfig:
    database: DatabaseConfig = field(default_factory=DatabaseConfig)
    streaming: StreamingConfig = field(default_factory=StreamingConfig)
    matching: MatchingConfig = field(default_factory=MatchingConfig)
    export: ExportConfig = field(default_factory=ExportConfig)

    def validate(self, *, needs_database: bool = True) -> AppConfig:
        if needs_database:
            for name in ("host", "username", "database"):
                if not getattr(self.database, name).strip():
                    raise ConfigError(f"database.{name}", "missing")
            if not 0 < self.database.port <= 65535:
                raise ConfigError("database.port", f"{self.database.port} is out of range")
        if self.export.format not in ("csv", "xlsx", "both", "parquet"):
            raise ConfigError("export.format", f"unsupported: {self.export.format}")
        score = self.matching.min_score_export
        if score is not None and not 0 <= score <= 100:
            raise ConfigError("matching.min_score_export", f"{score} is not from 0 to 100")
        if self.matching.algorithm is not None and self.matching.algorithm not in range(1, 8):
            raise ConfigError("matching.algorithm", f"{self.matching.algorithm} is not from 1 to 7")
        if self.streaming.batch_size <= 0:
            raise ConfigError("streaming.batch_size", "has to be above 0")
        return self
