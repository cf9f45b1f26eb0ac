"""Settings from the environment; an empty variable counts as unset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Each field is read from the variable of its name in capitals, after LEDGER_; its default's type decides how."""

    kafka_servers: str = "localhost:9094"
    transactions_topic: str = "payments.transactions"
    chargebacks_topic: str = "payments.chargebacks"
    starting_offsets: str = "earliest"
    drops: str = ""
    lake: str = "/data/lakehouse"
    warehouse: str = "/data/warehouse"
    trigger: str = "2 seconds"
    slow_trigger: str = "10 seconds"
    watermark: str = "10 minutes"
    window: str = "5 minutes"
    slide: str = "1 minute"
    offsets_per_trigger: int = 50_000
    bytes_per_trigger: str = "16m"
    idle_timeout: str = "1 hour"
    dimension_refresh_s: int = 300
    rules: str = ""
    ready_file: str = ""
    users: int = 100_000
    merchants: int = 2_500
    seed: int = 42
    fraud_rate: float = 0.0006

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: env.get(f"LEDGER_{f.name.upper()}", "") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name] != ""})
