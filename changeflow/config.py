"""Destination settings, checked on the driver before any plan is built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

# The only redaction actions, the default mask, and the accepted delivery units.
ACTIONS = ("remove", "mask")
DEFAULT_MASK = "[REDACTED]"
DELIVERY_UNITS = ("event", "transaction")
SIGNING_ALGORITHM = "hmac_sha256"


class ConfigError(ValueError):
    """A setting that must be put right before the job can run."""


def _lowered(values: Any) -> tuple[str, ...]:
    return tuple(str(value).lower() for value in (values or ()))


@dataclass(frozen=True)
class Route:
    """Three optional lists; an empty list matches everything."""

    schemas: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    operations: tuple[str, ...] = ()

    @classmethod
    def parse(cls, raw: dict | None) -> Route:
        raw = raw or {}
        return cls(_lowered(raw.get("schemas")), _lowered(raw.get("tables")), _lowered(raw.get("operations")))


@dataclass(frozen=True)
class Rule:
    action: str
    columns: tuple[str, ...]
    selector: Route = Route()
    replacement: str = DEFAULT_MASK


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    fingerprint: str | None = None

    @property
    def active(self) -> bool:
        return bool(self.rules)

    @classmethod
    def parse(cls, raw: dict | None) -> Policy:
        raw = raw or {}
        rules = []
        for number, entry in enumerate(raw.get("rules", [])):
            action = str(entry.get("action"))
            if action not in ACTIONS:
                raise ConfigError(f"redaction rule {number}: unknown action {action!r}")
            columns = tuple(entry.get("columns") or ())
            if not columns:
                raise ConfigError(f"redaction rule {number}: no columns given")
            rules.append(Rule(action, columns, Route.parse(entry), entry.get("replacement", DEFAULT_MASK)))
        return cls(tuple(rules), fingerprint(raw) if rules else None)


def fingerprint(raw: dict) -> str:
    """sha256 of the key-sorted compact JSON of the policy as written."""
    text = json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Signing:
    """How requests are signed. The secret itself is read where they are sent, under this name."""

    secret_env: str
    signature_header: str = "X-Signature"
    timestamp_header: str = "X-Timestamp"

    @classmethod
    def parse(cls, raw: dict | None, label: str) -> Signing | None:
        if not raw:
            return None
        if raw.get("algorithm", SIGNING_ALGORITHM) != SIGNING_ALGORITHM:
            raise ConfigError(f"destination {label}: the signing algorithm must be {SIGNING_ALGORITHM}")
        if not raw.get("secret_env"):
            raise ConfigError(f"destination {label}: signing needs secret_env")
        return cls(raw["secret_env"], raw.get("signature_header", cls.signature_header), raw.get("timestamp_header", cls.timestamp_header))


@dataclass(frozen=True)
class Destination:
    name: str
    enabled: bool = True
    route: Route = Route()
    policy: Policy = Policy()
    max_attempts: int = 3
    schedule_seconds: tuple[int, ...] = (1, 5, 30)
    headers: dict = field(default_factory=dict, hash=False, compare=False)
    header_env: dict = field(default_factory=dict, hash=False, compare=False)
    signing: Signing | None = None
    timeout_seconds: int = 5


def destinations(config: dict) -> list[Destination]:
    """Destinations of a configuration: the list form, or the single-webhook shorthand."""
    retry = config.get("retry") or {}
    listed = config.get("destinations")
    if listed is None:
        webhook = config.get("webhook")
        if not webhook:
            raise ConfigError("no destinations configured")
        # The shorthand means: every event, the global retry settings, enabled.
        listed = [{key: webhook[key] for key in ("name", "headers", "header_env", "signing", "timeout_seconds") if key in webhook}]
    result = [_destination(entry, retry) for entry in listed]
    names = [item.name for item in result]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ConfigError(f"destination names must be unique: {', '.join(repeated)}")
    if not result:
        raise ConfigError("no destinations configured")
    return result


def _destination(entry: dict, retry: dict) -> Destination:
    if not entry.get("name"):
        raise ConfigError("a destination needs a name")
    own = {**retry, **(entry.get("retry") or {})}
    attempts = int(own.get("max_attempts", Destination.max_attempts))
    schedule = tuple(int(wait) for wait in own.get("schedule_seconds", Destination.schedule_seconds))
    if attempts < 1 or not schedule:
        raise ConfigError(f"destination {entry['name']}: needs max_attempts >= 1 and a retry schedule")
    timeout = int(entry.get("timeout_seconds", Destination.timeout_seconds))
    if timeout < 1:
        raise ConfigError(f"destination {entry['name']}: timeout_seconds must be at least 1")
    return Destination(
        name=entry["name"],
        enabled=bool(entry.get("enabled", True)),
        route=Route.parse(entry.get("route")),
        policy=Policy.parse(entry.get("payload_policy")),
        max_attempts=attempts,
        schedule_seconds=schedule,
        headers=dict(entry.get("headers") or {}),
        header_env=dict(entry.get("header_env") or {}),
        signing=Signing.parse(entry.get("signing"), entry["name"]),
        timeout_seconds=timeout,
    )


def check_unit(unit: str) -> str:
    if unit not in DELIVERY_UNITS:
        raise ConfigError(f"delivery unit must be one of {', '.join(DELIVERY_UNITS)}")
    return unit
