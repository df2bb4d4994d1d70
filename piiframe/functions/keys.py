"""Key material, resolved once on the driver and never stored in a column."""

from __future__ import annotations

import base64
import hashlib
import os
from dataclasses import dataclass
from typing import Protocol


class KeyProvider(Protocol):
    """Where an engine gets its two secrets from."""

    def encryption_key(self) -> str: ...

    def master_key(self) -> str: ...


@dataclass(frozen=True)
class StaticKeys:
    """Secrets given directly; without a master key the encryption key serves as one."""

    encryption: str
    master: str | None = None

    def encryption_key(self) -> str:
        return self.encryption

    def master_key(self) -> str:
        return self.master or self.encryption


@dataclass(frozen=True)
class EnvKeys:
    """Secrets from environment variables of the driver, with the same fallback."""

    encryption_var: str = "PIIFRAME_ENCRYPTION_KEY"
    master_var: str = "PIIFRAME_MASTER_KEY"

    def encryption_key(self) -> str:
        found = os.environ.get(self.encryption_var)
        if not found:
            raise KeyError(f"{self.encryption_var} is not set; a key is required")
        return found

    def master_key(self) -> str:
        return os.environ.get(self.master_var) or self.encryption_key()


@dataclass(frozen=True)
class CallbackKeys:
    """Secrets fetched by a caller's function, for key services: fetch(name) with the names
    "encryption" and "master"; a missing master falls back as above."""

    fetch: object
    service: str = "key service"

    def encryption_key(self) -> str:
        found = self.fetch("encryption")
        if not found:
            raise KeyError(f"{self.service} has no encryption key")
        return found

    def master_key(self) -> str:
        return self.fetch("master") or self.encryption_key()


def unconfigured(service: str) -> CallbackKeys:
    """A provider for a key service whose client is not part of this library."""

    def fetch(name: str) -> str:
        raise NotImplementedError(f"pass a function that reads the {name} key from {service}")

    return CallbackKeys(fetch, service)


def hmac_pads(master: str) -> tuple[str, str]:
    """Inner and outer pad blocks of HMAC-SHA256 as hex; long keys are hashed first."""
    key = master.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def aes_key(secret: str) -> str:
    """The 32 bytes of a url-safe base64 key as hex; anything else is an error, since a mistyped
    key would silently be another key."""
    try:
        raw = b"" if set("+/") & set(secret) else base64.b64decode(secret.encode(), altchars=b"-_", validate=True)
    except ValueError:
        raw = b""
    if len(raw) != 32:
        raise ValueError("an encryption key is 32 bytes in url-safe base64; from_passphrase makes one of other text")
    return raw.hex()


def from_passphrase(text: str) -> str:
    """An encryption key made from any text."""
    return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode()


def new_key() -> str:
    """A random encryption key."""
    return base64.urlsafe_b64encode(os.urandom(32)).decode()
