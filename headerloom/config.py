"""Settings of an analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from headerloom.functions.suffixes import SHORT, Suffixes


PREFIX = "HEADERLOOM_"
_TRUTHS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


@dataclass(frozen=True)
class EngineConfig:
    """What an operator of the engine trusts, protects and looks up."""

    trusted_domains: tuple[str, ...] = ()
    trusted_hosts: tuple[str, ...] = ()
    protected_domains: tuple[str, ...] = ()
    verification_enabled: bool = True
    enrichment_enabled: bool = True
    max_header_bytes: int = 256 * 1024
    dnsbl_zones: tuple[str, ...] = ("zen.spamhaus.org", "bl.spamcop.net", "b.barracudacentral.org")
    #: Public suffixes; ``suffixes.from_table`` makes them of a full list.
    suffixes: Suffixes = SHORT
    #: Lookups of each indicator type for a message.
    lookups: dict[str, int] = field(default_factory=lambda: {"ipv4": 10, "ipv6": 10, "domain": 10, "url": 5, "email": 3})

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], prefix: str = PREFIX) -> EngineConfig:
        """Settings by name, for example ``os.environ``: HEADERLOOM_TRUSTED_DOMAINS="a.example, b.example", HEADERLOOM_LOOKUPS="ipv4=10,url=5".

        Names without the prefix are left alone; an unknown name behind it and a value that can't be read are errors.
        What isn't named keeps its default, and so do the types that LOOKUPS doesn't name. Suffixes are no setting.
        """
        default, read = cls(), {}
        known = {prefix + f.name.upper(): f.name for f in fields(cls) if f.name != "suffixes"}
        for name, text in settings.items():
            if not name.upper().startswith(prefix):
                continue
            if name.upper() not in known:
                raise ValueError(f"no such setting: {name}")
            at = known[name.upper()]
            try:
                read[at] = _value(text, getattr(default, at))
            except (KeyError, ValueError) as error:
                raise ValueError(f"{name} can't be {text!r}") from error
        return replace(default, **read)


def _value(text: str, default):
    """The text read as what the default is."""
    parts = tuple(p.strip() for p in text.split(",") if p.strip())
    if isinstance(default, bool):
        return _TRUTHS[text.strip().lower()]
    if isinstance(default, int):
        return int(text)
    if isinstance(default, dict):
        pairs = {k.strip(): int(v) for k, _, v in (p.partition("=") for p in parts)}
        if set(pairs) - set(default):
            raise ValueError("unknown types")
        return default | pairs
    return parts


def read_settings(path: str) -> dict[str, str]:
    """NAME=value of each line of a file on the driver; empty lines and those that begin with # are left out, quotes around a value too."""
    lines = [x.strip().removeprefix("export ") for x in Path(path).read_text(encoding="utf-8").splitlines()]
    pairs = [x.partition("=") for x in lines if x and not x.startswith("#")]
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return {name.strip(): bare(value.strip()) for name, _, value in pairs}
