"""Settings from a mapping (the environment by default), and text providers by name.

A provider is a callable from prompt to answer, as `parse.parsed_with_provider` takes it. None is built in: a program
registers its own, with the setting that must hold its key. Where that is empty, the default provider stands in."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

Provider = Callable[[str], str]
PREFIX = "RANKLOOM_"


@dataclass(frozen=True)
class Settings:
    environment: str = "local"
    provider: str = "none"
    warehouse: str = "data/warehouse"
    as_of: str = "2026-06-17"
    half_life_days: float = 90.0
    alpha: float = 0.5
    pool: int = 1000
    top: int = 20
    #: Keys of providers, by name; not shown.
    keys: Mapping[str, str] = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, values: Mapping[str, str] | None = None) -> Settings:
        """From RANKLOOM_<NAME>; keys from RANKLOOM_KEY_<PROVIDER>. Unknown names are ignored; empty values count as unset."""
        values = os.environ if values is None else values
        given = {f.name: type(f.default)(values[PREFIX + f.name.upper()]) for f in fields(cls) if f.name != "keys" and values.get(PREFIX + f.name.upper())}
        keys = {k.removeprefix(f"{PREFIX}KEY_").lower(): v for k, v in values.items() if k.startswith(f"{PREFIX}KEY_") and v}
        return cls(**given, keys=keys)


class UnknownProvider(ValueError):
    pass


class Providers:
    """Named makers of text providers. `none` has no provider: callers then use their templates."""

    def __init__(self, default: str = "none"):
        self.default = default
        self._makers: dict[str, tuple[Callable[[Settings], Provider | None], bool]] = {"none": (lambda settings: None, False)}

    def register(self, name: str, make: Callable[[Settings], Provider | None], needs_key: bool = False) -> None:
        self._makers[name.lower()] = (make, needs_key)

    def get(self, settings: Settings, name: str | None = None) -> Provider | None:
        """The named provider, or that of the settings; the default one where its key is missing."""
        name = (name or settings.provider).lower()
        if name not in self._makers:
            raise UnknownProvider(f"no text provider {name!r}; there are {', '.join(sorted(self._makers))}")
        make, needs_key = self._makers[name]
        if needs_key and not settings.keys.get(name):
            make, _ = self._makers[self.default]
        return make(settings)
