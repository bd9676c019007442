"""Options of detection and masking, checked when made."""

from __future__ import annotations

import re
import time
import warnings
from dataclasses import dataclass, field

from veilwork.errors import ConfigError
from veilwork.functions.patterns import BUILT_IN, LOCALES, OFF, RESERVED, Pattern

CATEGORY_NAME = re.compile(r"[A-Z][A-Z0-9_]*")
#: Texts on which an unsafe pattern takes long. A custom pattern that needs PROBE_S for one of them is refused.
PROBES = ("a" * 30 + "!", "1" * 40 + "x", "a1" * 20 + "!", " " * 40 + "x", "-" * 40, "@" * 30 + "a", "." * 40 + "!", "ab" * 25 + "?", "0" * 25 + "-" * 25, "x" * 50 + "\n")
PROBE_S = 0.1


def safe_pattern(regex: str) -> bool:
    """Whether the pattern compiles and stays quick on every probe, by this thread's CPU time.

    A probe is tried from its end on, two characters more each time, so a pattern that doubles with each is found out early.
    """
    try:
        compiled = re.compile(regex)
    except re.error:
        return False
    for probe in PROBES:
        for n in range(8, len(probe) + 2, 2):
            began = time.thread_time()
            compiled.search(probe[-n:])
            if time.thread_time() - began >= PROBE_S:
                return False
    return True


@dataclass(frozen=True)
class Detect:
    """Which patterns are on. custom: (NAME, regex) pairs; only: categories of the built-in patterns, None for all that are on."""

    locale: str | None = None
    custom: tuple[tuple[str, str], ...] = ()
    only: tuple[str, ...] | None = None
    max_chars: int = 1_000_000
    lenient: bool = False

    def __post_init__(self) -> None:
        if self.max_chars < 0:
            raise ConfigError("max_chars must not be negative")
        for name, _ in self.custom:
            if not CATEGORY_NAME.fullmatch(name):
                raise ConfigError(f"bad category name {name!r}")
            if name in RESERVED:
                raise ConfigError(f"category name {name!r} is reserved")
        if unknown := set(self.only or ()) - {p.category for p in BUILT_IN}:
            raise ConfigError(f"unknown categories {sorted(unknown)}")

    def patterns(self) -> tuple[Pattern, ...]:
        """Custom, locale, built-in: the order in which they claim text. Unsafe custom patterns raise; if lenient they are left out with a warning."""
        custom = []
        for name, regex in self.custom:
            if safe_pattern(regex):
                custom.append(Pattern(name, regex))
            elif not self.lenient:
                raise ConfigError(f"custom pattern {name} is invalid or too slow")
            else:
                warnings.warn(f"custom pattern {name} is invalid or too slow; it is left out", stacklevel=2)
        on = [p for p in BUILT_IN if (p.category in self.only if self.only is not None else p.category not in OFF)]
        return (*custom, *LOCALES.get(self.locale or "", ()), *on)


@dataclass(frozen=True)
class Mask:
    """mode: tokenize (reversible) or redact. hash_key: hex, for entity hashes."""

    mode: str = "tokenize"
    detect: Detect = field(default_factory=Detect)
    hash_key: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("tokenize", "redact"):
            raise ConfigError(f"unknown mode {self.mode!r}")
