"""Engine options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """``limit`` hits an input, of which ``visible`` are shown at first; inputs up to ``longest`` characters; chains of rules to their end, or to ``depth`` steps; texts are escaped in HTML; names are looked up too, and counted with ``count_names``; ranks are for words seen ``least_frequency`` times or more."""

    limit: int = 32
    visible: int = 2
    longest: int = 31
    depth: int | None = None
    escape: bool = True
    use_names: bool = True
    count_names: bool = False
    least_frequency: int = 7
