"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunConfig:
    """Thresholds and caps of a run; the defaults are the fixed values of the rules. ``clear`` clears the folders that a run
    writes, and no others, before it."""

    auto_identity: float = 0.86
    clean: float = 0.96
    review: float = 0.65
    title_cap: int = 500
    line_cap: int = 250
    dry_run: bool = False
    clear: bool = False
    repos: dict[str, str] = field(default_factory=lambda: {"openlyrics": "repo_a", "onsong": "repo_b", "txt_chordpro": "repo_c"})

    @property
    def caps(self) -> dict[str, int]:
        """Size of a block of each index: larger buckets are split into blocks, none is dropped."""
        return {"title": self.title_cap, "compact": self.title_cap, "token": self.title_cap, "line": self.line_cap, "shingle": self.line_cap}
