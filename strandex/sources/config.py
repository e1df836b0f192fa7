"""Settings: TOML files merged global, then repository; invalid values are ignored."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..plans import dimensions as d

NAMES = (".strandex.toml", "strandex.toml")
TEMPLATE = """\
# Every setting is optional; what is not set follows from the task and its mode.
# default_mode = "safe"               # mode of tasks that name none
# default_profile = "balanced"        # profile of tasks that name none
# max_tokens = 8000                   # token budget of every task
# context_depth = 2                   # steps that retrieval follows calls
# require_tests = true                # true: always a constraint, false: never one
# no_guessing = true
# follow_existing_patterns = true
# repo_policy = "text for the system block"
# always_on_constraints = ["minimal_diff"]
# disabled_constraints = ["require_explanation"]
# [task_mode_overrides]
# feature = "explore"
"""
#: Settings that are constraints of the same name.
SWITCHES = ("require_tests", "no_guessing", "follow_existing_patterns")


@dataclass
class Settings:
    """What files set; None: not set."""

    default_mode: str | None = None
    default_profile: str | None = None
    max_tokens: int | None = None
    context_depth: int | None = None
    require_tests: bool | None = None
    no_guessing: bool | None = None
    follow_existing_patterns: bool | None = None
    repo_name: str | None = None
    repo_root: str | None = None
    task_mode_overrides: dict[str, str] = field(default_factory=dict)
    always_on_constraints: list[str] = field(default_factory=list)
    disabled_constraints: list[str] = field(default_factory=list)
    repo_policy: str = ""

    def mode_for(self, task_type: str, fallback: str | None = None) -> str | None:
        own = self.task_mode_overrides.get(task_type)
        return own if own in d.MODES else self.default_mode or fallback

    def constraints(self) -> tuple[list[str], list[str]]:
        """(always on, disabled), unknown ones left out; a switch that is set is one or the other."""
        on, off = ([*named, *[s for s in SWITCHES if getattr(self, s) is want]] for named, want in ((self.always_on_constraints, True), (self.disabled_constraints, False)))
        return [c for c in on if c in d.CONSTRAINTS], [c for c in off if c in d.CONSTRAINTS]


def _read(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text())
    except (OSError, ValueError):
        return {}


def merge(base: dict, over: dict) -> dict:
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(root: str | Path | None = None, global_file: str | Path | None = None) -> Settings:
    """Settings of a repository: its own file, or its parent folder's, over the global one."""
    top = Path(root) if root else Path.cwd()
    own = next((p for n in NAMES for p in (top / n, top.parent / n) if p.exists()), None)
    data = merge(_read(Path(global_file or Path.home() / ".config/strandex/config.toml")), _read(own) if own else {})
    if data.get("default_mode") not in (None, *d.MODES):
        del data["default_mode"]
    out = Settings(**{k: v for k, v in data.items() if k in Settings.__dataclass_fields__})
    out.repo_root = out.repo_root or (str(root) if root else None)
    return out


def write_default(path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(TEMPLATE)


def policy_file(path: str | Path) -> str:
    """The text of a policy file, empty without one."""
    return Path(path).read_text().strip() if Path(path).exists() else ""
