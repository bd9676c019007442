"""What a deployment is set to, for whoever audits it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from pathlib import Path

from veilwork.config import Mask
from veilwork.errors import ConfigError
from veilwork.operators.report import COVERAGE


def summary(mask: Mask, compliance: bool = True, retention_days: int = 180) -> dict:
    """Articles that the records are evidence for, and the options in force; keys are named, not shown."""
    options = asdict(mask)
    options["hash_key"] = "set" if mask.hash_key else None
    patterns = [p.category for p in mask.detect.patterns()]
    return {"articles_addressed": sorted(COVERAGE) if compliance else [], "retention_days": retention_days, "options": options, "categories": patterns}


def export(mask: Mask, path: str, compliance: bool = True) -> None:
    """Write the summary for its owner alone; links are not followed."""
    if "\0" in path or Path(path).is_symlink():
        raise ConfigError("the path is a link or holds a NUL")
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o600)
    with os.fdopen(handle, "w") as f:
        json.dump(summary(mask, compliance), f, indent=2)
    os.chmod(path, 0o600)
