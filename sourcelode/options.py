"""Scan options and the snapshot of them stored with a scan."""

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ScanOptions:
    # The path patterns decide which files are scanned. Limits are off (0) unless set.
    languages: tuple = ("python", "javascript")
    patterns: tuple = ("owasp-top-10", "custom")
    false_positive_reduction: bool = True
    max_file_size_mb: float = 0
    max_files_per_scan: int = 0
    include_patterns: tuple = ("*.py", "*.js", "*.ts", "*.jsx", "*.tsx")
    exclude_patterns: tuple = (
        "*/node_modules/*", "*/venv/*", "*/env/*", "*/.git/*", "*/dist/*", "*/build/*",
    )
    confidence_threshold: float = 0.5
    enable_ai_analysis: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024


# Settings whose name contains one of these never reach a stored snapshot.
SECRET_MARKS = ("key", "token", "secret", "password")


def config_snapshot(options: ScanOptions) -> str:
    """The options as JSON, without anything that looks like a secret."""
    kept = asdict(options)
    extra = kept.pop("extra")
    public = {
        section: {
            name: value
            for name, value in values.items()
            if name == "max_tokens" or not any(mark in name.lower() for mark in SECRET_MARKS)
        }
        for section, values in extra.items()
    }
    return json.dumps({"scanner": kept, **public}, sort_keys=True)
