"""The parameters of a corpus build."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class CorpusPolicy:
    # The defaults of a build.
    allowed_licenses: tuple[str, ...] = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")
    allowed_extensions: tuple[str, ...] = (
        ".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".json", ".jsx", ".kt", ".kts", ".md", ".php",
        ".proto", ".py", ".rb", ".rs", ".rst", ".scala", ".sh", ".sql", ".swift", ".toml", ".ts", ".tsx", ".xml", ".yaml", ".yml",
    )
    allowed_filenames: tuple[str, ...] = ("Dockerfile", "Makefile")
    excluded_globs: tuple[str, ...] = (
        "**/.env*", "**/*.lock", "**/*.map", "**/*.min.css", "**/*.min.js", "**/*_generated.*", "**/*.generated.*", "**/.venv/**",
        "**/__pycache__/**", "**/build/**", "**/coverage/**", "**/dist/**", "**/node_modules/**", "**/package-lock.json", "**/target/**", "**/vendor/**",
    )
    min_file_chars: int = 32
    max_file_bytes: int = 1_000_000
    validation_fraction: float = 0.02
    split_salt: str = "corpus-v1"
    near_duplicate_hamming_distance: int = 3
    require_clean_git: bool = True
    require_pinned_revision: bool = True
    reject_sensitive_content: bool = True

    def __post_init__(self) -> None:
        for ok, why in (
            (self.allowed_licenses, "no license is allowed"),
            (self.min_file_chars > 0 and self.max_file_bytes > 0, "file sizes must be positive"),
            (0 < self.validation_fraction < 1, "validation_fraction must lie between 0 and 1"),
            (0 <= self.near_duplicate_hamming_distance <= 3, "near_duplicate_hamming_distance must be 0 to 3"),
            (self.split_salt, "split_salt is empty"),
        ):
            if not ok:
                raise ValueError(why)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @classmethod
    def from_mapping(cls, values: dict | None) -> CorpusPolicy:
        """Unknown keys are errors; lists become tuples."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items()})
