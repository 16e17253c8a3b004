"""Release manifests: digests of files, and their verification; also a command line.

    python -m lumenfit.sources.release build OUT BASE FILE...
    python -m lumenfit.sources.release verify MANIFEST BASE

Exit codes: 0 well, 1 drift, 2 no manifest.
"""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import sys
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class ArtifactEntry:
    path: str
    sha256: str
    size_bytes: int


@dataclass(frozen=True)
class ReleaseManifest:
    created_at: str
    environment_ref: str
    artifacts: list[ArtifactEntry] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True)

    @classmethod
    def from_dict(cls, data: dict) -> ReleaseManifest:
        return cls(data["created_at"], data["environment_ref"], [ArtifactEntry(**a) for a in data["artifacts"]])

    @classmethod
    def from_json(cls, text: str) -> ReleaseManifest:
        return cls.from_dict(json.loads(text))


@dataclass(frozen=True)
class DriftReport:
    missing: list[str]
    tampered: list[str]

    @property
    def ok(self) -> bool:
        return not self.missing and not self.tampered


def sha256_file(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build_manifest(paths: list[str | Path], environment_ref: str, base_dir: str | Path) -> ReleaseManifest:
    """Entries of the files, relative to base_dir; files outside it are a ValueError."""
    base = Path(base_dir).resolve()
    entries = []
    for p in map(Path, paths):
        if not p.is_file():
            raise FileNotFoundError(p)
        full = p.resolve()
        entries.append(ArtifactEntry(full.relative_to(base).as_posix(), sha256_file(full), full.stat().st_size))
    return ReleaseManifest(datetime.datetime.now(datetime.UTC).isoformat(), environment_ref, entries)


def verify_manifest(manifest: ReleaseManifest, base_dir: str | Path) -> DriftReport:
    """Missing and changed files; an entry that points out of base_dir is a ValueError."""
    base, missing, tampered = Path(base_dir).resolve(), [], []
    for a in manifest.artifacts:
        full = (base / a.path).resolve()
        if not full.is_relative_to(base):
            raise ValueError(f"{a.path!r} leaves the base directory")
        if not full.is_file():
            missing.append(a.path)
        elif full.stat().st_size != a.size_bytes or sha256_file(full) != a.sha256:
            tampered.append(a.path)
    return DriftReport(missing, tampered)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="release")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("out"), build.add_argument("base"), build.add_argument("files", nargs="+")
    build.add_argument("--environment", default="")
    verify = commands.add_parser("verify")
    verify.add_argument("manifest"), verify.add_argument("base")
    a = parser.parse_args(args)
    if a.command == "build":
        Path(a.out).write_text(build_manifest(a.files, a.environment, a.base).to_json() + "\n", encoding="utf-8")
        return 0
    if not Path(a.manifest).is_file():
        print(f"no manifest at {a.manifest}", file=sys.stderr)
        return 2
    report = verify_manifest(ReleaseManifest.from_json(Path(a.manifest).read_text(encoding="utf-8")), a.base)
    for what in ("missing", "tampered"):
        for p in getattr(report, what):
            print(f"{what}: {p}")
    return 0 if report.ok else 1


if __name__ == "__main__":
    sys.exit(main())
