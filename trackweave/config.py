"""Run parameters: defaults, the text format `key value ...` and its rules (IO22, D12, section 2.13)."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, fields
from typing import get_type_hints

#: The keys every file must set.
REQUIRED = (
    "SnapshotPath", "HaloPath", "SubhaloPath", "SnapshotFileBase", "MaxSnapshotIndex", "BoxSize", "SofteningHalo",
)
#: Keys that files may hold and that mean nothing here, as there is no tree, no table of ids and no reader of
#: one's own whose work they would set. They are accepted with a warning.
WITHOUT_EFFECT = ("TreeNodeOpenAngle", "ParticleIdNeedHash", "GroupLoadedFullParticle", "MaxConcurrentIO")


@dataclass(frozen=True)
class Config:
    """Field names are the parameter names of the file format."""

    SnapshotPath: str = ""
    HaloPath: str = ""
    SubhaloPath: str = ""
    SnapshotFileBase: str = ""
    MaxSnapshotIndex: int = -1
    BoxSize: float = 0.0
    SofteningHalo: float = 0.0
    SnapshotDirBase: str = ""
    SnapshotFormat: str = "parquet"
    GroupFileFormat: str = "parquet"
    MinSnapshotIndex: int = 0
    SnapshotIdList: tuple[int, ...] = ()
    MinNumPartOfSub: int = 20
    MinNumTracerPartOfSub: int = 10
    NumTracerHostFinding: int = 10
    NumTracersForDescendants: int = 10
    MajorProgenitorMassRatio: float = 0.8
    BoundMassPrecision: float = 0.995
    SourceSubRelaxFactor: float = 3.0
    SubCoreSizeFactor: float = 0.0
    SubCoreSizeMin: int = 20
    MaxSampleSizeOfPotentialEstimate: int = 1000
    PotentialEstimateUpscaleMassesPerType: bool = True
    RefineMostBoundParticle: bool = True
    BoundFractionCenterRefinement: float = 0.1
    TracerParticleTypes: tuple[int, ...] = (1, 4)
    DoNotSubsampleParticleTypes: tuple[int, ...] = (5,)
    ReassignParticles: bool = True
    NumNeighboursForReassignment: int = 10
    MergeTrappedSubhalos: bool = True
    MassInMsunh: float = 1e10
    LengthInMpch: float = 1.0
    VelInKmS: float = 1.0
    PeriodicBoundaryOn: bool = True
    MaxPhysicalSofteningHalo: float = -1.0
    ParticleNullGroupId: int = -1
    GroupParticleIdMask: int = 0
    ParticlesSplit: int = -1
    SaveBoundParticleBindingEnergies: bool = False
    SaveBoundParticlePotentialEnergies: bool = False
    SaveBoundParticleProperties: bool = False
    SnapshotHasIdBlock: bool = True
    SnapshotIdUnsigned: bool = False
    NoStripping: bool = False
    InclusiveMass: bool = False
    DmOnly: bool = False
    ThermalEnergy: bool = False

    @property
    def gravity(self) -> float:
        return 43.0071 * (self.MassInMsunh / 1e10) / self.VelInKmS**2 / self.LengthInMpch

    @property
    def tracer_mask(self) -> int:
        return -1 if self.DmOnly else _mask(self.TracerParticleTypes)

    @property
    def keep_mask(self) -> int:
        """Types that are never subsampled; -1 exempts none."""
        return _mask(self.DoNotSubsampleParticleTypes)


def _mask(kinds: Iterable[int]) -> int:
    return sum(1 << k for k in set(kinds) if k >= 0)


def has_duplicates(values: Iterable) -> bool:
    values = list(values)
    return len(set(values)) < len(values)


def _convert(name: str, kind, words: list[str]):
    try:
        if kind == tuple[int, ...]:
            return tuple(int(w) for w in words)
        if kind is bool:
            return bool(int(words[0]))
        return kind(" ".join(words)) if kind is str else kind(words[0])
    except (ValueError, IndexError) as e:
        raise ValueError(f"wrong value of {name}: {' '.join(words) or 'none'}") from e


def parse(text: str) -> Config:
    """A Config from lines `key value ...`; what follows # or [ is a comment. Unknown keys and missing required ones fail."""
    hints = get_type_hints(Config)
    values: dict = {}
    for line in text.splitlines():
        words = line.split("#")[0].split("[")[0].split()
        if not words:
            continue
        if words[0] in WITHOUT_EFFECT:
            warnings.warn(f"{words[0]} has no effect", stacklevel=2)
            continue
        if words[0] not in hints:
            raise ValueError(f"unknown parameter {words[0]}")
        values[words[0]] = _convert(words[0], hints[words[0]], words[1:])
    missing = [k for k in REQUIRED if k not in values]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    config = Config(**values)
    check(config)
    return config


def check(c: Config) -> None:
    """The rules between parameters."""
    for name in ("SnapshotIdList", "TracerParticleTypes", "DoNotSubsampleParticleTypes"):
        if has_duplicates(getattr(c, name)):
            raise ValueError(f"{name} holds a value twice")
    if list(c.SnapshotIdList) != sorted(c.SnapshotIdList):
        raise ValueError("SnapshotIdList must ascend")
    if c.SnapshotIdList and c.MaxSnapshotIndex != len(c.SnapshotIdList) - 1:
        raise ValueError("MaxSnapshotIndex must be the last index of SnapshotIdList")
    if c.MaxSampleSizeOfPotentialEstimate < 0:
        raise ValueError("MaxSampleSizeOfPotentialEstimate must not be negative")
    if c.SubCoreSizeMin < 1 or not 0 <= c.SubCoreSizeFactor <= 1:
        raise ValueError("SubCoreSizeMin must be 1 at least and SubCoreSizeFactor within 0 and 1")
    if set(range(6)) <= set(c.DoNotSubsampleParticleTypes):
        raise ValueError("some type must be open to subsampling")


def dump(c: Config) -> str:
    """The text format of all parameters."""
    rows = []
    for f in fields(c):
        v = getattr(c, f.name)
        if v in ("", ()):
            continue
        rows.append(f"{f.name} {' '.join(map(str, v)) if isinstance(v, tuple) else int(v) if isinstance(v, bool) else v}")
    return "\n".join(rows) + "\n"
