"""Enums, thresholds and run parameters. Everything here lives on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum


class Count(str, Enum):
    NODE = "node"
    BP = "bp"
    EDGE = "edge"
    ALL = "all"

    @property
    def measures(self) -> list[str]:
        return ["node", "bp", "edge"] if self is Count.ALL else [self.value]


class Linkage(str, Enum):
    SINGLE = "single"
    COMPLETE = "complete"
    AVERAGE = "average"
    WEIGHTED = "weighted"
    WARD = "ward"
    CENTROID = "centroid"
    MEDIAN = "median"


@dataclass(frozen=True)
class Threshold:
    """A coverage or quorum: a number of groups, or a share of them."""

    value: float
    relative: bool = False

    def absolute(self, n: int) -> int:
        return math.ceil(n * self.value) if self.relative else int(self.value)

    def share(self, n: int) -> float:
        return self.value if self.relative else self.value / n


def parse_thresholds(text: str, relative: bool) -> list[Threshold]:
    """A comma list: shares in [0, 1], or whole numbers."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        try:
            value = float(part) if relative else int(part)
        except ValueError:
            raise ValueError(f"threshold {part!r} is no {'number' if relative else 'whole number'}") from None
        if relative and not 0 <= value <= 1:
            raise ValueError(f"quorum {part} lies outside [0, 1]")
        out.append(Threshold(value, relative))
    return out


def pairs_of(coverage: str = "1", quorum: str = "0") -> list[tuple[Threshold, Threshold]]:
    """Coverage and quorum lists side by side; a list of one serves all of the other."""
    c, q = parse_thresholds(coverage, False), parse_thresholds(quorum, True)
    if not c or not q:
        raise ValueError("coverage and quorum need a value each")
    if len(c) == 1:
        c *= len(q)
    if len(q) == 1:
        q *= len(c)
    if len(c) != len(q):
        raise ValueError(f"{len(c)} coverage and {len(q)} quorum values")
    return list(zip(c, q, strict=True))


@dataclass(frozen=True)
class Grouping:
    """By path (None), 'sample', 'haplotype', or a file of (path, group)."""

    kind: str = "path"
    file: str | None = None

    @staticmethod
    def of(sample: bool = False, haplotype: bool = False, file: str | None = None) -> Grouping:
        """Sample wins over haplotype, haplotype over a file."""
        if sample:
            return Grouping("sample")
        if haplotype:
            return Grouping("haplotype")
        return Grouping("file", file) if file else Grouping()


@dataclass
class Run:
    """What one run asks of one graph; immutable while analyses are computed."""

    graph: str = ""
    name: str | None = None
    subset: str | None = None
    exclude: str | None = None
    grouping: Grouping = field(default_factory=Grouping)
    nice: bool = False
    analyses: list = field(default_factory=list)

    def run_name(self) -> str:
        parts = [self.graph, self.subset or "", self.grouping.file or ({"path": ""}.get(self.grouping.kind, self.grouping.kind))]
        return self.name or "-".join(p for p in parts if p)

    def run_id(self) -> str:
        return slug(self.run_name())


def slug(text: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in text.lower())
