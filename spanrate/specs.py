"""Typed specifications: cohort definitions, times at risk, outcomes, analyses.

A specification is plain driver-side data.  The operators read it while they compose
DataFrames, so it never travels with the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

DOMAINS = ("condition", "measurement", "visit", "observation_period")
COMPARISONS = ("lt", "lte", "eq", "gt", "gte", "bt", "!bt")


class SpecError(ValueError):
    """A specification that cannot be evaluated."""


@dataclass(frozen=True)
class ConceptItem:
    concept_id: int
    descendants: bool = False
    excluded: bool = False


@dataclass(frozen=True)
class ConceptSet:
    codeset_id: int
    items: tuple[ConceptItem, ...]
    name: str = ""


@dataclass(frozen=True)
class Comparison:
    """``column op value [.. extent]``; ``bt`` includes both ends, ``gt``/``lt`` are strict."""

    op: str
    value: float | str
    extent: float | str | None = None

    def __post_init__(self):
        if self.op not in COMPARISONS:
            raise SpecError(f"unknown comparison {self.op!r}")
        if self.op.endswith("bt") and self.extent is None:
            raise SpecError("a range needs both ends")


@dataclass(frozen=True)
class Criterion:
    """Which rows of one clinical table count as events."""

    domain: str
    codeset_id: int | None = None
    start: Comparison | None = None
    value: Comparison | None = None
    range_low: Comparison | None = None
    units: tuple[int, ...] = ()
    value_concepts: tuple[int, ...] = ()
    on_dates: tuple[str, str] | None = None
    nested: Group | None = None

    def __post_init__(self):
        if self.domain not in DOMAINS:
            raise SpecError(f"unknown domain {self.domain!r}")
        if self.on_dates is not None and self.domain != "observation_period":
            raise SpecError("fixed dates belong to observation periods")


@dataclass(frozen=True)
class Window:
    """Days relative to the index start; None leaves that side open."""

    start: Days | None = None
    end: Days | None = None


@dataclass(frozen=True)
class Correlated:
    """A criterion counted in a window around the index event.

    ``at_least`` asks for ``count`` or more events, ``exactly`` and ``at_most`` likewise;
    absence is ``exactly`` 0.  An open side of a window ends at the edge of the index
    observation period unless that period is ignored.
    """

    criterion: Criterion
    window: Window = field(default_factory=Window)
    end_window: Window | None = None
    kind: str = "at_least"
    count: int = 1
    ignore_observation_period: bool = False

    def __post_init__(self):
        if self.kind not in ("exactly", "at_most", "at_least"):
            raise SpecError(f"unknown occurrence kind {self.kind!r}")


@dataclass(frozen=True)
class Group:
    kind: str = "ALL"
    criteria: tuple[Correlated, ...] = ()
    groups: tuple[Group, ...] = ()

    def __post_init__(self):
        if self.kind not in ("ALL", "ANY"):
            raise SpecError(f"unknown group kind {self.kind!r}")
        if not self.criteria and not self.groups:
            raise SpecError("an empty criteria group")


@dataclass(frozen=True)
class Rule:
    name: str
    group: Group


@dataclass(frozen=True)
class CohortSpec:
    cohort_id: int
    primary: tuple[Criterion, ...]
    name: str = ""
    concept_sets: tuple[ConceptSet, ...] = ()
    prior_days: int = 0
    post_days: int = 0
    primary_limit: str = "All"
    additional: Group | None = None
    qualified_limit: str = "All"
    rules: tuple[Rule, ...] = ()
    inclusion_limit: str = "All"
    exit_offset: Days = 0
    era_pad: int = 0

    def __post_init__(self):
        for limit in (self.primary_limit, self.qualified_limit, self.inclusion_limit):
            if limit not in ("All", "First"):
                raise SpecError(f"unknown limit {limit!r}")
        if not self.primary:
            raise SpecError("a cohort needs at least one entry criterion")
        if len(self.rules) > 62:
            raise SpecError("the rule mask is a 64 bit integer")
        if (isinstance(self.exit_offset, int) and self.exit_offset < 0) or self.era_pad < 0:
            raise SpecError("exit offset and era pad must not be negative")
        known = {s.codeset_id for s in self.concept_sets}
        missing = sorted({c for c in _codesets_used(self) if c not in known})
        if missing:
            raise SpecError(f"cohort {self.cohort_id} uses undefined concept sets {missing}")

    def checksum(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True)
        return hashlib.md5(text.encode()).hexdigest()


def _with_inner(criterion: Criterion) -> Iterator[Criterion]:
    yield criterion
    if criterion.nested is not None:
        yield from _group_criteria(criterion.nested)


def _group_criteria(group: Group) -> Iterator[Criterion]:
    for correlated in group.criteria:
        yield from _with_inner(correlated.criterion)
    for inner in group.groups:
        yield from _group_criteria(inner)


def criteria_of(spec: CohortSpec) -> Iterator[Criterion]:
    """Every use of a criterion, nested ones included."""
    for criterion in spec.primary:
        yield from _with_inner(criterion)
    if spec.additional is not None:
        yield from _group_criteria(spec.additional)
    for rule in spec.rules:
        yield from _group_criteria(rule.group)


def _codesets_used(spec: CohortSpec) -> Iterator[int]:
    return (c.codeset_id for c in criteria_of(spec) if c.codeset_id is not None)


@dataclass(frozen=True)
class PerCohort:
    """A number of days that differs between the cohorts of one merged spec."""

    days: tuple[tuple[int, int], ...]


Days = int | PerCohort


def _renumbered(node, to: dict[int, int]):
    """``node`` with the concept sets of its criteria renumbered."""
    if isinstance(node, tuple):
        return tuple(_renumbered(n, to) for n in node)
    if isinstance(node, Criterion) and node.codeset_id is not None:
        node = replace(node, codeset_id=to[node.codeset_id])
    if isinstance(node, (Criterion, Correlated, Group, Rule)):
        changes = {f.name: _renumbered(getattr(node, f.name), to) for f in fields(node)}
        return replace(node, **changes)
    return node


def _skeleton(node):
    """``node`` with the days of its windows reduced to open or bounded."""
    if isinstance(node, tuple):
        return tuple(_skeleton(n) for n in node)
    if isinstance(node, Window):
        return Window(*[None if d is None else 0 for d in (node.start, node.end)])
    if isinstance(node, (Criterion, Correlated, Group, Rule)):
        return replace(node, **{f.name: _skeleton(getattr(node, f.name)) for f in fields(node)})
    return node


def _merged(nodes: Sequence, ids: Sequence[int]):
    """One node for many of equal skeleton, with days per cohort where they differ."""
    first = nodes[0]
    if all(n == first for n in nodes):
        return first
    if isinstance(first, int):
        return PerCohort(tuple(zip(ids, nodes, strict=True)))
    if isinstance(first, tuple):
        return tuple(_merged(ns, ids) for ns in zip(*nodes, strict=True))
    changes = {
        f.name: _merged([getattr(n, f.name) for n in nodes], ids) for f in fields(first)
    }
    return replace(first, **changes)


@dataclass(frozen=True)
class Family:
    """Specs that differ by codes, window days and exit offset only: one pass builds them.

    ``codesets`` maps (cohort id, concept set id) to the number ``merged`` uses.
    """

    merged: CohortSpec
    cohort_ids: tuple[int, ...]
    codesets: tuple[tuple[tuple[int, int], int], ...]


def families(specs: Sequence[CohortSpec]) -> list[Family]:
    groups: dict[CohortSpec, list[CohortSpec]] = {}
    numbering: dict[tuple[int, int], int] = {}
    ids = [s.cohort_id for s in specs]
    if len(set(ids)) != len(ids):
        raise SpecError("two specs share a cohort id")
    for spec in specs:
        to: dict[int, int] = {}
        for codeset in _codesets_used(spec):
            to.setdefault(codeset, len(to))
        numbering |= {(spec.cohort_id, old): new for old, new in to.items()}
        plain = replace(
            spec,
            cohort_id=0,
            name="",
            concept_sets=tuple(ConceptSet(n, ()) for n in to.values()),
            primary=_renumbered(spec.primary, to),
            additional=_renumbered(spec.additional, to),
            rules=tuple(Rule("", _renumbered(r.group, to)) for r in spec.rules),
        )
        skeleton = replace(
            plain,
            exit_offset=0,
            primary=_skeleton(plain.primary),
            additional=_skeleton(plain.additional),
            rules=_skeleton(plain.rules),
        )
        groups.setdefault(skeleton, []).append(replace(plain, cohort_id=spec.cohort_id))
    found = []
    for members in groups.values():
        member_ids = tuple(m.cohort_id for m in members)
        merged = _merged([replace(m, cohort_id=0) for m in members], member_ids)
        codesets = tuple((k, v) for k, v in numbering.items() if k[0] in member_ids)
        found.append(Family(merged, member_ids, codesets))
    return found


@dataclass(frozen=True)
class TargetSpec:
    target_cohort_definition_id: int
    target_name: str


@dataclass(frozen=True)
class TarSpec:
    """Time at risk: offsets in days from cohort start (index 0) or cohort end (index 1)."""

    time_at_risk_id: int
    start_offset: int
    start_index: int
    end_offset: int
    end_index: int

    def __post_init__(self):
        if self.start_index not in (0, 1) or self.end_index not in (0, 1):
            raise SpecError(f"time at risk {self.time_at_risk_id}: the index is 0 or 1")
        if self.start_index == self.end_index and self.start_offset > self.end_offset:
            raise SpecError(f"time at risk {self.time_at_risk_id} ends before it starts")
        if (self.start_index, self.end_index) == (1, 0):
            raise SpecError(f"time at risk {self.time_at_risk_id} runs from end to start")


@dataclass(frozen=True)
class OutcomeSpec:
    outcome_id: int
    outcome_cohort_definition_id: int
    outcome_name: str
    clean_window: int = 0
    excluded_cohort_definition_id: int | None = None
    primary_time_at_risk_start_offset: int | None = None
    primary_time_at_risk_start_index: int | None = None
    primary_time_at_risk_end_offset: int | None = None
    primary_time_at_risk_end_index: int | None = None

    def __post_init__(self):
        if self.outcome_id != self.outcome_cohort_definition_id:
            raise SpecError(
                f"outcome {self.outcome_id}: counts are keyed by cohort id and exclusions by"
                " outcome id, so the two ids must be equal"
            )


@dataclass(frozen=True)
class SubgroupSpec:
    subgroup_cohort_definition_id: int
    subgroup_name: str


@dataclass(frozen=True)
class Analysis:
    name: str
    target_ids: tuple[int, ...]
    subgroup_ids: tuple[int, ...]
    time_at_risk_ids: tuple[int, ...]
    outcome_ids: tuple[int, ...]


def check_analysis(
    analysis: Analysis,
    targets: Sequence[TargetSpec],
    subgroups: Sequence[SubgroupSpec],
    tars: Sequence[TarSpec],
    outcomes: Sequence[OutcomeSpec],
) -> list[str]:
    """Ids an analysis names but the settings lack, and settings it leaves unused."""
    pairs = [
        ("target", analysis.target_ids, [t.target_cohort_definition_id for t in targets]),
        ("subgroup", analysis.subgroup_ids, [s.subgroup_cohort_definition_id for s in subgroups]),
        ("time at risk", analysis.time_at_risk_ids, [t.time_at_risk_id for t in tars]),
        ("outcome", analysis.outcome_ids, [o.outcome_id for o in outcomes]),
    ]
    notes = []
    for label, used, known in pairs:
        notes += [f"{label} {i} is not defined" for i in sorted(set(used) - set(known))]
        notes += [f"{label} {i} is not used" for i in sorted(set(known) - set(used))]
    return notes
