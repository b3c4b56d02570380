"""Named events of a run, what handles them, and the run's context: trace ids, metadata, times of stages.

All of it lives on the driver. Stages are shown as Spark job groups; figures of the data come from Observations, which Spark
fills while it does the work anyway.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation

LOG = logging.getLogger("steadfast")

# The names of events, of kinds of segments and how stable they are, and of how segments of two series match.
EVENTS = (
    "PipelineStarted", "PipelineCompleted", "PipelineError", "ChangePointDetectionStarted", "ChangePointDetected", "SegmentClassificationStarted", "SegmentClassified",
    "StabilityAnalysisStarted", "StabilityAnalysisComplete", "ComparisonStarted", "SegmentComparisonCompleted", "ComparisonCompleted", "SignificantDifference", "DataProcessed", "DiagnosticInfo",
    "ModalityDetectionStarted", "ModalityHistogramCreated", "ModalityPeaksDetected", "ModalityWaterLevelTest", "ModesDetected", "Custom",
)
SEGMENT_CLASSES = ("Ramp", "Plateau", "Oscillatory", "Transient", "Unknown")
STABILITY = ("Stable", "Marginal", "Unstable")
MATCHES = ("Exact", "Overlapping", "Similar", "Sequential")

Handler = Callable[[str, dict], None]


@dataclass(frozen=True)
class TimeRange:
    """From start up to, without, end."""

    start: int
    end: int

    def __len__(self) -> int:
        return max(0, self.end - self.start)

    def overlaps(self, other: TimeRange) -> bool:
        return self.start < other.end and other.start < self.end


@dataclass(frozen=True)
class Pairing:
    """Segments of two series that are compared."""

    a: TimeRange
    b: TimeRange
    confidence: float = 1.0
    match: str = "Similar"
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, a: TimeRange, b: TimeRange, in_sequence: bool = False) -> Pairing:
        """The kind of match that the places tell: the confidence is the share of the longer segment that both cover."""
        if a == b:
            return cls(a, b, 1.0, "Exact")
        both = max(0, min(a.end, b.end) - max(a.start, b.start))
        return cls(a, b, both / max(len(a), len(b), 1), "Overlapping" if a.overlaps(b) else "Sequential" if in_sequence else "Similar")


@dataclass
class Context:
    """What belongs to one run. A fork has an id of its own, knows its parent's, and starts with the parent's metadata."""

    trace: str = field(default_factory=lambda: uuid.uuid4().hex)
    parent: str | None = None
    metadata: dict = field(default_factory=dict)
    hints: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    began: float = field(default_factory=time.monotonic)

    def fork(self, **metadata) -> Context:
        return Context(parent=self.trace, metadata={**self.metadata, **metadata})

    def sides(self) -> tuple[Context, Context]:
        """Two forks for the sides of a comparison."""
        a, b = (self.fork(comparison_side=side, comparison_parent=self.trace) for side in "AB")
        return a, b

    @property
    def elapsed(self) -> float:
        return time.monotonic() - self.began

    @property
    def wants_cache(self) -> bool:
        return "cache" in self.hints

    def add(self, stage: str, seconds: float) -> None:
        self.seconds[stage] = self.seconds.get(stage, 0.0) + seconds


class Events:
    """Named events to handlers; each handler is a callable of a name and a dict, called for the names it asked for, or for all."""

    def __init__(self, enabled: bool = True, context: Context | None = None):
        self.enabled, self.context, self.counts = enabled, context or Context(), Counter()
        self.handlers: list[tuple[Handler, frozenset | None]] = []

    @property
    def seconds(self) -> dict[str, float]:
        return self.context.seconds

    def register(self, handler: Handler, names: Iterable[str] | None = None) -> None:
        self.handlers.append((handler, None if names is None else frozenset(names)))

    def emit(self, name: str, **data) -> None:
        if self.enabled:
            self.counts[name] += 1
            for handler, names in self.handlers:
                if names is None or name in names:
                    handler(name, {"trace": self.context.trace, **data})

    @contextmanager
    def run(self):
        """PipelineStarted, and at the end PipelineCompleted, or PipelineError with the stage that failed."""
        self.emit("PipelineStarted")
        try:
            yield self.context
        except Exception as e:
            self.emit("PipelineError", stage=self.context.metadata.get("stage"), error=str(e))
            raise
        self.emit("PipelineCompleted", seconds=self.context.elapsed)

    @contextmanager
    def stage(self, df: DataFrame, name: str):
        """Times what is done within and shows its Spark jobs as a group."""
        spark = df.sparkSession.sparkContext
        spark.setJobGroup(name, name)
        self.context.metadata["stage"] = name
        began = time.monotonic()
        self.emit("StageStarted", stage=name)
        try:
            yield
        finally:
            self.context.add(name, time.monotonic() - began)
            self.emit("StageEnded", stage=name, seconds=self.seconds[name])
            spark.setLocalProperty("spark.jobGroup.id", None)

    def observe(self, df: DataFrame, stage: str, **figures: Column) -> tuple[DataFrame, Callable[[], dict]]:
        """df, and a function that, once an action on it has run, emits DataProcessed with these aggregates of its rows, and gives them."""
        seen = Observation(f"{stage}-{self.context.trace}")
        observed = df.observe(seen, *(c.alias(name) for name, c in figures.items()))

        def done() -> dict:
            self.emit("DataProcessed", stage=stage, **seen.get)
            return dict(seen.get)

        return observed, done


class Metrics:
    """A handler that keeps how often each event came and the sums of its numbers."""

    def __init__(self):
        self.counts, self.sums = Counter(), Counter()

    def __call__(self, name: str, data: dict) -> None:
        self.counts[name] += 1
        for key, x in data.items():
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                self.sums[name, key] += x


def logging_handler(name: str, data: dict) -> None:
    LOG.info("%s %s", name, data)


def ignore(name: str, data: dict) -> None:
    """A handler that does nothing."""
