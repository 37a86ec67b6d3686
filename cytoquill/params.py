"""Run parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# SAM flag masks and mapping-quality codes.
FLAG_INCLUDE_DEFAULT = 3
FLAG_EXCLUDE_DEFAULT = 3852
PAIR_BITS = 0x1 | 0x2 | 0x20 | 0x40 | 0x80
MAPQ_UNAVAILABLE = 255
MAPQ_UNAVAILABLE_AS = 60

# Published per-base substitution error rates by sequencer.
ERROR_RATES = {
    "miseq": 0.00473,
    "miniseq": 0.00613,
    "nextseq500": 0.00429,
    "nextseq550": 0.00593,
    "hiseq2500": 0.00112,
    "novaseq6000": 0.00109,
    "hiseqxten": 0.00087,
}


def error_rate(model: str | float = "novaseq6000") -> float:
    """Rate of a named sequencer, or a custom rate strictly between 0 and 1."""
    if isinstance(model, str) and model.lower() in ERROR_RATES:
        return ERROR_RATES[model.lower()]
    try:
        rate = float(model)
    except ValueError:
        raise ValueError(f"unknown error model {model!r}; known: {', '.join(ERROR_RATES)}") from None
    if not 0.0 < rate < 1.0:
        raise ValueError(f"error rate {rate} must lie strictly between 0 and 1")
    return rate


@dataclass(frozen=True)
class ReadFilter:
    """Which alignments count."""

    include_flags: int = FLAG_INCLUDE_DEFAULT
    exclude_flags: int = FLAG_EXCLUDE_DEFAULT
    unpaired: bool = False
    min_mapq: int = 1
    require_tags: tuple[tuple[str, str], ...] = ()
    max_read_length: int | None = None


@dataclass(frozen=True)
class EndMask:
    """Bases to ignore, 5' to 3': read 1 start, read 1 end, read 2 start, read 2 end."""

    ot: tuple[int, int, int, int] = (0, 0, 0, 0)
    ob: tuple[int, int, int, int] = (0, 0, 0, 0)

    @staticmethod
    def parse(text: str) -> tuple[int, int, int, int]:
        parts = text.split(",")
        if len(parts) != 4 or not all(p.strip().isdigit() for p in parts):
            raise ValueError(f"{text!r} is not four comma-separated non-negative integers")
        a, b, c, d = (int(p) for p in parts)
        return (a, b, c, d)


@dataclass(frozen=True)
class CallParams:
    """Everything the caller needs to know."""

    reads: ReadFilter = field(default_factory=ReadFilter)
    mask: EndMask = field(default_factory=EndMask)
    min_baseq: int = 10
    max_coverage: int = 1000
    m_max_coverage: int = 1000
    ml_threshold: float = 0.4
    cascade_floor: float = 0.005
    error_model: str | float = "novaseq6000"
    min_indel_reads: int = 2
    min_indel_share: float = 0.05
    cluster_gap: int = 20
    max_events: int = 3
    max_events_per_anchor: int = 2
    presence_margin: float = 1.0
    artefact_share: float = 0.1
    artefact_prior: float = -2.0
    informative_margin: float = 0.2
    min_switch_quality: int = 30
    phase_window: int = 100_000
    rescue_clips: bool = False
    all_positions: bool = False
    cpgs_only: bool = False

    def __post_init__(self) -> None:
        if not self.cascade_floor <= self.ml_threshold <= 1.0:
            raise ValueError(f"ml_threshold {self.ml_threshold} must lie in [{self.cascade_floor}, 1]")
