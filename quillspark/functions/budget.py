"""Token budgets and digestion limits: constants of the driver, passed into plans as literals."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the reference's for equal plans.
CACHE_LENGTH = 10240
CACHE_RESERVE = 2440
RESERVED_OUTPUT, ROLLING_MEMORY, INSTRUCTIONS = 768, 900, 350
CHUNK_OUTPUT, FINAL_OUTPUT = 768, 3072
IMAGE_TOKENS = 256
#: Node levels for planning; types that are not listed have DEFAULT_LEVEL.
NODE_LEVELS = {"metadata": 0, "abstract": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "equation": 4, "figure": 4, "table": 4, "theorem": 4, "proof": 4, "definition": 4, "bibliography": 4}
DEFAULT_LEVEL = 4


def scaled(value: int, scale: float) -> int:
    """At least 1; halves go to the even neighbour."""
    if scale <= 0:
        raise ValueError("the context scale must be positive")
    return max(1, round(value * scale))


def scaled_column(value: Column | str, scale: Column | str) -> Column:
    v, s = (F.col(x) if isinstance(x, str) else x for x in (value, scale))
    return F.when(s <= 0, F.raise_error(F.lit("the context scale must be positive")).cast("long")).otherwise(F.greatest(F.lit(1), F.bround(v * s)).cast("long"))


def safe_input_tokens(cache_length: int = CACHE_LENGTH) -> int:
    safe = cache_length - CACHE_RESERVE
    if safe <= 0:
        raise ValueError(f"a cache of {cache_length} tokens leaves no usable input")
    return safe


@dataclass(frozen=True)
class TokenBudget:
    cache_length: int = CACHE_LENGTH
    usable_input_tokens: int = CACHE_LENGTH - CACHE_RESERVE
    reserved_output_tokens: int = RESERVED_OUTPUT
    rolling_memory_tokens: int = ROLLING_MEMORY
    instruction_tokens: int = INSTRUCTIONS
    context_scale: float = 1.0

    @property
    def chunk_text_tokens(self) -> int:
        return self.usable_input_tokens - self.rolling_memory_tokens - self.instruction_tokens

    @classmethod
    def make(cls, cache_length: int = CACHE_LENGTH, scale: float = 1.0) -> TokenBudget:
        return cls(cache_length, safe_input_tokens(cache_length), *(scaled(v, scale) for v in (RESERVED_OUTPUT, ROLLING_MEMORY, INSTRUCTIONS)), scale)

    def as_dict(self) -> dict:
        return asdict(self) | {"chunk_text_tokens": self.chunk_text_tokens}


@dataclass(frozen=True)
class DigestionLimits:
    """Fixed values at scale 1."""

    memory_delta_tokens: int = 260
    chunk_summary_tokens: int = 350
    image_context_tokens: int = 900
    image_summary_tokens: int = 180
    final_summary_tokens: int = 700
    final_image_note_tokens: int = 1200
    final_memory_delta_tokens: int = 3000
    emergency_memory_target_tokens: int = 2200
    final_summary_fallback_tokens: tuple[int, ...] = (500, 350, 220)
    final_compacted_summary_tokens: tuple[int, ...] = (350, 220, 140)
    final_compacted_memory_delta_tokens: int = 1800
    final_compacted_image_note_tokens: int = 800
    memory_compaction_min_target_tokens: int = 200

    @classmethod
    def make(cls, scale: float = 1.0) -> DigestionLimits:
        one = cls()
        values = {f.name: getattr(one, f.name) for f in fields(cls)}
        return cls(**{k: tuple(scaled(x, scale) for x in v) if isinstance(v, tuple) else scaled(v, scale) for k, v in values.items()})

    @property
    def compaction_target(self) -> int:
        return max(self.memory_compaction_min_target_tokens, round(self.emergency_memory_target_tokens * 0.65))


def default_level(name: str) -> int:
    """Level of a node type that may be the planning target."""
    if name not in NODE_LEVELS:
        raise ValueError(f"unknown level {name}; one of {', '.join(NODE_LEVELS)}")
    return NODE_LEVELS[name]


def level_of(node_type: Column) -> Column:
    out = F.lit(DEFAULT_LEVEL)
    for level in sorted(set(NODE_LEVELS.values()) - {DEFAULT_LEVEL}):
        out = F.when(node_type.isin([t for t, x in NODE_LEVELS.items() if x == level]), level).otherwise(out)
    return out
