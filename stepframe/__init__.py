"""stepframe: auditable, declarative data-transformation plans executed lazily on Spark."""

from .filters import Col, Filter
from .plans.audit import frame_hash
from .plans.chunked import ChunkedProtocol, ChunkInfo, ChunkingError
from .plans.plan import Plan
from .plans.protocol import Protocol
from .plans.validate import ChunkValidation, DryRun, DryRunStep, SchemaValidationError, Validation, ValidationError

__all__ = ["ChunkInfo", "ChunkValidation", "ChunkedProtocol", "ChunkingError", "Col", "DryRun", "DryRunStep", "Filter", "Plan", "Protocol", "SchemaValidationError", "Validation", "ValidationError", "frame_hash"]
