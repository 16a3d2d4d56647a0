"""Size bounds that decide broadcast versus shuffle.

Every broadcast in the library goes through one of these checks.  Counts
that decide a broadcast are exact (a ``count()`` or a known shape such as
K x V), never an estimate.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # A DataFrame side is broadcast only when it has at most this many rows.
    max_broadcast_rows: int = 500_000
    # Numpy state shipped to executors (beta K x V, meta Q x V) in bytes.  The
    # driver holds it about five times over while it is collected and pickled.
    max_broadcast_bytes: int = 32 * 1024 * 1024
    # Topic cells that come to the driver at once: the sums of an EM iteration
    # (starts x K x V), the topics of all runs, their scores (about 20 bytes each,
    # and as much again while they are unpacked).
    max_driver_cells: int = 2_000_000
    # Scores worked out at once by one task (runs x clusters x non-zeros).
    score_cells: int = 16_000_000
    # Text of the documents that one task splits into tokens and counts (their
    # rows take about twenty times as much, within a task's share of memory).
    text_part_bytes: int = 8 * 1024 * 1024
    # Non-zeros that one task gathers into rows of documents.
    nnz_per_task: int = 1_000_000
    # Cached matrix partitions are sized to about this many non-zeros
    # (~100 MB of sparse rows), never fewer partitions than cores.
    nnz_per_partition: int = 8_000_000

    def fits_driver(self, cells: int) -> bool:
        """Whether so many doubles may be collected, held and sent by the driver."""
        return cells * 8 <= self.max_broadcast_bytes and cells <= self.max_driver_cells


LIMITS = Limits()
