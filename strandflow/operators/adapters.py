"""The adapters and primers that detection tries where no other table is given: a FASTA file, whose path is a parameter.

Fixed values, which must match those that others of these tools try: `adapters.fasta` has one entry for each, sorted by sequence.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from strandflow.sources.fastq import read_fasta

TABLE = str(Path(__file__).with_name("adapters.fasta"))


@lru_cache
def known_adapters(table: str = TABLE) -> dict[str, str]:
    """The name of each sequence of a table."""
    return {seq: name for name, seq in read_fasta(table).items()}
