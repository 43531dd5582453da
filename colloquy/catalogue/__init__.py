"""Every query of the engine by name, with the SQL that states its result where SQL can."""

from colloquy.catalogue import flows, gates, reads, retrieval, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (reads, texts, gates, retrieval, flows):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
