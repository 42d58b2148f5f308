"""Physical strategies of loops."""

from __future__ import annotations

STRATEGIES = ("auto", "blocks", "broadcast", "shuffle")
#: Distinct links up to which rounds are joins of rows if asked: a row for each link and round moves more than packed sums.
JOINED_LINKS = 1_000_000
#: Nodes up to which ranks are broadcast if asked: they pass through the driver, 16 bytes a node and round.
SENT_NODES = 100_000


def choose(strategy: str, graph=None) -> str:
    """`blocks`: packed blocks that stay in place, whatever the graph's size (`auto` too); as joins of rows, `broadcast`: ranks are sent to all links; `shuffle`: both sides by key.

    Joins of rows are for small graphs; `graph`, if given, takes the next plan that holds its size, with the same ranks."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy in ("auto", "blocks") or (graph is not None and graph.n_pairs > JOINED_LINKS):
        return "blocks"
    return "shuffle" if strategy == "broadcast" and graph is not None and graph.n_nodes > SENT_NODES else strategy
