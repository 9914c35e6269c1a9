"""Messages between groups of documents and owners of hash ranges, at any number of both.

A group's questions to all owners are one message for each owner, which is fine while there are few: n groups and
n owners make n * n messages.  Beyond DIRECT groups they go by way of nodes.  A node takes the messages of about
sqrt(n) groups for about sqrt(n) neighbouring owners, joins what they have in common, asks the owners, and hands
the answers down.  So a group sends sqrt(n) messages and a node as many, each of them sqrt(n) times as long:

    text      groups of 12 MB   messages directly   by way of nodes, and entries in each
    1 TB      79 thousand       6.3 * 10^9          4.5 * 10^7, 7 thousand
    10 TB     790 thousand      6.3 * 10^11         1.4 * 10^9, 2 thousand
    100 TB    7.9 million       6.3 * 10^13         4.5 * 10^10, 700
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .packing import lean
from .shared import Workspace

#: Groups that send their messages directly; a million messages at most.
DIRECT = 1024


class Route:
    """parts owners, and as many groups; a group's message goes to an owner or, on two levels, to a range of `fan` of them."""

    def __init__(self, groups: int):
        self.parts = groups
        self.fan = 1 if groups <= DIRECT else math.isqrt(groups - 1) + 1
        self.ranges = -(-groups // self.fan)

    def node(self) -> Column:
        """The node of a message (g, part)."""
        return (F.floor(F.col("g") / self.fan) * self.ranges + F.col("part")).cast("int")

    def up(self, asked: DataFrame, gather: Callable, schema: str, work: Workspace, name: str) -> DataFrame:
        """What the owners are asked: `asked` itself, or what nodes (column node) make of it, with the node as g."""
        if self.fan == 1:
            return asked
        return work.written(asked.withColumn("node", self.node()).groupBy("node").applyInArrow(lean(gather), schema), name)

    def down(self, asked: DataFrame, told: DataFrame, hand: Callable, schema: str, work: Workspace, name: str) -> DataFrame:
        """What the groups are told: `told` itself, or what nodes make of it; hand takes a node's questions and its answers."""
        if self.fan == 1:
            return told
        return work.written(asked.withColumn("node", self.node()).groupBy("node").cogroup(told.groupBy("g")).applyInArrow(lean(hand), schema), name)
