"""Parent-to-child navigation: a profile places segments in a tree, and ``->`` takes a step down in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.path import Filter, Hop, Path
from ..plans.profile import ROOT, Profile
from .extract import chosen, let, no_error, values_of

NO_PARENT = -1


def parents(lines: Column, profile: Profile) -> Column:
    """For each segment the index of its parent: NO_PARENT directly below the root, null outside the tree.

    The first segment lies below the root. Each other lies below the nearest of the segments that are open
    (the last one and its parents) that the profile lets it lie below, which closes all deeper ones; a
    segment that fits nowhere is left out and closes nothing. Work is quadratic in the segments of one message.
    """
    # for each segment name, the node that it opens below each node
    moves: dict[str, list[int | None]] = {}
    for key, child in profile.transitions.items():
        node, _, name = key.partition(":")
        moves.setdefault(name, [None] * (len(profile.transitions) + 1))[int(node)] = child
    nodes = lambda to: F.array(*(F.lit(x).cast("int") for x in to))
    table = F.create_map(*(x for name, to in (moves or {"": [None]}).items() for x in (F.lit(name), nodes(to))))
    entry = lambda node, index: F.struct(node.cast("int").alias("node"), index.cast("int").alias("index"))
    state = lambda open_, found: F.struct(open_.alias("open"), found.alias("found"))
    start = state(F.array(entry(F.lit(ROOT), F.lit(NO_PARENT))), F.array().cast("array<int>"))

    def step(now: Column, i: Column) -> Column:
        opened, found = now["open"], now["found"]

        def attach(to: Column) -> Column:
            deepest = F.array_max(F.transform(opened, lambda e, k: F.when(F.get(to, e["node"]).isNotNull(), k + 1)))
            return let(F.when(i == 0, F.lit(1)).otherwise(deepest), lambda depth: below(to, depth))

        def below(to: Column, depth: Column) -> Column:
            above = F.get(opened, depth - 1)
            node = F.coalesce(F.get(to, above["node"]), F.lit(-1))
            there = state(F.concat(F.slice(opened, F.lit(1), depth), F.array(entry(node, i))), F.concat(found, F.array(above["index"])))
            return F.when(depth.isNull(), state(opened, F.concat(found, F.array(F.lit(None).cast("int"))))).otherwise(there)

        return let(F.try_element_at(table, F.substring(F.get(lines, i), 1, 3)), attach)

    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda s: s["found"])


def placed(lines: Column, above: Column) -> Column:
    """The segments as structs of their index, text and parent."""
    return F.transform(lines, lambda s, i: F.struct(i.alias("index"), s.alias("text"), F.get(above, i).alias("parent")))


def children(nodes: Column, over: Column) -> Column:
    """The direct children of the nodes ``over``, of all names, parent by parent."""
    return F.flatten(F.transform(over, lambda p: F.filter(nodes, lambda n: n["parent"] == p["index"])))


def descended(nodes: Column, over: Column, hop: Hop, d: Column, per_parent: bool) -> tuple[Column, Column]:
    """The children of ``over`` that a hop selects, and the error if its filter can't be judged.

    A number counts from 0 among the children of all names and all parents together; with
    ``per_parent`` it counts from 1 among those of the hop's name below each parent.
    """
    is_named = lambda n: F.startswith(n["text"], F.lit(hop.name))
    if isinstance(hop.index, int):
        if per_parent:
            own = lambda p: F.filter(nodes, lambda n: (n["parent"] == p["index"]) & is_named(n))
            return F.flatten(F.transform(over, lambda p: chosen(own(p), hop, d)[0])), no_error()
        one = F.get(children(nodes, over), F.lit(min(hop.index, 2**31 - 2)))
        return F.when(one.isNotNull() & is_named(one), F.array(one)).otherwise(F.slice(nodes, F.lit(1), F.lit(0))), no_error()
    return chosen(F.filter(children(nodes, over), is_named), hop, d, lambda n: n["text"])


def reached(nodes: Column, path: Path, d: Column, per_parent: bool = False) -> tuple[Column, Column]:
    """The ``placed`` segments that the last step of a path with arrows selects, and the error if a filter can't be judged."""
    first = path.first
    # the index of the first hop counts over all segments of its name, inside the tree or not
    whole = F.filter(nodes, lambda n: F.startswith(n["text"], F.lit(first.name)))
    over, error = chosen(whole, first, d, lambda n: n["text"])
    over = F.filter(over, lambda n: n["parent"].isNotNull())
    for hop in path.hops[1:]:
        over, wrong = descended(nodes, over, hop, d, per_parent)
        if isinstance(hop.index, Filter):
            error = F.coalesce(error, wrong)
    return over, error


def hierarchy_values(nodes: Column, path: Path, d: Column, per_parent: bool = False) -> tuple[Column, Column]:
    """Values and error of a path with arrows over the ``placed`` segments."""
    over, error = reached(nodes, path, d, per_parent)
    return values_of(F.transform(over, lambda n: n["text"]), path.last, d), error
