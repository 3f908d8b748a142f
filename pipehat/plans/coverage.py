"""What a corpus of paths covers of the path language: for test corpora and for lists of paths in use."""

from __future__ import annotations

from collections.abc import Iterable

from .path import ALL, LAST, Filter, PathError, parse

PARTS = ("segment", "occurrence", "all", "last", "filter", "filter_or", "ordering", "field", "repetition", "field_all", "field_last", "component", "subcomponent", "child")


def _parts(path: str, hops: str) -> set[str]:
    plan, found = parse(path, hops), {"segment"}
    if plan.has_child:
        found.add("child")
    for hop in plan.hops:
        if isinstance(hop.index, Filter):
            found |= {"filter"} | ({"filter_or"} if len(hop.index.values) > 1 else set()) | ({"ordering"} if hop.index.ordering else set())
        elif hop.index is not None:
            found.add({ALL: "all", LAST: "last"}.get(hop.index, "occurrence"))
    field = plan.last.field
    if field is not None:
        found.add("field")
        if field.repetition is not None:
            found.add({ALL: "field_all", LAST: "field_last"}.get(field.repetition, "repetition"))
        found |= ({"component"} if field.part.component is not None else set()) | ({"subcomponent"} if field.part.subcomponent is not None else set())
    return found


def coverage(paths: Iterable[str], hops: str = "chain") -> dict:
    """``paths`` (their number), ``covered`` (how many use each part of the language), ``missing`` (parts that none uses) and ``rejected`` (path to kind of error)."""
    covered, rejected, n = dict.fromkeys(PARTS, 0), {}, 0
    for path in paths:
        n += 1
        try:
            for part in _parts(path, hops):
                covered[part] += 1
        except PathError as e:
            rejected[path] = e.kind
    return {"paths": n, "covered": covered, "missing": sorted(k for k, v in covered.items() if not v), "rejected": rejected}
