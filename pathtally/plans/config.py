"""Run configurations in YAML: a list of runs with tagged analyses."""

from __future__ import annotations

import yaml

from ..model import Count, Grouping, Linkage, Run
from .analyses import KINDS


class Loader(yaml.SafeLoader):
    pass


def _analysis(kind: str):
    def build(loader: Loader, node) -> object:
        raw = loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else {}
        names = {"count_type": "count", "cluster_method": "method"}
        args = {names.get(k, k): v for k, v in raw.items()}
        if "count" in args:
            args["count"] = Count(str(args["count"]).lower())
        if "method" in args:
            args["method"] = Linkage(str(args["method"]).lower())
        for k in ("coverage", "quorum"):
            if k in args:
                args[k] = str(args[k])
        return KINDS[kind](**args)

    return build


for _kind in KINDS:
    Loader.add_constructor(f"!{_kind}", _analysis(_kind))
Loader.add_constructor("!Sample", lambda loader, node: Grouping("sample"))
Loader.add_constructor("!Haplotype", lambda loader, node: Grouping("haplotype"))
Loader.add_constructor("!Custom_", lambda loader, node: Grouping("file", loader.construct_scalar(node)))


def grouping_of(value) -> Grouping:
    if value is None:
        return Grouping()
    if isinstance(value, Grouping):
        return value
    text = str(value)
    return Grouping(text.lower()) if text.lower() in ("sample", "haplotype") else Grouping("file", text)


def runs_of(text: str) -> list[Run]:
    out = []
    for entry in yaml.load(text, Loader) or []:
        given = dict(entry)
        analyses = given.pop("analyses", [])
        given["grouping"] = grouping_of(given.pop("grouping", None))
        unknown = set(given) - {"graph", "name", "subset", "exclude", "grouping", "nice"}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out.append(Run(**given, analyses=analyses))
    return out
