"""Sources with a grammar of their own: ORM schemas, locale catalogues, JSON with comments, Kubernetes documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

FIELDS = "path string, model string, field string, type string, is_list boolean, is_optional boolean, is_id boolean, is_unique boolean, is_indexed boolean, table_name string, line int"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def orm_fields(texts: DataFrame, text: str = "text") -> DataFrame:
    """Fields of the models of ORM schema files; block attributes such as indexes are joined to their fields."""

    def run(batches):
        for b in batches:
            rows = []
            for path, t in zip(b["path"], b[text], strict=True):
                t = re.sub(r"//[^\n]*", "", t or "")
                for m in re.finditer(r"(?m)^\s*model\s+(\w+)\s*\{(.*?)^\s*\}", t, re.S):
                    name, body, first = m[1], m[2], t.count("\n", 0, m.start(2)) + 1
                    table = re.search(r'@@map\("([^"]+)"\)', body)
                    indexed = {f.strip().split("(")[0] for x in re.finditer(r"@@(?:index|unique|id)\(\s*(?:fields:\s*)?\[([^\]]*)\]", body) for f in x[1].split(",")[:1]}
                    for k, x in enumerate(body.split("\n")):
                        f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$", x)
                        if f:
                            rows.append((path, name, f[1], f[2], bool(f[3]), bool(f[4]), bool(re.search(r"@id\b", f[5])), bool(re.search(r"@unique\b", f[5])), f[1] in indexed or bool(re.search(r"@(id|unique)\b", f[5])), table[1] if table else name, first + k))
            yield pd.DataFrame(rows, columns=_columns(FIELDS))

    return texts.select("path", text).mapInPandas(run, FIELDS)


def without_comments(text: str) -> str:
    """JSON from JSON with comments and trailing commas; strings are left alone."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


KEYS = "path string, locale string, key string, value string"


def locale_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """Flat keys of locale catalogues: files named by a language tag (or in a folder so named) whose leaves are all strings."""
    tag = re.compile(r"(?:^|/)([a-z]{2,3}(?:[-_][A-Z][a-zA-Z]{1,3})?)(?:/[^/]+)?\.json$")

    def flat(prefix: str, x, out: dict) -> bool:
        if isinstance(x, str):
            out[prefix] = x
            return True
        return isinstance(x, dict) and all(flat(f"{prefix}.{k}" if prefix else k, v, out) for k, v in x.items())

    def run(batches):
        for b in batches:
            rows = []
            for path, t in zip(b["path"], b[text], strict=True):
                m = tag.search(path or "")
                try:
                    tree = json.loads(without_comments(t or "")) if m else None
                except ValueError:
                    tree = None
                out: dict = {}
                if isinstance(tree, dict) and flat("", tree, out):
                    rows += [(path, m[1], k, v) for k, v in out.items()]
            yield pd.DataFrame(rows, columns=_columns(KEYS))

    return texts.select("path", text).mapInPandas(run, KEYS)


CONTAINERS = "path string, document int, kind string, container string, image string, line int, has_limits boolean, privileged boolean"


def containers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Containers of Kubernetes documents, by indentation; templates and aliases are skipped."""

    def run(batches):
        for b in batches:
            rows = []
            for path, t in zip(b["path"], b[text], strict=True):
                line = 1
                for n, doc in enumerate(re.split(r"(?m)^---\s*$", t or "")):
                    kind = re.search(r"(?m)^kind:\s*(\w+)", doc)
                    xs = doc.split("\n")
                    for i, x in enumerate(xs):
                        head = re.match(r"(\s*)(?:initC|c)ontainers:\s*$", x)
                        if not (kind and head):
                            continue
                        depth, item, starts = len(head[1]), None, []
                        for j in range(i + 1, len(xs)):
                            ind = len(xs[j]) - len(xs[j].lstrip())
                            if xs[j].strip() and (ind < depth or (ind == depth and not xs[j].lstrip().startswith("- "))):
                                break
                            if xs[j].lstrip().startswith("- ") and (item is None or ind == item):
                                item = ind
                                starts.append(j)
                        else:
                            j = len(xs)
                        for a, z in zip(starts, [*starts[1:], j], strict=True):
                            own = "\n".join(xs[a:z])
                            image, name = re.search(r"\bimage:\s*['\"]?([^\s'\"]+)", own), re.search(r"\bname:\s*['\"]?([^\s'\"]+)", own)
                            if image and "<<:" not in own and "*" not in own:
                                rows.append((path, n, kind[1], name[1] if name else "", image[1], line + a, bool(re.search(r"(?m)^\s*limits:", own)), bool(re.search(r"(?m)^\s*(privileged|allowPrivilegeEscalation):\s*true", own))))
                    line += len(xs) - 1
            yield pd.DataFrame(rows, columns=_columns(CONTAINERS))

    return texts.select("path", text).mapInPandas(run, CONTAINERS)
