"""Prompt-template catalogs: YAML files to one row per template."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = (
    "id string, name string, reference string, original_task boolean, choices_in_prompt boolean, "
    "metrics array<string>, languages array<string>, answer_choices string, jinja string"
)


class _Loader(yaml.SafeLoader):
    """Plain data only: tagged nodes are read as mappings."""


_Loader.add_multi_constructor("!", lambda loader, suffix, node: loader.construct_mapping(node, deep=True))


def _rows(content: bytes) -> list[dict]:
    doc = yaml.load(content, Loader=_Loader) or {}
    out = []
    for key, t in (doc.get("templates") or {}).items():
        meta = t.get("metadata") or {}
        out.append(
            {
                "id": str(t.get("id") or key),
                "name": t.get("name"),
                "reference": t.get("reference"),
                "original_task": meta.get("original_task"),
                "choices_in_prompt": meta.get("choices_in_prompt"),
                "metrics": meta.get("metrics"),
                "languages": meta.get("languages"),
                "answer_choices": t.get("answer_choices"),
                "jinja": t.get("jinja"),
            }
        )
    return sorted(out, key=lambda r: r["name"] or "")


def load_templates(spark: SparkSession, root: str, pattern: str = "*.yaml") -> DataFrame:
    """(dataset, subset, + template columns); dataset and subset come from the folder names."""

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in TEMPLATE.split(', '))}>>")
    def parse(content: pd.Series) -> pd.Series:
        return pd.Series([_rows(bytes(c)) for c in content])

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/") + "/"
    inner = F.split(F.substring_index(F.col("path"), base, -1), "/", -1)
    rows = files.select(
        F.get(inner, F.lit(0)).alias("dataset"),
        F.when(F.size(inner) > 2, F.get(inner, F.lit(1))).alias("subset"),
        F.explode(parse("content")).alias("t"),
    )
    return rows.select("dataset", "subset", "t.*")
